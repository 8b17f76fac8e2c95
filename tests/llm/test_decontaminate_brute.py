import random
import time

from provenir.llm import decontaminate as D
from provenir.llm._words import MARKS, word_hashes


def brute(text, items):
    """Windows of SPAN aligned words with at most WRONG substitutions, joined up for each item and alignment."""
    words, out = text.split(), []
    for item_id, item in items:
        other, runs = item.split(), {}
        span, wrong = (D.SPAN, D.WRONG) if len(other) >= D.SPAN else (len(other), 0)
        if span < D.LEAST:
            continue
        for p in range(len(words) - span + 1):
            for q in range(len(other) - span + 1):
                if sum(a != b for a, b in zip(words[p : p + span], other[q : q + span])) <= wrong:
                    own = runs.setdefault(p - q, [])
                    if own and p <= own[-1][1]:
                        own[-1] = (own[-1][0], p + span)
                    else:
                        own.append((p, p + span))
        out += [(item_id, a, b) for own in runs.values() for a, b in own]
    return sorted(out)


def test_all_windows_against_brute_force():
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta"]) if r.random() < 0.5 else f"w{r.randrange(40)}"
    items = [(k, " ".join(word() for _ in range(r.choice([4, 7, 12, 13, 20, 40])))) for k in range(30)]
    texts = []
    for _ in range(200):
        w = [word() for _ in range(r.randrange(60))]
        own = r.choice(items)[1].split()
        for at in r.sample(range(len(own)), min(r.randrange(4), len(own))):
            own[at] = "changed"
        at = r.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + own + w[at:]))
    found = D.Seeds(items).find(*word_hashes(texts, MARKS, fold=True))
    assert found == [brute(t, items) for t in texts]
    assert sum(map(bool, found)) > 30


def test_a_word_repeated_throughout_is_not_slow():
    begin = time.time()
    found = D.Seeds([(1, "so " * 400)]).find(*word_hashes(["so " * 4000], MARKS, fold=True))
    assert time.time() - begin < 20 and all(i == 1 for i, _, _ in found[0])
    assert max(b for _, _, b in found[0]) == 4000 and min(a for _, a, _ in found[0]) == 0
