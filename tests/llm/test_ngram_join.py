import random
import re

import numpy as np

from llm_odd import ODD
from provenir.llm.ngram_join import _pack, _unpack, keep_representatives, link_documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    of = {i: i for i, _ in rows if i is not None}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                of[y] = x
    return sorted((str(i), len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets))


def near(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_components_are_those_of_all_pairs(make, prose):
    passage = prose(77, 40)
    rows = [(k, prose(k, 60)) for k in range(40)]
    rows += [(100 + k, near(prose(k % 5, 60), k, 1 + k % 3)) for k in range(40)]
    rows += [(200 + k, near(prose(1000, 200), k, k % 7)) for k in range(60)]  # a large group of near copies
    rows += [(300 + k, prose(2000 + k, 50) + " " + passage) for k in range(60)]  # a common passage
    rows += [(400 + k, prose(3000, 30).upper()) for k in range(20)] + [(420, prose(3000, 30))]
    rows += ODD
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in link_documents(make(rows)).collect())
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_one_document_of_each_group_stays(make, prose):
    rows = [(3, prose(1, 50)), (1, prose(1, 50)), (2, prose(2, 50)), (None, "a"), (4, None), (5, "")]
    kept = keep_representatives(make(rows))
    assert kept.columns == make([]).columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "4", "5", "None"]
    assert link_documents(make([])).count() == 0


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    assert (_unpack(_pack(x)) == x).all()


def test_a_task_counts_before_it_holds_many_shingles():
    """Each flush is of little more than a million shingles, whatever the task reads."""
    import pyarrow as pa
    from provenir.llm import ngram_join

    class Documents:
        def select(self, *_):
            return self

        def mapInArrow(self, task, _):
            raise StopIteration(task)

    try:
        ngram_join.frequency_sketch(Documents(), 1)
    except StopIteration as e:
        task = e.value
    batches = (pa.RecordBatch.from_pydict({"text": [" ".join(map(str, range(k, k + 300_000)))]}) for k in range(0, 2_400_000, 300_000))
    held = [sum(len(b) // 5 for b in flush.column("blob").to_pylist()) for flush in task(batches)]
    assert max(held) < 1_500_000 and sum(held) > 2_300_000
