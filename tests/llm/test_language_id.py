import random

import numpy as np
from pyspark.sql import functions as F

from llm_odd import ODD
from provenir.llm.language_id import GruTagger, document_probabilities, fit, held_out, identify

SOUNDS = {"aa": "lo mi ra tu ve".split(), "bb": "kr scht ngg pfl zwa".split(), "cc": "éa où çi èu ây".split()}


def text(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(spark, make):
    langs = sorted(SOUNDS)
    rows = [(k, text(langs[k % 3], k)) for k in range(240)]
    labelled = make(rows, lang=lambda i: langs[i % 3]).where(~held_out(F.col("doc_id")))
    model = fit(labelled, 100)
    got = {r["doc_id"]: r for r in identify(make(rows), model).collect()}
    assert np.mean([got[k]["lang_pred"] == langs[k % 3] for k in range(240)]) > 0.95
    odd = identify(make([*ODD, (97, "12 ! 34"), (98, text("bb", 1, 30_000))]), model).collect()
    assert len(odd) == len(ODD) + 2
    assert {(r["lang_pred"], r["score"]) for r in odd if r["doc_id"] in (90, 91, 92, 97)} == {("und", 0.0)}
    assert [r["lang_pred"] for r in odd if r["doc_id"] == 98] == ["bb"]
    assert identify(make([]), model).count() == 0


def test_nothing_to_learn_from_and_one_language(make):
    assert fit(make([(1, "some text")], lang=lambda i: None)) is None
    assert [r["lang_pred"] for r in identify(make([(1, "text")]), None).collect()] == ["und"]
    one = fit(make([(1, "some text")]))
    assert [(r["lang_pred"], r["score"]) for r in identify(make([(1, "text")]), one).collect()] == [("en", 1.0)]


def test_gradients_are_right_and_probabilities_sum_to_one():
    model, rng = GruTagger(["a", "b"]), np.random.default_rng(1)
    x, y = rng.integers(0, 256, (12, 5)).astype(np.int16), np.array([0, 1, 0, 1, 1])
    _, g = model.gradients(x, y)
    for name, at in (("U", (0, 2, 3)), ("U", (1, 1, 20)), ("V", (1, 2, 1)), ("E", (0, int(x[3, 2]), 4)), ("b", (0,))):
        held = model.w[name][at]
        losses = []
        for e in (1e-2, -1e-2):
            model.w[name][at] = held + e
            losses.append(model.gradients(x, y)[0])
        model.w[name][at] = held
        assert abs(g[name][at] - (losses[0] - losses[1]) / 2e-2) < 2e-3
    assert np.allclose(document_probabilities(model, [b"a", b"b" * 1000]).sum(axis=1), 1, atol=1e-4)
