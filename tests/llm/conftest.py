import os
import sys
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "ash birch cedar dune elm fern gorse heath iris juniper kelp larch moss nettle oak pine quince reed sage thyme umbel vetch willow yarrow zinnia".split()


@pytest.fixture(scope="session")
def make(spark):
    """documents(doc_id, text, lang, source, n_chars, kept): kept clashes with names that operators use."""

    def make(rows, lang="en"):
        full = [(i, t, lang if isinstance(lang, str) else lang(i), "s", None if t is None else len(t), "own") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make


@pytest.fixture(scope="session")
def prose():
    def prose(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "ly"]) + str(r.randrange(40)) for _ in range(n))

    return prose


