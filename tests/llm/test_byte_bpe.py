import hashlib

import public_tokenizers as P
import tiktoken

from llm_odd import ODD
from pyspark.sql import functions as F

from provenir.llm.byte_bpe import decode, encode, read_ranks


def test_ids_and_bytes_are_those_of_the_library(spark, make, prose):
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world's   \n\n x", "a" * 3000, " " * 500 + "z", "été über ñandú 日本語 \U0001f600" * 3, "0123456789" * 40, "<|endoftext|>", prose(1, 400), "\u00a0\u2003x", "ab" * 200]
    rows = list(enumerate(texts)) + ODD
    got = encode(make(rows), ranks, P.PATTERN, digests=True).collect()
    assert len(got) == len(rows)
    key = lambda i, t: (str(i), hashlib.sha256((t or "").encode()).hexdigest())
    want = {key(i, t): library.encode_ordinary(t or "") for i, t in rows}
    for r in got:
        ids = want[str(r["doc_id"]), r["decoded_sha256"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    plain = encode(make(rows), ranks, P.PATTERN).select("ids", decode(F.col("ids"), ranks).alias("bytes")).collect()
    assert sorted(bytes(r["bytes"]) for r in plain) == sorted((t or "").encode() for _, t in rows)
    assert all(r["ids"] == library.encode_ordinary(bytes(r["bytes"]).decode()) for r in plain)
    assert encode(make([]), ranks, P.PATTERN).count() == 0
