import base64
import hashlib
import io
import random
import struct

import pyarrow.fs
import pytest
import zstandard

from provenir.llm import warc_zstd as w
from provenir.llm._io import Scratch


def page(r, k):
    return f"<html><head><title>Page {k}</title></head><body>" + "".join(f"<p class='entry'>{r.randrange(10**6)} words of {k}</p>" for _ in range(r.randrange(1, 20))) + "</body></html>"


@pytest.fixture
def pages(spark, tmp_path):
    def pages(rows):
        spark.createDataFrame([(*r, "own", 7) for r in rows], "page_id long, url string, html string, record_type string, id long").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return pages


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, other in rows if (other or "") == (html or "") and j is not None), default=None)
        revisit = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def some():
    r = random.Random(5)
    rows = [(k, f"http://example.org/{k}", page(r, k)) for k in range(120)]
    rows += [(1000 - k, "http://example.org/copy", rows[3][2]) for k in range(60)]  # a large group of copies
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://x.y/ä\r\nWARC-Type: x", "é\U0001f600\r\n\r\nHTTP/1.1"), (2003, "http://x.y/long", "word " * 400_000), (None, "u", rows[4][2]), (None, "u", "alone"), (5, "again", rows[5][2])]
    return rows


def test_query_equals_brute_force(spark, pages):
    rows = some()
    got = [tuple(r) for r in w.op11_dictionary_warc(spark, pages(rows)).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert w.op11_dictionary_warc(spark, pages([])).collect() == []


def test_archives_are_dictionaries_and_single_frames(spark, pages, tmp_path):
    rows = some()
    scratch = Scratch(spark)
    manifest = w.write_archives(w.resolve_revisits(spark.read.parquet(f"{pages(rows)}/pages.parquet").repartition(1)), f"{scratch.root}/a", scratch)
    found = manifest.collect()
    assert sum(m["records"] for m in found) == len(rows)
    seen = 0
    for m in found:
        fs, name = pyarrow.fs.FileSystem.from_uri(m["path"])
        data = fs.open_input_stream(name).read()
        assert len(data) == m["bytes"]
        if not m["dictionary_bytes"]:
            continue
        magic, size = struct.unpack("<II", data[:8])
        assert (magic, size) == (0x184D2A5D, m["dictionary_bytes"])
        trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        rest = data[8 + size :]
        while rest:  # every record is a frame that names the dictionary and can be read alone
            assert zstandard.get_frame_parameters(rest).dict_id == trained.dict_id() != 0
            one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
            text = one.decompress(rest)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            rest, seen = one.unused_data, seen + 1
    assert seen
    payloads = {r["id"]: bytes(r["payload"]) for r in w.read_archives(manifest).where("record_type = 'response' and id is not null").collect()}
    want = {i: (html or "").encode() for i, _, html in rows if i in payloads}
    assert payloads == want


def test_dictionary_saves_space():
    r = random.Random(8)
    records = [w.record(k, f"http://example.org/{k}", page(r, k).encode(), hashlib.sha1(page(r, k).encode()).hexdigest(), None, False, "2020-01-01T00:00:00Z") for k in range(3000)]
    out = io.BytesIO()
    out.close = lambda: None
    archive = w.Archive(out)
    for x in records:
        archive.add(x)
    archive.close()
    alone = sum(len(zstandard.ZstdCompressor(level=w.LEVEL).compress(x)) for x in records)
    assert archive.trained and archive.size < 0.8 * alone
    assert list(w.frames(io.BytesIO(out.getvalue()))) == records


def test_damaged_archives_are_refused():
    text = w.record(1, "http://x.y/", b"<p>", hashlib.sha1(b"<p>").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    assert w.parse(text)["payload"] == b"<p>"
    with pytest.raises(ValueError):
        w.parse(text.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError):
        w.parse(text[:-1])
    with pytest.raises(ValueError):
        list(w.frames(io.BytesIO(zstandard.ZstdCompressor().compress(text)[:-3])))


def test_small_payloads_may_be_left_apart(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r["id"]: r["refers_to"] for r in w.resolve_revisits(rows, least=4).collect()} == {1: None, 2: None, 3: None, 4: 3}
