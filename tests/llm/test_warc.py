import gzip
import hashlib
import io
import random

import pytest
from pagelathe.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, record_type string, refers_to long, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 9, "x") for r in rows], SCHEMA)


def test_odd_pages(spark):
    big = "é" * 300_000
    rows = [(4, "http://a", "x" * 200), (2, None, "x" * 200), (9, "u\r\nv", "x" * 200), (3, "http://c", "short"), (1, "http://d", "short"), (5, "e", None), (6, "f", ""), (7, "g", big), (8, "h", big), (8, "h", big), (None, "n", "x" * 200), (None, "n", "y" * 200), (None, None, "y" * 200)]
    got = warc.read_records(warc.write_archives(pages(spark, rows))).collect()
    first = {"x" * 200: 2, big: 7}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        least = first.get(html)
        revisit = least is not None and i != least
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert warc.read_records(warc.write_archives(pages(spark, []))).collect() == []


def archive_of(path, records):
    """Payloads written chunk by chunk; records are (page_id, url, payload, kind, refers_to)."""
    out = warc._Archive(f"file://{path}")
    for page_id, url, payload, kind, refers_to in records:
        out.begin(page_id, url, hashlib.sha256(payload).hexdigest(), kind, refers_to, None, len(payload))
        for k in range(0, len(payload) if kind == "response" else 0, 300):
            out.feed(payload[k : k + 300])
        out.end()
    out.close()
    return path.read_bytes()


def test_chunks_carry_running_digests(tmp_path):
    payload = random.Random(2).randbytes(1000) + b"\r\nWARC/1.1\r\n\r\n" + bytes(700)
    data = archive_of(tmp_path / "a.warc.gz", [(7, "http://x", payload, "response", None), (8, None, payload, "revisit", 7)])
    rows = list(warc.read_chunks(io.BytesIO(data), chunk=256))
    own = [r for r in rows if r[4] == 7]
    assert b"".join(r[9] for r in own) == payload and max(len(r[9]) for r in own) == 256
    assert [r[7] for r in own] == list(range(len(own))) and [r[8] for r in own] == [False] * (len(own) - 1) + [True]
    for r in own:
        assert r[11] == hashlib.sha256(payload[: r[10]]).hexdigest()
    (revisit,) = [r for r in rows if r[4] == 8]
    assert revisit[3] == "revisit" and revisit[6] == 7 and revisit[12] == len(payload) and revisit[9] == b""


def test_wrong_payloads_are_errors(tmp_path):
    good = archive_of(tmp_path / "a.warc.gz", [(7, "http://x", b"y" * 500, "response", None)])
    plain = gzip.decompress(good).replace(b"yyyyyyyyyy", b"yyyyyzyyyy", 1)
    with pytest.raises(ValueError, match="not the payload"):
        list(warc.read_chunks(io.BytesIO(gzip.compress(plain))))
    out = warc._Archive(f"file://{tmp_path}/b.warc.gz")
    out.begin(1, None, hashlib.sha256(b"abc").hexdigest(), "response", None, None, 3)
    out.feed(b"abd")
    with pytest.raises(ValueError, match="not its payload"):
        out.end()


def test_record_ids_are_unique(spark):
    rows = [(1, "a", "x" * 150), (1, "a", "x" * 150), (None, "b", "y" * 150), (None, "b", "y" * 150), (2, "c", "x" * 150)]
    chunks = warc.chunk_table(warc.write_archives(pages(spark, rows))).collect()
    assert len({r["record_id"] for r in chunks}) == len({(r["record_id"], r["chunk_no"]) for r in chunks}) == len(rows)


def test_chunks_on_the_way_in(spark):
    text = "é" * 1000 + "z"
    plan = warc.plan_records(pages(spark, [(1, "a", text), (2, "b", text), (3, "c", "")]))
    rows = warc.payload_chunks(plan, 300).collect()
    own = sorted((r for r in rows if r["page_id"] == 1), key=lambda r: r["chunk_no"])
    assert b"".join(bytes(r["chunk"]) for r in own) == text.encode() and len(own) == 7 and {r["n_chunks"] for r in own} == {7}
    assert [(r["record_type"], bytes(r["chunk"]), r["refers_to"], r["refers_url"], r["payload_bytes"]) for r in rows if r["page_id"] == 2] == [("revisit", b"", 1, "a", 2001)]
    assert [(r["n_chunks"], bytes(r["chunk"])) for r in rows if r["page_id"] == 3] == [(1, b"")]


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in warc.op3_warc(spark, sf).collect()}
    stored = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(stored)
    for r in stored:
        data = (r["html"] or "").encode()
        first = min(x["page_id"] for x in stored if x["html"] == r["html"])
        revisit = len(data) >= 100 and first != r["page_id"]
        assert tuple(got[r["page_id"]])[1:] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)


def test_payload_table(spark):
    manifest = warc.write_archives(pages(spark, [(1, "a", "z" * 200_000)]))
    rows = sorted(warc.chunk_table(manifest).collect(), key=lambda r: r["chunk_no"])
    assert b"".join(bytes(r["chunk"]) for r in rows) == b"z" * 200_000 and len(rows) == 4
