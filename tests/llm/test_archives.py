import gzip
import hashlib

import duckdb
import pytest

from attesta.llm import archives as A

BIG = "é💡\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n<p>" * 400


def write_and_read(spark, rows, tmp_path, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, record string")
    A.write_archives(pages, f"file://{tmp_path}/w", **kw)
    return A.read_archives(spark, f"file://{tmp_path}/w").collect()


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(con.execute(A.OP8_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in A.op8_warc_round_trip(spark, sf_dir).collect()), key=str) == want


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\n é", BIG), (2, None, BIG), (9, "http://b", BIG), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "short"), (6, "http://f", "short"), (7, "u", "x" * 300_000), (None, "http://g", "no id"), (8, "http://h", "y" * 65_000)]
    got = {r["page_id"]: r for r in write_and_read(spark, [r + ("x", "y") for r in rows], tmp_path, segment=1000)}
    assert set(got) == {r[0] for r in rows}
    for page, _, html in rows:
        raw, r = (html or "").encode(), got[page]
        assert (r["status"], r["payload_bytes"], r["payload_digest"]) == ("ok", len(raw), hashlib.sha1(raw).hexdigest())
        revisit = page in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else raw)


def test_repeated_rows_and_none(spark, tmp_path):
    rows = [(1, "u", BIG, "", "")] * 3
    got = write_and_read(spark, rows, tmp_path, segment=5000)
    assert [(r["record_type"], r["status"]) for r in got] == [("response", "ok")] * 3


def test_archives_of_others(spark, tmp_path):
    """Plain files, gzip members a record, and blocks that end in parts of the separator."""
    bodies = [b"", b"x", b"x\r\n", b"x\r\n\r", b"\r\n\r\n", b"a\r\n\r\nWARC/1.0\r\n\r\nb", b"end\r\n\r\n"]
    raw = [A.header([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", len(b))]) + b + A.END for i, b in enumerate(bodies)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    got = sorted((r["record_id"], bytes(r["block"])) for r in A.archive_records(spark, f"file://{tmp_path}").collect())
    assert got == sorted((f"<{i}>", b) for i, b in enumerate(bodies) for _ in range(3))


def test_null_id_beside_others(spark, tmp_path):
    """A page of null page_id revisits the response of the others; alone it is the response."""
    got = write_and_read(spark, [(None, "u", BIG, "", ""), (4, "v", BIG, "", ""), (None, "w", BIG[:-1], "", "")], tmp_path)
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("4", "response", None), ("None", "response", None), ("None", "revisit", 4)]


def test_empty_table(spark, tmp_path):
    assert write_and_read(spark, [], tmp_path) == []


@pytest.mark.parametrize("change,status", [(lambda s: s[:1] + s[2:], "missing segment"), (lambda s: s[:-1], "missing segment"), (lambda s: [*s[:-1], {**s[-1], "total": 5}], "wrong length"), (lambda s: [{**s[0], "digest": "sha1:0"}, *s[1:]], "wrong digest"), (lambda s: [{**s[0], "block": s[0]["block"].replace(b"2000\r\n", b"2zz0\r\n")}, *s[1:]], "bad framing")])
def test_broken_segments(change, status):
    block = A.HTTP % 20_000 + A.chunked(b"z" * 20_000)
    segments = []
    for raw in A.records_of("urn:page:4:0123456789abcdef", "u", "response", None, hashlib.sha1(b"z" * 20_000).hexdigest(), block, 3000):
        (f, b), = A.records_in(raw.split(A.END))
        total = f.get("warc-segment-total-length")
        segments.append({"origin_id": f.get("warc-segment-origin-id") or f["warc-record-id"], "record_type": f["warc-type"], "target_uri": "u", "refers_to": None, "digest": f.get("warc-payload-digest"), "number": int(f["warc-segment-number"]), "total": int(total) if total else None, "block": b})
    ok, = A.assembled(segments)
    assert ok[-1] == "ok" and ok[0] == 4 and ok[7] == b"z" * 20_000
    bad, = A.assembled(change(segments))
    assert bad[-1] == status and bad[7] is None


def test_chunk_framing():
    for n in (0, 1, 8191, 8192, 8193):
        assert A.unchunked(A.chunked(b"q" * n)) == b"q" * n
    assert A.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert A.unchunked(b"4\r\nabc\r\n0\r\n\r\n") is None and A.unchunked(b"") is None
