import base64
import hashlib

from pyspark.sql import functions as F

from skald.llm import warc
from skald.llm.common import Scratch

ROWS = [
    (1, "http://a.example/x?y#z", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "https://b.example", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, None), (4, "http://c.example/", ""),
    (5, "http://d.example/", "x" * 300_000), (5, "http://d.example/", "x" * 300_000), (None, "http://e.example/", "y"), (7, "http://f.example/", "y"), (8, "http://g.example/", "line\nend\r\n\r\n"),
]


def round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write(warc.captures(df, Scratch(spark, "t")), path)
    return warc.assemble(warc.read(spark, path)).collect(), path


def test_round_trip(spark, tmp_path):
    got, _ = round_trip(spark, tmp_path, ROWS)
    last = {}
    for page, _, html in ROWS:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    seen = []
    for r in got:
        assert r.request.target_uri == r.response.target_uri and r.request.payload.startswith("GET /")
        page = int(r.metadata.fields["pageId"]) if r.metadata.fields["pageId"] else None
        seen += [(page, r.response.record_type, r.response.payload, r.response.payload_bytes, r.response.payload_digest)] * r.n
    want = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        first = page == last[html or ""]
        want.append((page, "response" if first else "revisit", html or "" if first else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert sorted(seen, key=str) == sorted(want, key=str)


def test_revisit_names_response(spark, tmp_path):
    got, _ = round_trip(spark, tmp_path, ROWS)
    ids = {r.response.record_id: r for r in got}
    for r in got:
        if r.response.record_type == "revisit":
            assert ids[r.response.refers_id].response.payload_digest == r.response.payload_digest


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.captures(df, Scratch(spark, "t")), str(tmp_path / "w"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect() == []


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 16)
    rows = [(i, f"http://a.example/{i}", f"{i} " + "z" * n) for i, n in enumerate((10, 5_000_000, 3000, 3001, 40_000, *[900] * 90))]
    got, path = round_trip(spark, tmp_path, rows)
    assert sorted(len(r.response.payload) for r in got) == sorted(len(h) for *_, h in rows)
    sizes = sorted(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-"))
    assert sizes[-1] < 5_010_000 and sizes[-2] < 2.2 * (1 << 16) and len(sizes) < 60


def test_links_the_other_way(spark):
    rec = lambda kind, i, to: (kind, i, to, None, "u", None, None, None, None)
    rows = [rec("response", "r1", "q1"), rec("request", "q1", None), rec("metadata", "m1", "q1"), rec("request", "lone", "gone"), rec("response", "r2", None)]
    got = {r.response.record_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1" and got["r2"].request is None and len(got) == 2


def test_digest(spark):
    got = spark.createDataFrame([("",), ("é" * 99,)], "t string").select("t", warc.base32_sha1(F.col("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)
