"""Registered queries against their SQL on the smallest tables; the driver compares all of them."""

import duckdb
import pytest

from skald.plans import QUERIES, SQL
from skald.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["t1_parse_markup", "t3_split_scenes", "t4a_split_sentences", "e4_analyze_sentence", "e5_detect_story_structure", "n11_normalize", "j4_plan_diff", "j9_resume_plan", "w2_timeline_cursor", "a11_gated_loudness", "a12_quality_gate", "j8_crossfade", "r1_plan_prosody", "s7_write_stems", "s4_scan_pronunciations", "r3_rate_pitch", "p4_voices_for_engine", "u1_all_voices", "j3_cache_hits", "x2_stream_dedup_chunks", "x3_stream_progress", "s2_s3_projects", "t7_annotate_script"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted([plain(x) for x in r] for r in got.select(*names).collect()) == sorted([plain(x) for x in r] for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", ["n11_normalize", "n1_number_to_words", "n4_long_amounts"])
def test_keys_of_any_size_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    shifts = ", ".join(str(10**i) for i in range(6, 19, 3)) + ", 999999, 1999999999, 1999999999999999999"
    con.execute(f"copy (select o_orderkey + shift as o_orderkey, * exclude (o_orderkey, shift) from (select o.*, unnest([{shifts}]) shift from '{SF}/orders.parquet' o where o_orderkey < 40)) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert len(got) > 300 and got == sorted(con.execute(SQL[name]).fetchall())


def test_scripts_whose_ids_are_shared_or_missing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (None, "c\r\nd"), (2, ""), (3, "é\n"), (-4, " x ")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["s1_scan_scripts"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(SQL["s1_scan_scripts"]).fetchall()))


def test_scripts_of_folders_within_folders(spark, tmp_path):
    for name in ("a.txt", "x/b.txt", "x/y/z/c d.txt", "x/y/no.md", "_x/hidden.txt", "x/.hidden.txt", "k=1/_a/hidden.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "a.txt" else name.encode())
    for path in (str(tmp_path), f"file:{tmp_path}/"):
        got = sorted(map(tuple, files.scan_scripts(spark, path).collect()))
        assert got == [("a.txt", tmp_path.name, ""), ("b.txt", "x", "x/b.txt"), ("c d.txt", "z", "x/y/z/c d.txt")]
    assert [r.script_text for r in files.scan_scripts(spark, f"{tmp_path}/x/*.txt").collect()] == ["x/b.txt"]
