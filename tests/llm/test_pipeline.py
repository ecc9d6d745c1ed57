import corpus_pipeline
from skald.llm import decontam, langid, linededup, simhash
from skald.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(7001, None, None, None, None), (7002, "12 34", "en", "s", 5), (7003, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if name != "pack":
            assert seen[-1].columns == list(corpus_pipeline.COLUMNS)
    start, lang, lines, near, clean, packed = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert ids(start) - ids(lang) == {7001, 7002, 7003}
    # no line is left that has an earlier near copy, and nothing else went
    assert linededup.removals(lines, Scratch(spark, "t")).isEmpty()
    # the least of each group stays
    groups = simhash.near_duplicates(lines, Scratch(spark, "t")).collect()
    assert ids(near) == {r.component_id for r in groups}
    assert ids(clean) == {r.doc_id for r in decontam.contamination(near, spark.read.parquet(f"{SF}/benchmark.parquet"), Scratch(spark, "t")).collect() if not r.contaminated}
    assert ids(packed) == ids(clean) and packed.count() >= clean.count()
    assert langid.reject(docs.limit(0), langid.learn(docs.limit(0))).count() == 0


def test_near_dedup_of_null_and_shared_ids(spark):
    word = lambda k: " ".join(f"{k}{chr(97 + i % 26)}{i}" for i in range(60))
    a, b, c, d, e = map(word, "abcde")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (None, c), (8, e), (8, e), (7, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (3, d), (7, e)], key=str)


def test_documents_of_white_space_go(spark):
    """A document whose only line is another's keeps blank lines and tabs at most: it goes, and one with a word left stays."""
    line = "the very same long line of a good number of words that stands in several of the documents"
    rows = [(1, line), (2, line + "\n"), (3, "\t\n" + line + "\n \x0b"), (4, line + "\nits own"), (5, "another line altogether, with nothing of the others in it")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()} == {1, 4, 5}
