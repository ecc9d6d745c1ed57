"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skald.llm import consensus, decontam, langid, linededup, packing, pii, quality, round3, rules, simhash, warc
from skald.llm.common import SPACE, Scratch, table


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(langid.learning_rows(docs)))
    return langid.held_out(found).select("doc_id", "held_out", "lang_pred", "score")


def op7_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.learn(quality.learning_rows(docs), table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all rules over whole texts, stored, and the strict policy's verdict."""
    stored = Scratch(spark, "op9").keep(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    led = rules.apply_policy(rules.apply_policy(stored, rules.BASE, "_base"), rules.STRICT)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failed_bits")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two versions of the policy rejects, alone and in all: both read one stored ledger."""
    stored = Scratch(spark, "op9").keep(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    return rules.ablation(stored, rules.STRICT_2).union(rules.ablation(stored, rules.STRICT))


OP9_LEDGER = r"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) wl from d),
m as (select *, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars,
 len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(wl) - len(list_distinct(wl)) n_dup_lines,
 len(string_split(t, chr(10))) n_lines, len(regexp_extract_all(t, '!')) n_shouts, len(regexp_extract_all(t, '[A-Z]')) n_upper, len(regexp_extract_all(t, '[0-9]')) n_digits,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) n_bullets from w),
g as (select rid, unnest(range(1, len(w) - 1)) p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) g from m where len(w) >= 3),
r as (select rid, count(distinct p + k) n from (select rid, p, count(*) over (partition by rid, g) c from g), (values (0), (1), (2)) o(k) where c > 1 group by rid),
f as (select m.*, coalesce(r.n, 0) n_repeat_words from m left join r using (rid)),
b as (select *, cast(n_words < 50 as int) + 2 * cast(100 * n_repeat_words > 50 * n_words as int) + 4 * cast(5 * n_symbols > n_words as int)
 + 8 * cast(2 * n_dup_lines > n_lines as int) + 16 * cast(2 * n_shouts > n_words as int)
 + 32 * cast(word_chars < 2 * n_words or word_chars > 15 * n_words as int) + 64 * cast(2 * n_upper > word_chars as int)
 + 128 * cast(2 * n_digits > word_chars as int) + 256 * cast(10 * n_bullets > 9 * n_lines as int) failed_bits from f)
"""
OP9_SQL = OP9_LEDGER + """select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
 cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, failed_bits & 3 != 0 base_failed,
 failed_bits = 0 kept, cast(failed_bits as bigint) failed_bits from b
"""
OP9_ABLATION_SQL = OP9_LEDGER + """, p(policy, mask) as (values ('strict-2', 127), ('strict-3', 511)),
rb(rule, bit) as (values ('too_short', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('exclamations', 16), ('word_length', 32), ('shouting', 64), ('digits', 128), ('bullets', 256))
select policy, rule, count(*) filter (failed_bits & bit != 0) n_failed, count(*) filter (failed_bits & mask = bit) n_only,
 count(*) filter (failed_bits & mask & ~bit = 0) n_kept_without, count(*) n_docs from b, p, rb where bit & mask != 0 group by policy, rule
"""


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a capture for every page, reads the archives back and assembles their transactions."""
    scratch = Scratch(spark, "op1")
    path = scratch.path("archives")
    warc.write(warc.captures(table(spark, sf_dir, "pages"), scratch), path)
    records = scratch.keep(warc.read(spark, path, payload=False), "records")
    scratch.remove(path)
    found = warc.assemble(records)
    number = lambda name: F.expr(f"try_cast(nullif(metadata.fields['{name}'], '') as bigint)")
    return found.select(
        number("pageId").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), number("refersToPage").alias("refers_to"), F.col("request.target_uri").alias("request_uri"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy"),
    ).drop("_copy")


OP1_SQL = r"""
with p as (select page_id, url, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) s from pages),
d as (select *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(s, i + 1, 1)) - 1) x from p),
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  cast(1 + (((x[(5 * i) // 4 + 1] * 16 + x[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) as bigint), 1)), '') payload_digest from d),
f as (select *, max(page_id) over (partition by payload_digest) last from b)
select page_id, cast(n as bigint) payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end record_type,
 case when page_id <> last then last end refers_to, url request_uri from f
"""


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document: its lines that are near copies of a line that comes first."""
    found = linededup.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    lines = F.size(F.filter(linededup.split_lines(F.col("text")), lambda x: F.ltrim(x, F.lit(SPACE)) != ""))
    cells = F.transform("removed_lines", lambda r: F.concat_ws(":", r["no"], r["keep_doc_id"], r["keep_no"]))
    return found.select(
        "doc_id", F.coalesce(lines, F.lit(0)).cast("long").alias("n_kept"), F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(cells, ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's winning path."""
    pages = table(spark, sf_dir, "pages")
    return consensus.extract(pages, Scratch(spark, "op3").keep(consensus.votes(pages), "paths"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items they are from."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))
    items = F.size("item_ids").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", items, F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
with dw as (select row_number() over () rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select cast(item_id as varchar) item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(10, len(w)) n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) win
  from iw where len(w) > 0),
dg as (select rid, n, unnest(range(1, len(w) - n + 2)) p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) win
  from dw, (select distinct n from win) where len(w) >= n),
occ as (select distinct rid, p, dg.n, item_id from dg join win using (win, n)),
hit as (select rid, count(distinct p + k) n_hit from (select rid, p, unnest(range(0, n)) k from occ) group by rid),
its as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from occ group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
 sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit using (rid) left join its using (rid)
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_transactions": op1_warc_transactions,
        "op2_fuzzy_line_dedup": op2_fuzzy_line_dedup,
        "op3_html_consensus": op3_html_consensus,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_pii_spans": op5_pii_spans,
        "op6_language_id": op6_language_id,
        "op7_cutting_stock_packing": op7_cutting_stock_packing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "quality_rule_ablation": quality_rule_ablation,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    } | round3.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_transactions": OP1_SQL, "op4_benchmark_decontamination": OP4_SQL, "op9_quality_rules": OP9_SQL, "quality_rule_ablation": OP9_ABLATION_SQL} | round3.SQL
