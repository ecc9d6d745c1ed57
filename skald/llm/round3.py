"""Registered queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skald.llm import collocations, merkle, toxicity
from skald.llm.common import Scratch, table


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest of all, and whether it holds after tampering."""
    return merkle.manifest(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"


#: Levels that the SQL writes out: trees of up to 16^5 nodes.
LEVELS = range(5)
#: crc32 of a text of ASCII characters, bit by bit.
CRC = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::bigint), lambda a, b: "
    "list_reduce(range(0, 8), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(a, b)), 4294967295), 4294967295)"
)
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEAF = f"{_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || "


def _tree(nodes: str, rows: str, p: str) -> str:
    """Levels of the trees of ``nodes`` (tree, pos, n, h), folding ``rows`` (rid, tree, pos, fold, sib): {p}top and {p}rows."""
    parts = [f"{p}s0 as (select tree, pos, n, h from {nodes})", f"{p}f0 as (select rid, tree, pos, fold, sib from {rows})"]
    for k in LEVELS:
        parts.append(f"{p}r{k} as (select tree, pos // 16 run, n, string_agg(h, '' order by pos) nodes from {p}s{k} where n > 1 group by tree, run, n)")
        parts.append(f"{p}s{k + 1} as (select tree, run pos, (n + 15) // 16 n, sha256(nodes) h from {p}r{k} union all select tree, pos, n, h from {p}s{k} where n = 1)")
        cut = "substr(nodes, 1, cast(pos % 16 * 64 as bigint))", "substr(nodes, cast(pos % 16 * 64 + 65 as bigint))"
        parts.append(
            f"{p}f{k + 1} as (select rid, f.tree, case when nodes is null then pos else pos // 16 end pos, case when nodes is null then fold else sha256({cut[0]} || fold || {cut[1]}) end fold, "
            f"case when nodes is null then sib else sib || {cut[0]} || {cut[1]} end sib from {p}f{k} f left join {p}r{k} r on r.tree = f.tree and r.run = f.pos // 16)"
        )
    return ", ".join(parts)


OP11_SQL = (
    f"with l0 as (select row_number() over () rid, doc_id, source, sha256({LEAF}{_field('text')}) leaf, case when {CRC.format('doc_id::varchar')} % 5 = 0 then sha256({LEAF}{_field(LOWER)}) end tampered from documents), "
    "l1 as (select *, dense_rank() over (order by source is not null, encode(coalesce(source, ''))) - 1 tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by source) n from l0), "
    "leaf as (select tree, pos, n, leaf h from l1), start as (select rid, tree, pos, coalesce(tampered, leaf) fold, '' sib from l1), "
    + _tree("leaf", "start", "a")
    + f", sub as (select 0 tree, tree pos, count(*) over () n, h from as{len(LEVELS)}), mid as (select rid, 0 tree, tree pos, fold, sib from af{len(LEVELS)}), "
    + _tree("sub", "mid", "b")
    + f" select doc_id, leaf, s.h subroot, t.h root, sha256(f.sib) proof_sha256, f.fold folded_root, f.fold = t.h verified from l1 join as{len(LEVELS)} s on s.tree = l1.tree join bf{len(LEVELS)} f on f.rid = l1.rid, bs{len(LEVELS)} t"
)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by the score of their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


OP12_SQL = r"""
with t as (select row_number() over () rid, coalesce(lang, 'und') lang, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+', ' ' || chr(10) || ' ', 'g'), '[\x20\x09]+') w from documents),
o as (select rid, lang, unnest(w) w1, unnest(range(len(w))) p from t),
g as (select lang, w1, lead(w1, 1) over x w2, lead(w1, 2) over x w3, lead(w1, 3) over x w4, lead(w1, 4) over x w5 from o where w1 <> '' window x as (partition by rid order by p)),
h as (select lang, w1, case when w2 <> chr(10) then w2 end w2, case when w2 <> chr(10) and w3 <> chr(10) then w3 end w3, case when w2 <> chr(10) and w3 <> chr(10) and w4 <> chr(10) then w4 end w4,
 case when w2 <> chr(10) and w3 <> chr(10) and w4 <> chr(10) and w5 <> chr(10) then w5 end w5 from g where w1 <> chr(10)),
f as (select lang, w1 phrase, 1 k, count(*) f from h group by all union all select lang, w1 || ' ' || w2, 2, count(*) from h where w2 is not null group by all
 union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from h where w3 is not null group by all union all select lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) from h where w4 is not null group by all
 union all select lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5, count(*) from h where w5 is not null group by all),
n as (select lang, cast(sum(f) as bigint) n from f where k = 1 group by lang),
c as (select lang, phrase, k, f a, string_split(phrase, ' ') w from f where k >= 2 and f >= 100),
sub as (select lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) most from (select lang, w, a, k, unnest(range(2, k)) m from c) , lateral (select unnest(range(1, k - m + 2)) i) group by all),
s as (select c.* from c left join sub using (lang, phrase) where most is null or 100 * most < 100 * a),
q as (select s.lang, s.phrase, a, n, j, l.f l, r.f r, cast(1000 as hugeint) * a * n // (cast(l.f as hugeint) * r.f) score from (select *, unnest(range(1, k)) j from s) s join f l on l.lang = s.lang and l.phrase = array_to_string(w[:j], ' ')
 join f r on r.lang = s.lang and r.phrase = array_to_string(w[j + 1:], ' ') join n on n.lang = s.lang),
b as (select * from q qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, cast(score as bigint) score from b qualify rank <= 2000
"""


def op13_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of labelled ones outside the held-out fold, and its offending sentences."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.learn(toxicity.learning_rows(docs), table(spark, sf_dir, "labels")))
    cells = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"), cells.alias("offending"))


QUERIES = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_toxicity_instances": op13_toxicity_instances,
}
SQL = {"op11_merkle_manifest": OP11_SQL, "op12_phrase_collocations": OP12_SQL}
