"""Fuzzy line dedup by MinHash.

Lines are the \\n-separated parts of a text with a character that isn't white space. Equal lines are one node. A node's
signature holds the least hash of its long character shingles (``LONG``) in each of 24 residue classes (one-permutation
MinHash); an empty class takes that of the next. Triples of classes are the bands, and a pair of a band is a candidate
if it also agrees in most of 21 short lanes of the signature. Candidates are verified by exact Jaccard similarity of
their short shingles (``SHINGLE``), linked by distributed union-find, and of each component the line that comes first by
(doc_id, line) stays. Short shingles let short lines with a changed character be linked; long ones keep unrelated lines
out of each other's bands. Lines at the threshold have a similarity of 0.67 or more in long shingles, at which bands and
lanes together find 0.978 of them, and 0.99 at 0.7.

Bands of up to ``PAIRWISE`` nodes are compared pairwise. Members of a larger band are compared with its centre, the
member with most company in such bands, and then all that is outside the band's largest component with all other
components, as far as odd sketches of their shingles leave room for the similarity: no link of a band is lost, and a
group of near copies isn't expanded into its pairs.

Null texts have no lines and stay null; repeated rows and ids with several texts are told apart by the text's digest,
equal rows get equal results; null ids sort first. A text of any length is cut into its lines, and a line of any length
is one row. Empty tables give empty results. Lines are named by their 64-bit hash, texts by theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skald.llm.common import Scratch, let, maybe
from skald.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Characters of the shingles that signatures are made of.
LONG = 8
CLASSES = 24
#: Hashes expected in a class: of the shingles of a long line, only so many of the least hashes are looked at.
DEPTH = 2
#: Two triples share one class at most.
BANDS = [[i, i + 8, i + 16] for i in range(8)] + [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(6)]
#: Three-bit lanes of a signature in a long, and how many a candidate agrees in at least.
LANES = 21
AGREE = 9
#: The same between a centre and what is linked to it first; whoever isn't is compared with all others later.
AGREE_CENTRE = 13
NONE = 2**31 - 1
LANE_ENDS = sum(1 << 3 * k for k in range(LANES))
PAIRWISE = 8
#: 64-bit words of a sketch.
WORDS = 16


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""  # ends at the first other character


def _starts(b: Column, n: int, width: int) -> Column:
    """Where the shingles of ``n`` characters of ``width`` bytes begin; a shorter line is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(b) - width * n + 1), F.lit(width))


def shingle_hashes(line: Column) -> Column:
    """Hashes of the character shingles, by position; in UTF-32 a shingle is a byte range, found without counting characters."""
    piece = lambda b, i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE)))
    return let(F.encode(line, "UTF-32"), lambda b: F.transform(_starts(b, SHINGLE, 4), lambda i: piece(b, i)))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, no, line, node): every line; node is the 64-bit hash of the line."""
    # made with the row of the text: a digest projected from it would be worked out again for every line
    texts = docs.select(F.inline(F.array(F.struct("doc_id", F.xxhash64("text").alias("digest"), split_lines(F.col("text")).alias("lines")))))
    lines = texts.select("doc_id", "digest", F.posexplode("lines").alias("no", "line")).where(_has_word(F.col("line")))
    return lines.select("doc_id", "digest", F.inline(F.array(F.struct("no", "line", F.xxhash64("line").alias("node")))))


def signatures(docs: DataFrame) -> DataFrame:
    """(node, often, m0..m23): how often the line occurs, and the least shingle hash in each residue class, ``NONE`` where there is none.

    Places are exploded rather than hashed in a lambda: cutting, hashing and the partial minima are one compiled loop.
    Shingles are of UTF-16 units, all but rare characters.
    """
    lines = docs.select(F.explode(split_lines(F.col("text"))).alias("line")).where(_has_word(F.col("line")))
    limit = lambda b: F.least(F.lit(2.0**31 - 1), 2.0**31 * DEPTH * CLASSES / F.greatest(F.lit(1), F.octet_length(b) / 2 - LONG + 1)).cast("int")
    # made with the row of the line: a column projected from it would be worked out again for every shingle
    each = lines.select(F.xxhash64("line").alias("node"), F.encode("line", "UTF-16BE").alias("b"))
    each = each.select(F.inline(F.array(F.struct("node", "b", limit(F.col("b")).alias("limit")))))
    at = each.select("node", "b", "limit", F.explode(_starts(F.col("b"), LONG, 2)).alias("i"))
    h = at.select("node", "i", "limit", F.xxhash64(F.substring("b", F.col("i"), F.lit(2 * LONG))).alias("h")).withColumn("v", F.shiftrightunsigned("h", 33).cast("int"))
    h = h.where("v < limit or i = 1").select("node", (F.col("i") == 1).cast("int").alias("first"), "v", F.pmod("h", F.lit(CLASSES)).cast("int").alias("class"))
    # with filters a row updates the class it is of, and no other
    return h.groupBy("node").agg(F.sum("first").alias("often"), *(F.expr(f"coalesce(min(v) filter (where class = {k}), {NONE})").alias(f"m{k}") for k in range(CLASSES)))


def bands(sigs: DataFrame) -> DataFrame:
    """(band, node, lanes, n, low, high): the members of bands of two or more, with the least and the greatest of them.

    A band of two is one row, that of the least, and is left out if the two don't agree. A line that occurs more than
    once has a band of its own, of which low and high are that line.
    """
    ms = [f"m{k}" for k in range(CLASSES)]
    for step in (1, 2, 4, 8, 16):  # an empty class takes the next that isn't
        sigs = sigs.select("node", "often", *(F.expr(f"if({c} < {NONE}, {c}, {ms[(k + step) % CLASSES]})").alias(c) for k, c in enumerate(ms)))
        if step == 8:  # a lambda ends the compiled stage: the JVM interprets methods as long as that of all steps would be
            sigs = sigs.select("node", "often", F.transform(F.array(*ms), lambda x: x).alias("m")).select("node", "often", *(F.coalesce(F.get("m", F.lit(k)), F.lit(NONE)).alias(c) for k, c in enumerate(ms)))
    lane = lambda k: F.call_function("shiftleft", F.col(ms[k]).bitwiseAND(7).cast("long"), F.lit(3 * k))
    lanes = lane(0)
    for k in range(1, LANES):
        lanes = lanes.bitwiseOR(lane(k))
    own = F.when(F.col("often") > 1, F.xxhash64(F.lit(-1), F.col("node")))
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(ms[k]) for k in b)) for i, b in enumerate(BANDS)), own, own)
    # lanes are made before the bands, once a line, and no key twice: the loop stays within what the JVM compiles
    rows = sigs.withColumn("lanes", lanes).select("node", "lanes", F.explode(keys).alias("band")).where("band is not null")
    # most bands have one member: sorted once they cost less than in the tables of an aggregate and of a join with it
    of = Window.partitionBy("band")
    size = [F.count(F.lit(1)).over(of).alias("n"), F.min("node").over(of).alias("low"), F.max("node").over(of).alias("high"), F.bit_xor("lanes").over(of).alias("x")]
    pair = (F.col("n") == 2) & (F.col("node") == F.col("low")) & _agree(F.col("x"))
    return rows.select("band", "node", "lanes", *size).where((F.col("n") > 2) | pair).drop("x")


def _agree(x: Column, least: int = AGREE) -> Column:
    """Whether two signatures agree in enough lanes; ``x``: their lanes, combined by exclusive or."""
    differs = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(LANE_ENDS))
    return F.bit_count(differs) <= LANES - least


def sketches(texts: DataFrame) -> DataFrame:
    """(node, size, b0..b15): the number of distinct shingles, and the odd sketch of their hashes.

    Each shingle flips one bit. The sketches of two sets differ in no more bits than the sets in elements, however
    large the sets: a pair that differs in more bits than sets of that similarity in elements is discarded, and no other.
    """
    # sets are made in a projection and not in the generator; without outer a filter on their size would make them once more
    h = texts.select("node", _sets(F.col("line")).alias("hs")).select("node", F.explode_outer("hs").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    each = h.select("node", F.shiftright("h", 6).bitwiseAND(WORDS - 1).cast("int").alias("word"), bit.alias("bit"))
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *(F.expr(f"coalesce(bit_xor(bit) filter (where word = {k}), 0L)").alias(f"b{k}") for k in range(WORDS)))


def _sketch(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("size", *(f"b{k}" for k in range(WORDS)))]


def _may_link(x: str, y: str) -> Column:
    """Whether sketches with these prefixes leave room for the similarity."""
    differ = sum((F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}"))) for k in range(1, WORDS)), F.bit_count(F.col(f"{x}b0").bitwiseXOR(F.col(f"{y}b0"))))
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    room = (1 - SIMILARITY) / (1 + SIMILARITY) * (a + b)
    return (F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-6) & (differ <= room + 1e-6)


def likely(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(a, b, size, sizes) of the pairs that sketches leave room for; size: of a's set, sizes: both together, null without a sketch."""
    side = lambda c, p: drawn.select(F.col("node").alias(c), *_sketch(p))
    both = pairs.join(side("a", "x_"), "a", "left").join(side("b", "y_"), "b", "left")
    return both.where(F.coalesce(_may_link("x_", "y_"), F.lit(True))).select("a", "b", F.col("x_size").alias("size"), (F.col("x_size") + F.col("y_size")).alias("sizes"))


def _sets(line: Column) -> Column:
    return F.array_distinct(shingle_hashes(line))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, size, sizes) of nodes whose shingle sets have Jaccard similarity SIMILARITY or more; sizes as in ``likely``."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size", "sizes", shingle_hashes(F.col("ta")).alias("x"), shingle_hashes(F.col("tb")).alias("y"))
    # a generator's output isn't worked out again by the filter: hashes are made once a pair
    both = both.select("a", "b", F.inline(F.array(F.struct("size", "sizes", "x", "y"))))
    a = F.coalesce("size", F.size(F.array_distinct("x")))
    b = F.coalesce(F.col("sizes") - F.col("size"), F.size(F.array_distinct("y")))
    # with d elements that only x has, the intersection is a - d: (a - d) / (b + d) >= SIMILARITY; a difference takes one set
    # where an intersection takes two, and has repeated hashes once
    return both.where(a - F.size(F.array_except("x", "y")) * (1 + SIMILARITY) >= SIMILARITY * b - 1e-6).select("a", "b")


def _centres(large: DataFrame) -> DataFrame:
    """(_band, a, _lanes): of each band the member with most company, the least of those."""
    top = large.groupBy("band").agg(F.max("company").alias("company"))
    least = large.join(top, ["band", "company"]).groupBy("band").agg(F.min("node").alias("node"))
    return large.join(least, ["band", "node"]).select(F.col("band").alias("_band"), F.col("node").alias("a"), F.col("lanes").alias("_lanes"))


def links(members: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes that are linked to another. ``members``: bands(); ``lines``: (node, line) of all of them."""
    pair = members.where("n = 2 and low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    small = members.where((F.col("n") > 2) & (F.col("n") <= PAIRWISE))
    other = small.select(F.col("band").alias("_band"), F.col("node").alias("b"), F.col("lanes").alias("_lanes"))
    near = _agree(F.col("lanes").bitwiseXOR(F.col("_lanes")))
    pairs = pair.union(small.withColumnRenamed("node", "a").join(other, (F.col("band") == F.col("_band")) & (F.col("a") < F.col("b")) & near).select("a", "b"))
    large = members.where(F.col("n") > PAIRWISE).select("band", "node", "lanes", "n")
    # the member with most company is the likeliest to be near all others of a group of copies
    company = large.groupBy("node").agg(F.sum("n").alias("company"), F.sort_array(F.collect_list("band")).alias("bands"))  # as many as BANDS at most
    large = scratch.keep(large.join(company, "node"), "large")
    nearer = _agree(F.col("lanes").bitwiseXOR(F.col("_lanes")), AGREE_CENTRE)
    stars = large.join(_centres(large), (F.col("band") == F.col("_band")) & (F.col("node") != F.col("a")) & nearer)
    pairs = scratch.keep(pairs.union(stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    texts = scratch.keep(lines.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "line"), "texts")
    drawn = scratch.keep(sketches(texts.join(large.select("node").distinct(), "node", "left_semi")), "sketches")
    comp = components(scratch.keep(verify(likely(pairs, drawn), texts), "links"), scratch)
    if large.isEmpty():
        return comp
    # whatever is outside a band's largest component is compared with all members of other components
    named = large.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")).select("band", "node", "lanes", "bands", "root")
    sizes = named.groupBy("band", "root").count()
    main = sizes.groupBy("band").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    named = scratch.keep(named.join(main, "band").join(drawn, "node"), "named")
    of = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("band", "lanes", "bands", "root", "main")]
    rest = named.where("root <> main").select(*of("_"), F.col("node").alias("a"), *_sketch("y_"))
    # two outsiders meet once, and a pair in the first of its bands
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("a"))
    first = F.element_at(F.array_intersect("bands", "_bands"), 1) == F.col("band")
    met = named.join(rest, (F.col("band") == F.col("_band")) & (F.col("root") != F.col("_root")) & once & near & _may_link("", "y_") & first)
    met = met.select("a", F.col("node").alias("b"), F.col("y_size").alias("size"), (F.col("size") + F.col("y_size")).alias("sizes"))
    found = scratch.keep(verify(met, texts), "links")
    if found.isEmpty():
        return comp
    # components so far are stars: nothing found before needs to be linked again
    return components(comp.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), scratch)


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, removed): for texts with duplicate lines, the array of (no, keep_doc_id, keep_no) that go."""
    members = scratch.keep(bands(signatures(docs)), "bands")
    # lines that share no band are unlike all others
    met = members.select("node").union(members.where("n = 2").select(F.col("high").alias("node")))
    lines = occurrences(docs)
    lines = scratch.keep(lines.where(maybe(met, "node", scratch)(F.col("node"))), "lines")
    comp = links(members, lines, scratch)
    again = members.where("low = high").select("node").distinct().join(comp.select("node"), "node", "left_anti")
    classes = comp.select("node", "root").union(again.select("node", F.col("node").alias("root")))
    named = scratch.keep(lines.join(classes, "node").select("root", "doc_id", "digest", "no"), "named")
    place = F.struct("doc_id", "no", "digest")
    keep = named.groupBy("root").agg(F.min(place).alias("keep"))
    gone = named.join(keep, "root").where(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.no").alias("keep_no")))).alias("removed"))


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``text`` less its duplicate lines, and ``removed_lines``, the array of what went."""
    names = docs.columns
    # columns of hashes, nearly all different: as a dictionary they would be looked up all over it
    scratch.options["parquet.enable.dictionary"] = "false"
    gone = scratch.keep(removals(docs, scratch), "removed").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.col("removed").alias("removed_lines"))
    # texts that keep all their lines aren't shuffled
    touched = F.coalesce(maybe(gone, "_digest", scratch)(F.xxhash64("text")), F.lit(False))
    # the digest as a column: the exchange, the sort and the join would each work it out
    named = docs.where(touched).withColumn("_at", F.xxhash64("text"))
    found = named.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_digest")), "left")
    numbers = F.transform("removed_lines", lambda r: r["no"])
    stay = lambda a: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), numbers)
    left = let(split_lines(F.col("text")), lambda a: F.array_join(F.transform(stay(a), lambda k: F.get(a, k)), "\n"))
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(left)
    out = found.select(*(text.alias("text") if c == "text" else F.col(c) for c in names), "removed_lines")
    return out.union(docs.where(~touched).select(*names, F.lit(None).cast(out.schema["removed_lines"].dataType).alias("removed_lines")))
