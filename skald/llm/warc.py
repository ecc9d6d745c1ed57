"""WARC archives: writing captures, reading records, assembling transactions.

Each capture is three records: a response (or a revisit of one with an equal payload), its request and its metadata,
which name the response in WARC-Concurrent-To. ``write`` is Spark SQL alone: a record is text that ends in a blank
line, which is how the text sink ends its rows, so every part file is a WARC archive. ``read`` parses archives by
Content-Length in Arrow batches, one bounded archive at a time. ``assemble`` joins the records of a capture through
their concurrent-to identifiers.

Null html is an empty payload; null urls are written as empty targets. Rows that are equal in page_id, url and html
are as many equal captures, and come back as many. Of equal payloads, all rows with the largest page_id are responses;
a null page_id counts as smaller than any. Empty tables give empty archives and no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skald.llm.common import Scratch, size_of

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Payloads from this size on are stored once and revisited.
REVISIT_BYTES = 0
#: Bytes of payload in an archive and records in one, at most; a larger payload has an archive of its own. Bounds what one task holds.
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 1500
#: Bytes of repeated digests, with the page and url of their responses, that are broadcast at most.
BROADCAST = 64 << 20
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 SHA-1: four times ten hexadecimal digits are eight base-32 digits."""
    h = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", RFC4648)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*parts)))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def captures(pages: DataFrame, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as captures: page_id, url, payload, digest, bytes, id (of the response record), refers_to, refers_id.

    Payloads that occur once need no partner, so only repeated digests are joined: broadcast while there are at most
    ``BROADCAST`` bytes, which leaves the payloads unshuffled, and by shuffle beyond.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    key = rows.select("digest", "page_id", "url", "bytes").where(F.col("bytes") >= revisit_bytes)
    # the url breaks ties between rows of one page_id
    group = key.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.keep(group.where("n > 1").drop("n"), "repeated")
    out = rows.join(F.broadcast(first) if size_of(first) <= BROADCAST else first, "digest", "left")
    identity = lambda page, url: _urn(F.lit("response"), page.alias("p"), url.alias("u"), F.col("digest"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select(
        "page_id", "url", "payload", "digest", "bytes", identity(F.col("page_id"), F.col("url")).alias("id"),
        F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, identity(F.col("first.page_id"), F.col("first.url"))).alias("refers_id"),
        F.when(again, F.col("first.url")).alias("refers_url"),
    )


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(END), block)


def records(caps: DataFrame) -> DataFrame:
    """A row ``value`` for each record."""
    visit = F.col("refers_id").isNotNull()
    uri = F.regexp_replace("url", r"[\x00-\x20]", "")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\x00-\x20]*)", 1)
    path = F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    id_of = lambda kind: _urn(F.lit(kind), F.col("id"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    response = _record(
        [
            ("WARC-Type", F.when(visit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", F.col("id")), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(visit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.col("refers_id")),
            ("WARC-Refers-To-Target-URI", F.when(visit, F.regexp_replace("refers_url", r"[\x00-\x20]", ""))), ("Content-Type", "application/http; msgtype=response"),
        ],
        F.concat(head, F.when(visit, F.lit("")).otherwise(F.col("payload"))),
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", id_of("request")), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", id_of("metadata")), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("pageId: "), number(F.col("page_id")), F.lit("\r\nrefersToPage: "), number(F.col("refers_to")), F.lit("\r\n")),
    )
    return caps.select(F.explode(F.array(response, request, metadata)).alias("value"))


def write(caps: DataFrame, path: str) -> None:
    """Archives of bounded size, as the part files of ``path``: captures of a size class are written together."""
    per_record = ARCHIVE_BYTES * 3 // ARCHIVE_RECORDS  # a capture is three records
    limits = [per_record << 4 * k for k in range(4)]
    rank = F.lit(0)
    for limit in limits:
        rank = rank + (F.col("bytes") > limit).cast("int")
    for k in sorted(r[0] for r in caps.select(rank).distinct().collect()) or [0]:  # len(limits) + 1 rows at most
        most = ARCHIVE_RECORDS >> 4 * k
        records(caps.where(rank == k)).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, most)).text(path)


RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_id string, target_uri string, payload_digest string, payload_bytes long, "
    "payload string, fields map<string,string>"
)


def parse(archive: bytes, payload: bool = True) -> Iterator[dict]:
    """The records of one archive; digest and size of a payload that is there are taken from its bytes."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = archive[end + 4 : end + 4 + int(head["content-length"])]
        at = end + 4 + len(block) + 4
        kind = head["warc-type"]
        out = {"record_type": kind, "record_id": head["warc-record-id"], "concurrent_to": head.get("warc-concurrent-to"), "refers_id": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "payload_digest": None, "payload_bytes": None, "payload": None, "fields": None}
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                out |= {"payload": body.decode("utf-8") if payload else None, "payload_bytes": len(body), "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
            else:  # a revisit has the headers of the full response
                length = next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                out |= {"payload_bytes": int(length), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
        elif kind == "metadata":
            out["fields"] = {k: v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n") if x)}
        elif payload:
            out["payload"] = block.decode("utf-8")
        yield out


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives of ``path``; without ``payload`` the bodies stay behind when digests are taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = list(parse(content, payload))
                if rows:
                    out = pd.DataFrame(rows)
                    out["payload_bytes"] = out["payload_bytes"].astype("Int64")
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One row per capture: record_id, n (equal captures), response, request and metadata.

    Requests and metadata may name the response, or the response them; metadata may name the request.
    """
    names = [c for c in recs.columns if c != "concurrent_to"]
    main = F.col("record_type").isin("response", "revisit")
    nested = F.struct(*names).alias("r")
    own = recs.where(main).select(F.col("record_id").alias("capture"), F.col("concurrent_to").alias("named"), nested)
    side = recs.where(~main).select("record_id", "concurrent_to", nested)
    of_main = own.select("capture").distinct()
    direct = side.join(of_main, side.concurrent_to == of_main.capture).select("capture", "r")
    # the other way round, and in two steps
    back = own.where("named is not null").select("capture", "named").distinct()
    named = side.join(back, side.record_id == back.named).select("capture", "r")
    known = direct.union(named).where("r.record_type = 'request'").select("capture", F.col("r.record_id").alias("via"))
    steps = side.where("concurrent_to is not null").join(known.distinct(), F.col("concurrent_to") == F.col("via")).select("capture", "r")
    every = own.select("capture", "r").union(direct).union(named).union(steps)
    pick = lambda *kinds: F.min_by("r", F.when(F.col("r.record_type").isin(*kinds), F.col("r.record_id")))
    out = every.groupBy("capture").agg(
        F.count_if(F.col("r.record_type").isin("response", "revisit")).alias("n"), pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata")
    )
    return out.where("response is not null")
