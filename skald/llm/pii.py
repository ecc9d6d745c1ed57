"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score.

One pass over each whole text in Arrow batches; offsets are code points. The base kinds (email, ip, card, phone) are
kept whatever their score; the further kinds only if their score reaches ``THRESHOLD``. Patterns are possessive or start
from the one character that a match can't lack, so that a text of any length is searched in linear time. Null and empty
texts have no spans, a row comes back for every row, equal rows alike, and other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.6
#: Code points on either side in which context words count, and what one adds.
REACH = 48
CONTEXT = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


#: Characters of an account number by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23,
    GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30,
    NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")


def _pattern(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as its characters go, to the last match or the last @."""
    least = 0
    at = text.find("@")
    while at >= 0:
        start = least + len(text[least:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        least = at + 1
        if found:
            yield start, found.end()
            least = found.end()
        at = text.find("@", least)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A country's account number has one length; blanks may stand between its characters."""
    for m in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTH.get(m[1])
        tail = re.compile(rf"(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])").match(text, m.end()) if length else None
        if tail:
            yield m.start(), tail.end()


@dataclass(frozen=True)
class Kind:
    """``hint``: a character that every match holds; texts without it aren't searched. ``score``: of a confirmed span."""

    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    confirm: Callable[[str], bool]
    score: float
    hint: str | None = None
    words: frozenset[str] = field(default_factory=frozenset)
    base: bool = True


KINDS = (
    Kind("email", _emails, lambda s: True, 0.9, "@", frozenset({"email", "mail", "contact", "write"})),
    Kind("ip", _pattern(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split(".")), 0.7, ".", frozenset({"ip", "address", "host", "server"})),
    Kind("card", _pattern(r"[0-9]++(?:[\x20-][0-9]++)*+"), _card, 0.7, None, frozenset({"card", "credit", "debit", "visa", "mastercard", "payment"})),
    Kind("phone", _pattern(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(_digits(s)) <= 15, 0.7, "+", frozenset({"phone", "call", "tel", "mobile", "fax"})),
    Kind("iban", _ibans, lambda s: mod97(s.replace(" ", "")), 0.8, None, frozenset({"iban", "account", "bank", "transfer", "konto"}), False),
    Kind("ssn", _pattern(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn, 0.4, "-", frozenset({"ssn", "social", "security"}), False),
)
_DIGIT = re.compile("[0-9]")
_WORD = re.compile("[a-z]+")


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then by start."""
    found = []
    if not text:
        return found
    digit = _DIGIT.search(text)
    for kind in KINDS:
        if (kind.hint and kind.hint not in text) or (kind.name != "email" and digit is None):
            continue
        for a, b in kind.find(text):
            if not kind.confirm(text[a:b]):
                continue
            near = set(_WORD.findall(text[max(0, a - REACH) : a].lower())) | set(_WORD.findall(text[b : b + REACH].lower()))
            score = min(1.0, kind.score + CONTEXT * bool(near & kind.words))
            if kind.base or score >= THRESHOLD:
                found.append((kind.name, a, b, round(score, 2)))
    return found


BASE = tuple(k.name for k in KINDS if k.base)
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": each})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans as a string and the least score."""
    cell = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), cell), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", cell), ",").alias("spans"), F.array_min(F.transform("spans", lambda s: s["score"])).alias("least_score"))
