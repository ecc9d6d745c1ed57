"""Text expressions: replacing with a function of the match, numbers in words, the spoken forms of written English."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from skald import dimensions as D

# Number words, months, units and the speaking of URLs.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
CARDINALS = ONES + [f"{t}{'-' * (i > 0)}{ONES[i] if i else ''}" for t in TENS[2:] for i in range(10)]
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
MONTHS = "January February March April May June July August September October November December".split()
UNITS = {
    "km": "kilometers", "kg": "kilograms", "lb": "pounds", "lbs": "pounds", "mph": "miles per hour", "mile": "miles", "miles": "miles", "feet": "feet",
    "foot": "feet", "ft": "feet", "meter": "meters", "meters": "meters", "m": "meters", "cm": "centimeters", "mm": "millimeters",
}
URL_WORDS = [("https://", ""), ("http://", ""), ("www.", "w w w dot "), (".com", " dot com"), (".org", " dot org"), (".net", " dot net"), (".io", " dot i o"), ("/", " slash "), ("-", " dash "), ("_", " underscore ")]

#: A character that texts hardly have.
MARK = "\x01"
# Fixed grammar: what counts as an address, abbreviation, amount, share, time, measure, date, year and number.
AMOUNT = r"\d(?:[\d,]*\d)?(?:\.\d+)?"
URL = r"(?i)\b(?:https?://|www\.)\S+"
ABBREVIATION = r"(?i)(?=[MDPSAB])\b(Mr|Mrs|Ms|Dr|Prof|St|Ave|Blvd)\.(?=\s+(?-i:[A-Z]))"
MONEY = r"[$€£]" + AMOUNT
PERCENT = AMOUNT + r"\s*%"
TIME = r"\b\d{1,2}:\d{2}\b"
MEASURE = r"(?i)\b" + AMOUNT + r"\s*(?:km|kg|lbs?|mph|miles?|feet|foot|ft|meters?|m|cm|mm)\b"
DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b"
YEAR = r"\b(?:1[89]\d{2}|20\d{2})s?\b(?!\.?\d)"
NUMBER = r"(?<![\w.])-?" + AMOUNT + r"(?!\d)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_each(text: Column, pattern: str, spoken: Callable[[Column], Column]) -> Column:
    """Every match replaced by a function of it; texts without a match are left as they are."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spoken)
    # split compiles its pattern for every row, unless it is one character
    parts = F.when(text.contains(MARK), F.split(text, pattern)).otherwise(F.split(F.regexp_replace(text, pattern, MARK), MARK))
    joined = F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def pick(words: list[str], i: Column) -> Column:
    """The word at place ``i``; one literal that is split, as arrays of literals make very large plans."""
    return F.get(F.split(F.lit(",".join(words)), ","), i.cast("int"))


def _hundred(n: Column) -> Column:
    """0..99, from one list."""
    return pick(CARDINALS, n)


def _thousand(n: Column) -> Column:
    """1..999."""
    return F.concat_ws(" ", F.when(n >= 100, F.concat(pick(ONES, F.floor(n / 100)), F.lit(" hundred"))), F.when(n % 100 > 0, _hundred(n % 100)))


def whole_words(digits: Column) -> Column:
    """Cardinal of a text of digits of any length: groups of three, with a billion after every third."""

    def spell(bare: Column) -> Column:
        m = F.ceil(F.length(bare) / 3)
        groups = F.when(F.length(bare) <= 3, F.array(bare)).otherwise(F.regexp_extract_all(F.lpad(bare, m * 3, F.lit("0")), F.lit(r"\d{3}"), F.lit(0)))

        def say(g: Column, i: Column) -> Column:
            low = (m - i) % 3  # 1 for ones, 2 for thousands, 0 for millions
            scale = F.when(low == 1, "").when(low == 2, " thousand").otherwise(" million")
            return F.concat(F.when(g > 0, F.concat(F.lit(" "), _thousand(g), scale)).otherwise(""), F.when((low == 1) & (i < m - 1), " billion").otherwise(""))

        said = F.transform(F.transform(groups, lambda g: g.cast("int")), say)
        return F.when(bare == "", F.lit("zero")).otherwise(F.ltrim(F.array_join(said, "")))

    return let(F.ltrim(digits, F.lit("0")), spell)


def number_words(n: Column) -> Column:
    """Cardinal of a whole number, or of a text of digits, with its sign."""
    text = n.cast("string")
    return F.concat(F.when(text.startswith("-"), F.lit("minus ")).otherwise(F.lit("")), whole_words(F.ltrim(text, F.lit("-"))))


def year_words(y: Column) -> Column:
    """Years in pairs for 1000-1999 and 2010-2099, as cardinals otherwise."""

    def say(n: Column) -> Column:
        low = F.when(n % 100 == 0, F.lit("hundred")).otherwise(F.replace(_hundred(n % 100), F.lit("-"), F.lit(" ")))
        return F.when(n.between(1000, 1999) | n.between(2010, 2099), F.concat(_hundred(F.floor(n / 100)), F.lit(" "), low)).otherwise(number_words(n))

    return let(y.cast("long"), say)


def digit_words(digits: Column) -> Column:
    return F.array_join(F.transform(F.split(digits, ""), lambda c: pick(ONES, c)), " ")


def number_token(token: Column) -> Column:
    """A written number of any length: commas, decimals digit by digit, whole ones of over nine digits spelled."""

    def say(bare: Column) -> Column:
        whole = F.substring_index(bare, ".", 1)
        fraction = F.when(bare.contains("."), F.concat(F.lit(" point "), digit_words(F.substring_index(bare, ".", -1)))).otherwise(F.lit(""))
        return F.when(~bare.contains(".") & (F.length(bare) > 9), digit_words(bare)).otherwise(F.concat(whole_words(whole), fraction))

    bare = F.replace(F.ltrim(token, F.lit("-")), F.lit(","), F.lit(""))
    return F.concat(F.when(token.startswith("-"), F.lit("minus ")).otherwise(F.lit("")), let(bare, say))


def say_money(m: Column) -> Column:
    unit = F.when(m.startswith("$"), "dollars").when(m.startswith("€"), "euros").otherwise("pounds")
    amount = F.replace(F.regexp_replace(m, r"^.", ""), F.lit(","), F.lit(""))
    cents = F.concat(F.lit(" and "), digit_words(F.substring(F.substring_index(amount, ".", -1), 1, 2)), F.lit(" cents"))
    return F.concat(whole_words(F.substring_index(amount, ".", 1)), F.lit(" "), unit, F.when(amount.contains("."), cents).otherwise(F.lit("")))


def say_percent(m: Column) -> Column:
    return F.concat(number_token(F.regexp_replace(m, r"\s*%$", "")), F.lit(" percent"))


def say_time(m: Column) -> Column:
    hour, minute = F.substring_index(m, ":", 1).cast("int"), F.substring_index(m, ":", -1).cast("int")
    low = F.when(minute == 0, F.lit("o'clock")).when(minute < 10, F.concat(F.lit("zero "), pick(ONES, minute))).otherwise(_hundred(minute))
    return F.concat(_hundred(hour), F.lit(" "), low)


def unit_of(m: Column) -> Column:
    """The spoken unit that a measure ends with."""
    names, words = list(UNITS), list(UNITS.values())
    return pick(words, F.array_position(F.split(F.lit(",".join(names)), ","), F.lower(F.regexp_extract(m, r"[A-Za-z]+$", 0))) - 1)


def say_measure(m: Column) -> Column:
    return F.concat(number_token(F.regexp_extract(m, "^" + AMOUNT, 0)), F.lit(" "), unit_of(m))


def ordinal_words(n: Column) -> Column:
    """Ordinals of 0..99."""
    tens = F.when(n % 10 == 0, F.regexp_replace(pick(TENS, F.floor(n / 10)), "y$", "ieth")).otherwise(F.concat(pick(TENS, F.floor(n / 10)), F.lit("-"), pick(ORDINALS, n % 10)))
    return F.when(n <= 20, pick(ORDINALS, n)).otherwise(tens)


def month_of(m: Column) -> Column:
    """The full name of the month that a date begins with."""
    return pick(MONTHS, F.array_position(F.split(F.lit(",".join(name[:3].lower() for name in MONTHS)), ","), F.lower(F.substring(m, 1, 3))) - 1)


def day_of(m: Column) -> Column:
    day = F.regexp_extract(m, r"\s(\d{1,2})", 1).cast("int")
    return F.when(day <= 31, ordinal_words(day)).otherwise(_hundred(day))


def say_date(m: Column) -> Column:
    return F.concat(month_of(m), F.lit(" "), day_of(m), F.lit(", "), year_words(F.regexp_extract(m, r"(\d{4})$", 1)))


def say_url(m: Column) -> Column:
    for a, b in URL_WORDS:
        m = F.replace(m, F.lit(a), F.lit(b))
    return m


def strip_abbreviation_dots(text: Column) -> Column:
    return F.regexp_replace(text, ABBREVIATION, "$1")


#: The passes in order.
PASSES = {
    "urls": lambda t: replace_each(t, URL, say_url),
    "abbreviations": strip_abbreviation_dots,
    "money": lambda t: replace_each(t, MONEY, say_money),
    "percent": lambda t: replace_each(t, PERCENT, say_percent),
    "time": lambda t: replace_each(t, TIME, say_time),
    "measure": lambda t: replace_each(t, MEASURE, say_measure),
    "dates": lambda t: replace_each(t, DATE, say_date),
    "years": lambda t: replace_each(t, YEAR, lambda m: year_words(F.regexp_replace(m, "s$", ""))),
    "numbers": lambda t: replace_each(t, NUMBER, number_token),
    "blanks": lambda t: F.regexp_replace(t, r"[ \t]{2,}", " "),
}


def in_passes(text: Column) -> Column:
    """All passes one after the other, each bound once: a pass reads its text three times."""
    for step in PASSES.values():
        text = let(text, step)
    return text


UNIT_WORDS = r"(?:km|kg|lbs?|mph|miles?|feet|foot|ft|meters?|m|cm|mm)\b"
#: What all months begin with. Patterns of many branches look at what they may begin with before they try one.
MONTH = "[JFMASONDjfmasond](?i:an|eb|ar|pr|ay|un|ul|ug|ep|ct|ov|ec)"
NUMBERED = rf"(?=[\d$€£-]|{MONTH})(?:(?:{MONEY})|(?:{PERCENT})|(?:{TIME})|(?:{MEASURE.replace('(?i)', '(?i:', 1)}))|(?:{DATE.replace('(?i)', '(?i:', 1)}))|(?:{YEAR})|(?:{NUMBER}))"
#: Where a form may begin within another one, or stand so close to it that a replacement changes what comes next: only passes tell.
ENTANGLED = rf"(?=[\d.,:%-]|[HWhw](?i:ttp|ww)|{MONTH}|\w[$€£])(?:" + "|".join(
    (
        URL.replace("(?i)", "(?i:", 1) + ")",
        # digits and marks that are no number, amount or time of their own
        r"(?<![\d.,:])(?!(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?[.,:]*(?![\d.,:])|\d{1,2}:\d{2}[.,:]*(?![\d.,:]))[.,:]*\d",
        # letters that follow digits and are neither a unit, a decade nor an ordinal
        rf"\d(?!(?i:{UNIT_WORDS})|s\b)(?!(?<=(?<!\d)\d)(?:st|nd|rd|th)\b|(?<=(?<!\d)\d\d)(?:st|nd|rd|th)\b)[A-Za-z_]",
        rf"(?<![\w.])-(?:{PERCENT}|{TIME}|{MEASURE.replace('(?i)', '(?i:', 1)})|{YEAR})",
        r"%-?\w|\d:\d{2}\s*%|\w[$€£]\d|\.(?:1[89]\d{2}|20\d{2})s?\b",
        rf"{DATE.replace('(?i)', '(?i:', 1)})(?:\.\d+)?\s*(?:%|(?i:{UNIT_WORDS}))",
    )
) + ")"


def say_form(m: Column) -> Column:
    """A matched form in words, by what it looks like."""
    dated = m.rlike(r"^[A-Za-z]")
    year = dated | m.rlike(r"^(?:1[89]\d{2}|20\d{2})s?$")
    date = F.concat(month_of(m), F.lit(" "), day_of(m), F.lit(", "))
    unit = F.when(m.endswith("%"), " percent").when(m.rlike(r"[A-Za-z]$"), F.concat(F.lit(" "), unit_of(m))).otherwise("")
    return (
        F.when(year, F.concat(F.when(dated, date).otherwise(""), year_words(F.regexp_extract(m, r"(\d{4})s?$", 1)))).when(m.rlike(r"^[$€£]"), say_money(m)).when(m.contains(":"), say_time(m))
        .otherwise(F.concat(number_token(F.regexp_extract(m, "^-?" + AMOUNT, 0)), unit))
    )


def normalise(text: Column) -> Column:
    """The spoken form of a text: every number form found by one pattern and said by its kind.

    Texts without a digit or an address skip that, and those whose forms are entangled take the passes, which define the result.
    """

    def say(t: Column) -> Column:
        plain = strip_abbreviation_dots(t)
        blanks = PASSES["blanks"]
        once = let(plain, lambda p: replace_each(p, NUMBERED, say_form))
        return F.when(~(t.rlike(r"\d") | t.rlike(r"[HWhw](?i:ttps?://|ww\.)")), blanks(plain)).when(t.rlike(ENTANGLED), in_passes(t)).otherwise(blanks(once))

    return let(text, say)


def pronunciation_pattern(key: str) -> str:
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in key)
    return (r"\b" if key[:1].isupper() else r"(?i)\b") + quoted + r"\b"


def pronounce(text: Column, table: dict[str, str] | None = None) -> tuple[Column, Column]:
    """The text with respellings, longest keys first, and how many there are."""
    table = D.PRONUNCIATIONS if table is None else table
    keys = [k for k in sorted(table, key=len, reverse=True) if k and table[k] and k != table[k]]
    hits, said = F.lit(0), text
    for key in keys:
        hits = hits + F.regexp_count(said, F.lit(pronunciation_pattern(key)))
        said = F.regexp_replace(said, pronunciation_pattern(key), table[key].replace("\\", r"\\").replace("$", r"\$"))
    if keys and all(k[:1].isupper() for k in keys):
        # such keys are met as they are written: most texts have none of them, for which capitals are looked at only
        quote = lambda k: "".join(rf"\x{{{ord(c):x}}}" for c in k)
        some = text.rlike(f"[{''.join(quote(c) for c in sorted({k[0] for k in keys}))}](?:{'|'.join(quote(k[1:]) for k in keys)})")
        return F.when(some, said).otherwise(text), F.when(text.isNull(), F.lit(None)).when(some, hits).otherwise(F.lit(0))
    return said, hits


TAG = r"\[/?[A-Za-z_]+(?::[^\]]*)?\]"


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_markup(text), r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
