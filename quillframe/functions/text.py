"""Text predicates and small parsers over recognized lines, as column expressions.

All are built-in expressions, so they run inside the JVM, push down where Spark can push them, and work unchanged on streams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make up printed labels, by document family; month names; confidence thresholds.
CARD_LABEL_WORDS = (
    "NATIONAL", "IDENTITY", "CARD", "NATIONALITY", "FULL", "NAME", "DATE", "OF", "ISSUE", "BIRTH",
    "SEX", "PERMANENT", "ADDRESS", "CITIZENSHIP", "TYPE", "NUMBER", "CC", "NICIN", "ID", "NO",
)
PASSPORT_LABEL_WORDS = (
    "TYPE", "COUNTRY", "CODE", "PASSPORT", "SURNAME", "GIVEN", "NAMES", "NATIONALITY", "DATE", "OF", "BIRTH",
    "SEX", "ISSUE", "EXPIRY", "CITIZENSHIP", "NO", "PLACE", "ISSUING", "AUTHORITY", "HOLDERS", "SIGNATURE",
)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: The characters of ``(?U)\\s``.
WHITE_SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_CONFIDENCE, VALUE_CONFIDENCE, LABEL_CONFIDENCE = 0.45, 0.75, 0.90


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def real(x: float) -> Column:
    """A 32-bit literal: confidences are 32-bit, and 0.45 or 0.90 as a double is another number."""
    return F.lit(x).cast("float")


def strip(s: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes the space character only)."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def has_devanagari(s: Column) -> Column:
    """Any character of the block U+0900 to U+097F; the script property would miss its punctuation."""
    return s.rlike("[ऀ-ॿ]")


#: Groups of numeric characters between ``-``, ``.``, ``/`` and spaces, of a stripped text.
_DATE = r"[-./ ]*+\p{N}{4}[-./ ]++\p{N}{2}[-./ ]++\p{N}{2}[-./ ]*+\z"
_IDENTITY = r"(?=(?:\P{N}*+\p{N}){6})[-./ ]*+(?:\p{N}{1,4}(?:[-./ ]++|\z)){3,5}\z"


def is_date_shape(s: Column) -> Column:
    """Groups of 4, 2 and 2; no calendar is asked."""
    return strip(s).rlike(rf"\A{_DATE}")


def is_identity_number(s: Column) -> Column:
    """3 to 5 groups of 1 to 4, 6 or more in all, and not a date."""
    return strip(s).rlike(rf"\A(?!{_DATE}){_IDENTITY}")


SHAPES: dict[str, Callable[[Column], Column]] = {
    "devanagari": lambda s: has_devanagari(s) & ~s.rlike(r"\p{N}"),
    "lowercase": lambda s: s.rlike("[a-z]"),
    "identity_number": is_identity_number,
    "date": is_date_shape,
}


def matches_shape(s: Column, shape: str, options: Sequence[str] = ()) -> Column:
    """Whether a text has the shape; ``enum`` is an exact match of one of the options after stripping."""
    return strip(s).isin(*options) if shape == "enum" else SHAPES[shape](s)


def looks_like_label(s: Column, words: Sequence[str] = CARD_LABEL_WORDS) -> Column:
    """Whether a text reads as a printed label.

    Of each word only ASCII letters count. Words left empty are passed over; one with a small letter, or of two letters
    and more that is not in the vocabulary, makes it no label; single letters say nothing; one known word is needed.
    """
    letters = F.regexp_replace(s, r"(?U)[^A-Za-z\s]+", "")
    known = rf"(?:[A-Z]|{'|'.join(map(re.escape, words))})(?!\S)"
    # One search over the letters, which generated code works out once: two capitals in a row, and no word that is not known.
    return F.when(s.rlike("[a-z]"), False).otherwise(letters.rlike(rf"(?Us)\A(?=.*?[A-Z]{{2}})(?!.*?(?<!\S)(?!{known})\S)"))


def contains_ci(s: Column, keyword: str) -> Column:
    """Substring in upper case."""
    return F.contains(F.upper(s), F.upper(F.lit(keyword)))


def clean_label(s: Column) -> Column:
    """Stripped, then without ``*`` at both ends, then stripped again."""
    return strip(F.regexp_replace(strip(s), r"^\*+|\*+$", ""))


def make_field(label: Column, value: Column) -> Column:
    """A struct (label, value) of cleaned texts; null if either is empty."""
    pair = F.struct(clean_label(label).alias("label"), clean_label(value).alias("value"))
    return let(pair, lambda p: F.when((p["label"] != "") & (p["value"] != ""), p))


def inline_field(s: Column) -> Column:
    """The field in ``label: value``, split at the first colon; null without one."""
    at = F.instr(s, ":")
    return F.when(at > 0, make_field(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s))))


def join_unique(values: Column) -> Column:
    """Stripped, without empties and later repeats, joined by `` / ``; null if nothing is left."""
    kept = F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))
    return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " / ")))


def printed_date_parts(s: Column) -> Column:
    """(day, month, year) of a printed date such as ``06 APR 2011``; null otherwise.

    Tokens are cut at white space and ``/``. The first is the day, of one or two digits, unchecked; the last the year, of
    two (then 20xx) or four digits; the first month name of any token between counts, the others do not.
    """
    month = lambda w: F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(w)).cast("int")

    def parts(t: Column) -> Column:
        day, year = F.element_at(t, 1), F.element_at(t, -1)
        found = F.filter(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))), month), lambda m: m > 0)
        ok = (F.size(t) >= 3) & day.rlike("^[0-9]{1,2}$") & year.rlike("^(?:[0-9]{2}|[0-9]{4})$")
        full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        made = F.struct(F.try_to_number(day, F.lit("99")).cast("int").alias("day"), F.get(found, F.lit(0)).alias("month"), F.try_to_number(full, F.lit("9999")).cast("int").alias("year"))
        return F.when(ok & (F.size(found) > 0), made)

    return let(F.filter(F.split(s, r"(?U)[\s/]+"), lambda w: w != ""), lambda t: F.when(F.size(t) >= 3, parts(t)))


def is_printed_date(s: Column) -> Column:
    return printed_date_parts(s).isNotNull()


def printed_date_iso(s: Column) -> Column:
    """ISO form of a printed date, or the text as it is."""
    return let(printed_date_parts(s), lambda p: F.when(p.isNotNull(), F.format_string("%04d-%02d-%02d", p["year"], p["month"], p["day"])).otherwise(s))


def printed_dates(texts: Column) -> Column:
    """The printed dates among the texts of a page, stripped, in order."""
    return F.transform(F.filter(texts, is_printed_date), strip)
