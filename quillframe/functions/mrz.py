"""Machine-readable zones of passports (two lines of 44 characters), as column expressions over codegen-friendly built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import let

LINE = 44
#: Accepted lengths of a line before it is cut or padded.
SHORTEST, LONGEST = 38, 50
# Fixed value: characters in order of their check value; any other counts 0.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)


def check_digit(s: Column, length: int | None = None) -> Column:
    """Weighted sum modulo 10. With a known ``length`` it is one arithmetic expression; otherwise a fold over the characters."""
    value = lambda c: F.greatest(F.position(c, F.lit(ALPHABET)) - 1, F.lit(0))
    if length is None:
        terms = F.transform(F.split(s, ""), lambda c, i: value(c) * F.element_at(F.array(*map(F.lit, WEIGHTS)), i % 3 + 1))
        return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10
    total = F.lit(0)
    for i in range(length):
        total = total + value(F.substring(s, i + 1, 1)) * WEIGHTS[i % 3]
    return total % 10


def verify(field: Column, expected: Column, length: int) -> Column:
    """Whether the check character fits; ``<`` always does, a character that is no digit never."""
    return F.when(expected == "<", True).otherwise(expected.rlike("^[0-9]$") & (check_digit(field, length).cast("string") == expected))


def clean_field(s: Column) -> Column:
    """Without fillers at both ends."""
    return F.regexp_replace(s, "^<+|<+$", "")


def clean_name(s: Column) -> Column:
    """Parts between single fillers, up to the first double one, joined by spaces."""
    parts = F.transform(F.split(F.substring_index(s, "<<", 1), "<"), F.trim)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def resolve_year(yy: Column, as_of: Column) -> Column:
    """The year in the century of ``as_of``; one before if that is over ten years ahead."""
    this = F.year(as_of)
    year = this - this % 100 + yy
    return F.when(year > this + 10, year - 100).otherwise(year)


def zone_date(yymmdd: Column, as_of: Column) -> Column:
    """ISO form, or the text as it is where it is not six digits with a month 1-12 and a day 1-31. No calendar is asked."""
    part = lambda at: F.try_to_number(F.substring(yymmdd, at, 2), F.lit("99")).cast("int")
    good = yymmdd.rlike("^[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$")
    return F.when(good, F.format_string("%04d-%s-%s", resolve_year(part(1), as_of), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2))).otherwise(yymmdd)


def is_past(iso: Column, as_of: Column) -> Column:
    """Whether an ISO text is before ``as_of``; false for texts of another form. Texts in this form sort as dates do, and may name days no calendar has."""
    return iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (iso < F.date_format(as_of, "yyyy-MM-dd"))


def normalize(s: Column) -> Column:
    """ASCII letters in upper case; space, ``_``, ``«`` and ``‹`` become fillers; other characters go."""
    # What is not ASCII goes before the change of case, which would make ASCII letters of some of it.
    return F.upper(F.regexp_replace(F.regexp_replace(s, "[ _«‹]", "<"), "[^A-Za-z0-9<]+", ""))


def is_candidate(normalized: Column) -> Column:
    """Only the length of a line tells."""
    return F.length(normalized).between(SHORTEST, LONGEST)


def is_candidate_line(s: Column) -> Column:
    """``is_candidate(normalize(s))`` of a line as it is: one search, which ends after the first character too many."""
    kept, other = "[A-Za-z0-9< _«‹]", "[^A-Za-z0-9< _«‹]*+"
    return s.rlike(rf"\A(?:{other}{kept}){{{SHORTEST},{LONGEST}}}+{other}\z")


def fit(normalized: Column) -> Column:
    """Exactly 44 characters."""
    return F.rpad(normalized, LINE, "<")


def parse(line1: Column, line2: Column, as_of: Column) -> Column:
    """A struct of 11 values and 5 check results; null unless both lines have 44 characters."""
    cut = lambda s, start, end: F.substring(s, start + 1, end - start)
    names = cut(line1, 5, 44)
    split_at = F.instr(names, "<<")
    given = F.when(split_at > 0, F.substring(names, split_at + 2, F.lit(LINE))).otherwise("")
    surname = F.when(split_at > 0, F.substring(names, F.lit(1), split_at - 1)).otherwise(names)
    number, birth, expiry, personal = cut(line2, 0, 9), cut(line2, 13, 19), cut(line2, 21, 27), cut(line2, 28, 42)
    composite = F.concat(cut(line2, 0, 10), cut(line2, 13, 20), cut(line2, 21, 43))
    sex = cut(line2, 20, 21)
    until = zone_date(expiry, as_of)
    fields = F.struct(
        clean_field(cut(line1, 0, 2)).alias("document_type"),
        clean_field(cut(line1, 2, 5)).alias("issuing_country"),
        clean_name(surname).alias("surname"),
        clean_name(given).alias("given_names"),
        clean_field(number).alias("passport_number"),
        clean_field(cut(line2, 10, 13)).alias("nationality"),
        zone_date(birth, as_of).alias("date_of_birth"),
        F.when(sex.isin("M", "F"), sex).otherwise("X").alias("sex"),
        until.alias("date_of_expiry"),
        clean_field(personal).alias("personal_number"),
        is_past(until, as_of).alias("expired"),
        verify(number, cut(line2, 9, 10), 9).alias("passport_number_check_ok"),
        verify(birth, cut(line2, 19, 20), 6).alias("date_of_birth_check_ok"),
        verify(expiry, cut(line2, 27, 28), 6).alias("date_of_expiry_check_ok"),
        verify(personal, cut(line2, 42, 43), 14).alias("personal_number_check_ok"),
        verify(composite, cut(line2, 43, 44), 39).alias("composite_check_ok"),
    )
    return F.when((F.length(line1) == LINE) & (F.length(line2) == LINE), fields)


def extract(lines: Column, as_of: Column) -> Column:
    """The zone of a page, from an array of structs with ``text``, ``top`` and ``line_no``: the two lowest candidates, in order; null with fewer."""
    rows = F.transform(F.filter(lines, lambda x: is_candidate_line(x["text"])), lambda x: F.struct(x["top"].alias("top"), x["line_no"].alias("line_no"), normalize(x["text"]).alias("text")))
    return let(rows, lambda r: F.when(F.size(r) >= 2, let(F.slice(F.sort_array(r), -2, 2), lambda p: parse(fit(p[0]["text"]), fit(p[1]["text"]), as_of))))
