"""Text predicates and parsers on small tables of cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.functions import text


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i").select(column(F.col("s")).alias("v")).collect()
    return [r["v"] for r in rows]


@pytest.mark.parametrize(
    ("shape", "yes", "no"),
    [
        ("date", ["2020-01-02", "1990/03 04", " 2020.01.02 ", "२०२०-०१-०२", "2020-99-99"], ["20-01-02", "2020-1-02", "", "2020-01-0x", None]),
        ("identity_number", ["123-456-7890", "123.456/7890", "१२३-४५६-७८९-०", "12-34-56"], ["2020-01-02", "1-2-3", "12345-67-89", "12-34", "a-12-345", "1-2-3-4-5-6"]),
        ("devanagari", ["नाम", "नाम x", "।"], ["नाम 1", "नाम १", "name", ""]),
        ("lowercase", ["Ab", "x"], ["AB", "१", ""]),
    ],
)
def test_shapes(spark, shape, yes, no):
    found = values(spark, yes + no, lambda s: text.matches_shape(s, shape))
    assert found[: len(yes)] == [True] * len(yes)
    assert not any(found[len(yes) :])


def test_enum_shape_is_stripped_and_exact(spark):
    assert values(spark, [" M ", "MM", "m"], lambda s: text.matches_shape(s, "enum", ("M",))) == [True, False, False]


def test_labels(spark):
    cases = {"FULL NAME": True, "FULL I NAME": True, "नाम FULL NAME": True, "Full NAME": False, "ASHA NAME": False, "I": False, "": False, "ID/NO": False, "ID / NO": True, "नाम": False, "DATE OF": True}
    assert values(spark, list(cases), text.looks_like_label) == list(cases.values())


def test_strip_knows_unicode_spaces(spark):
    assert values(spark, ["  a b \t", "", None], text.strip) == ["a b", "", None]


def test_inline_fields(spark):
    found = values(spark, ["A: b: c", ": x", "x :", "*A* : ** b", "no colon", "A:*"], text.inline_field)
    assert [f and (f["label"], f["value"]) for f in found] == [("A", "b: c"), None, None, ("A", "b"), None, None]


def test_join_unique(spark):
    rows = spark.createDataFrame([(["b", " a", "b ", "", "a"],), ([],), (["  "],)], "x array<string>").select(text.join_unique(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["b / a", None, None]


def test_printed_dates(spark):
    cases = {
        "06 APR 2011": "2011-04-06", "05 noise/JUL 23": "2023-07-05", "word": "word", "06 2011": "06 2011", "123 APR 2011": "123 APR 2011",
        "6 apr 11": "2011-04-06", "99 MAY 2000": "2000-05-99", "1 JAN FEB 01": "2001-01-01", "": "", "a JAN 2000": "a JAN 2000", "1 JAN 200": "1 JAN 200",
    }
    assert values(spark, list(cases), text.printed_date_iso) == list(cases.values())


def test_confidence_thresholds_are_32_bit(spark):
    rows = spark.sql("SELECT CAST(0.45 AS FLOAT) AS c, CAST(0.9 AS FLOAT) AS d")
    assert rows.select((F.col("c") >= text.real(0.45)) & (F.col("d") >= text.real(0.9))).first()[0]


def test_strip_takes_what_the_expression_takes(spark):
    every = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    s = F.concat("c", F.lit("a b"), "c", F.lit("\n"))
    assert every.where(text.strip(s) != F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).count() == 0


def _label_by_words(s, words=frozenset(text.CARD_LABEL_WORDS)):
    cleaned = [w for w in (re.sub("[^A-Za-z]", "", w) for w in re.split(f"[{text.WHITE_SPACE}]+", s)) if w]
    return all(not re.search("[a-z]", w) and (len(w) == 1 or w in words) for w in cleaned) and any(len(w) > 1 for w in cleaned)


def _groups(s):
    groups = [g for g in re.split("[-./ ]", s.strip(text.WHITE_SPACE)) if g]
    return [len(g) for g in groups] if all(c.isnumeric() for g in groups for c in g) else []


def test_labels_and_numbers_as_by_words_and_groups(spark):
    rng = random.Random(5)
    bits = ["DATE", "OF", "NAME", "D.A.T.E", "A", "I", "x", "ASHA", "नाम", " ", " ", "\t", "\n", "\u2003", "-", ".", ":", "NA", "ID", "IDN"]
    labels = ["".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(3000)] + ["A " * 30000 + "NO", "A " * 30000 + "NOO"]
    assert values(spark, labels, text.looks_like_label) == [_label_by_words(s) for s in labels]
    numbers = ["".join(rng.choices("1234५. /-- 12", k=rng.randint(4, 16))) + rng.choice(["", "", " ", "x"]) for _ in range(6000)] + ["2020" + rng.choice("-./ ") * 2 + f"{i:02}-11" for i in range(20)] + ["-" * 30000]
    assert values(spark, numbers, text.is_date_shape) == [_groups(s) == [4, 2, 2] for s in numbers]
    known = [3 <= len(g) <= 5 and max(g) <= 4 and sum(g) >= 6 and g != [4, 2, 2] for g in map(_groups, numbers)]
    assert values(spark, numbers, text.is_identity_number) == known and any(known)


def test_label_test_is_generated_code(spark):
    """It was a fold over the words of each line, which no generated code runs."""
    plan = spark.range(1).select(text.looks_like_label(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
