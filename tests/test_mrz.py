"""Zones: the public specimen, damaged lines, and the arithmetic of check digits."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import mrz
from quillframe.plans import driver

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA".ljust(44, "<")
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def parse(spark, line1, line2, as_of="2026-08-16"):
    return spark.createDataFrame([(line1, line2)], "a string, b string").select(mrz.parse(F.col("a"), F.col("b"), F.lit(as_of).cast("date")).alias("z")).first()["z"]


def test_specimen(spark):
    z = parse(spark, LINE1, LINE2)
    assert (z.passport_number, z.surname, z.given_names, z.date_of_birth, z.sex, z.date_of_expiry, z.expired) == ("L898902C3", "ERIKSSON", "ANNA MARIA", "1974-08-12", "F", "2012-04-15", True)
    assert z.passport_number_check_ok and z.date_of_birth_check_ok and z.date_of_expiry_check_ok and z.personal_number_check_ok and z.composite_check_ok


def test_damage_shows_in_the_checks(spark):
    z = parse(spark, LINE1, "L898902X" + LINE2[8:])
    assert not z.passport_number_check_ok and not z.composite_check_ok and z.date_of_birth_check_ok


def test_lines_of_another_length_give_nothing(spark):
    assert parse(spark, LINE1[:43], LINE2) is None
    assert parse(spark, None, LINE2) is None


def test_noise_after_the_names_is_no_name(spark):
    z = parse(spark, "P<UTOERIKSSON<<ANNA<MARIA<<E<SS<<<<S<SKE<<<<", LINE2)
    assert (z.surname, z.given_names) == ("ERIKSSON", "ANNA MARIA")
    assert parse(spark, "P<UTOERIKSSON".ljust(44, "<"), LINE2).given_names == ""


def test_dates(spark):
    cases = {"300705": "2030-07-05", "910824": "1991-08-24", "361231": "2036-12-31", "370101": "1937-01-01", "911301": "911301", "910231": "1991-02-31", "9108X4": "9108X4", "910800": "910800"}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", mrz.zone_date(F.col("s"), F.lit("2026-08-16").cast("date")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in rows} == cases


def test_expiry_on_the_day_is_not_past(spark):
    found = spark.createDataFrame([("2026-08-16",), ("2026-08-15",), ("2026-02-31",), ("26",)], "s string").select(mrz.is_past(F.col("s"), F.lit("2026-08-16").cast("date")).alias("v"))
    assert [r["v"] for r in found.collect()] == [False, True, True, False]


def test_normalizing(spark):
    rows = spark.createDataFrame([("p<uto «x‹_é1ß",)], "s string").select(mrz.normalize(F.col("s")).alias("v"))
    assert rows.first()["v"] == "P<UTO<<X<<1"


def test_extract_takes_the_two_lowest(spark):
    lines = [(0, 10, "A" * 44), (1, 900, LINE1), (2, 930, LINE2.lower()), (3, 500, "B" * 40), (4, 950, "short")]
    frame = spark.createDataFrame([(lines,), (lines[:1],), ([],)], "x array<struct<line_no: int, top: int, text: string>>")
    found = [r["z"] for r in frame.select(mrz.extract(F.col("x"), F.lit("2026-08-16").cast("date")).alias("z")).collect()]
    assert found[0].passport_number == "L898902C3" and found[1:] == [None, None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ABCXYZ0189<", min_size=9, max_size=9))
def test_check_digits_verify_themselves(spark, s):
    want = sum((mrz.ALPHABET.find(c) if c in mrz.ALPHABET else 0) * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10
    row = spark.createDataFrame([(s, str(want))], "s string, d string").select(mrz.check_digit(F.col("s")).alias("a"), mrz.check_digit(F.col("s"), 9).alias("b"), mrz.verify(F.col("s"), F.col("d"), 9).alias("ok"), mrz.verify(F.col("s"), F.lit("<"), 9).alias("blank")).first()
    assert (row["a"], row["b"], row["ok"], row["blank"]) == (want, want, True, True)


def test_candidate_lines_are_told_without_rewriting_them(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choices("Aa0< _«‹.;ß\né\u212a", [9, 9, 9, 9, 3, 1, 1, 1, 3, 1, 1, 1, 1, 1], k=rng.randint(30, 75))) for _ in range(3000)]
    lines += ["A" * n for n in range(36, 53)] + [".A" * 50, "." * 200_000, "A" * 200_000, "", None]
    frame = spark.createDataFrame([(s,) for s in lines], "s string").select(mrz.is_candidate_line(F.col("s")).alias("line"), mrz.is_candidate(mrz.normalize(F.col("s"))).alias("whole"))
    got = frame.collect()
    assert [r.line for r in got] == [r.whole for r in got] and any(r.line for r in got)
    # The query rewrote every line, and more than once: in its filter and in its result.
    plan = driver.mrz_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Filter"):].count("regexp_replace") == 0
