"""Pages with invented values, in the shapes that the operators are for."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions.text import PASSPORT_LABEL_WORDS
from quillframe.operators import layout, passport, signatures

SCHEMA = "doc_id long, det_no int, text string, confidence float, polygon array<array<int>>"


def page(*lines, doc=1):
    """Lines of (text, confidence, left, top[, width]), 20 pixels high."""
    out = []
    for i, (text, confidence, x, y, *w) in enumerate(lines):
        right = x + (w[0] if w else 100)
        out.append((doc, i, text, float(confidence), [[x, y], [right, y], [right, y + 20], [x, y + 20]]))
    return out


def generic(spark, *lines):
    frame = layout.pages(spark.createDataFrame(page(*lines), SCHEMA))
    rows = layout.explode_fields(frame.select("doc_id", layout.generic_fields(F.col("lines")).alias("fields"))).orderBy("field_no").collect()
    return [(r.label, r.value) for r in rows]


def fields(spark, *lines, types=signatures.CARD_TYPES):
    frame = signatures.card_fields(layout.pages(spark.createDataFrame(page(*lines), SCHEMA)), types)
    return {r.label: r.value for r in layout.explode_fields(frame).collect()}


def test_inline_and_nearest_below(spark):
    assert generic(spark, ("NAME", 0.99, 10, 10), ("Asha", 0.98, 12, 40), ("NATIONALITY: Testian", 0.97, 10, 80)) == [("NAME", "Asha"), ("NATIONALITY", "Testian")]


def test_bilingual_label(spark):
    found = generic(spark, ("नागरिकता CITIZENSHIP TYPE", 0.99, 10, 10, 250), ("नमूना SAMPLE", 0.99, 1000, 10), ("वंशज", 0.98, 12, 40))
    assert found == [("नागरिकता CITIZENSHIP TYPE", "वंशज")]


def test_split_labels_and_values(spark):
    found = generic(
        spark, ("DATE", 0.99, 10, 10), ("OF", 0.99, 112, 10), ("ISSUE", 0.99, 214, 10), ("2020-01-02", 0.98, 12, 40), ("FULL NAME", 0.99, 10, 80), ("Asha", 0.98, 12, 110), ("Testperson", 0.98, 120, 110)
    )
    assert found == [("DATE OF ISSUE", "2020-01-02"), ("FULL NAME", "Asha Testperson")]


def test_unsure_and_distant_guesses_are_dropped(spark):
    found = generic(spark, ("NATIONAL IDENTITY CARD", 0.88, 10, 10), ("DATE OF BIRTH", 0.99, 10, 60), ("x", 0.98, 310, 90), ("SEX", 0.99, 10, 150), ("F", 0.98, 12, 180))
    assert found == [("SEX", "F")]


@pytest.mark.parametrize(("confidence", "left", "top", "kept"), [(0.75, 130, 40, True), (0.74, 12, 40, False), (0.9, 131, 40, False), (0.9, 12, 110, True), (0.9, 12, 111, False), (0.9, 12, 20, True), (0.9, 12, 19, False)])
def test_limits(spark, confidence, left, top, kept):
    assert bool(generic(spark, ("SEX", 0.9, 10, 10), ("F", confidence, left, top))) == kept


def test_ties_go_to_the_first_in_reading_order(spark):
    assert generic(spark, ("SEX", 0.99, 100, 10), ("A", 0.9, 90, 40, 8), ("B", 0.9, 110, 40, 8)) == [("SEX", "A B")]
    assert generic(spark, ("SEX", 0.99, 100, 10), ("A", 0.9, 60, 40, 8), ("B", 0.9, 140, 40, 8)) == [("SEX", "A")]


def test_rows_of_labels_join_through_one_between(spark):
    found = generic(spark, ("DATE", 0.99, 10, 10, 40), ("BIRTH", 0.99, 140, 10, 60), ("OF", 0.99, 85, 10, 20), ("1990-01-01", 0.98, 12, 40))
    assert found == [("DATE OF BIRTH", "1990-01-01")]


CARD = [
    ("राष्ट्रिय परिचयपत्र", 0.95, 300, 10, 250), ("NATIONAL IDENTITY CARD", 0.97, 300, 40, 300), ("परिचय नं.", 0.95, 10, 80), ("१२३-४५६-७८९-०", 0.96, 10, 110, 140), ("123-456-789-0", 0.95, 10, 140, 140),
    ("नाम", 0.95, 300, 160, 60), ("थर", 0.94, 420, 190, 60), ("आशा", 0.94, 302, 191, 60), ("FULL NAME", 0.98, 300, 220, 90), ("ASHA TEST", 0.96, 302, 250, 90),
    ("NATIONALITY", 0.97, 10, 280, 110), ("Testian", 0.96, 12, 310), ("DATE OF ISSUE", 0.97, 10, 350, 130), ("2020.01.02", 0.96, 12, 380), ("1990/03 04", 0.95, 300, 410), ("१९९०-०३-०४", 0.95, 300, 440),
    ("SEX", 0.96, 600, 460, 40), ("F", 0.95, 602, 490, 20), ("महिला", 0.95, 660, 530, 40),
]


def test_identity_card(spark):
    assert fields(spark, *CARD) == {
        "NATIONAL ID NUMBER": "१२३-४५६-७८९-० / 123-456-789-0",
        "NATIONALITY": "Testian",
        "FULL NAME": "आशा थर / ASHA TEST",
        "DATE OF ISSUE": "2020.01.02",
        "DATE OF BIRTH": "1990/03 04 / १९९०-०३-०४",
        "SEX": "महिला / F",
    }


def test_a_missing_header_does_not_lose_the_type(spark):
    assert "NATIONAL ID NUMBER" in fields(spark, *CARD[2:])


def test_citizenship_card(spark):
    found = fields(
        spark, ("PERMANENT ADDRESS", 0.96, 10, 10, 180), ("Sampletown, ward 4", 0.95, 12, 40, 180), ("CITIZENSHIP TYPE", 0.96, 10, 90, 160), ("Descent", 0.95, 14, 120), ("नागरिकता नं. | CC NUMBER", 0.95, 300, 10, 200),
        ("12-34-56-7890", 0.94, 305, 40, 130), ("NICIN", 0.97, 300, 90, 60), ("987-654-321", 0.92, 301, 120, 130),
    )
    assert found == {"PERMANENT ADDRESS": "Sampletown, ward 4", "NICIN": "987-654-321", "CITIZENSHIP TYPE": "Descent", "CITIZENSHIP NUMBER": "12-34-56-7890"}


def test_a_new_type_is_data(spark):
    license_ = signatures.DocumentType("license", ("DRIVER LICENSE", "LICENSE NO"), 2, (signatures.Signature("LICENSE NUMBER", ("LICENSE NO",)), signatures.Signature("BORN", (), None, "date")))
    found = fields(spark, ("DRIVER LICENSE", 0.97, 10, 10), ("LICENSE NO", 0.96, 10, 50), ("AB-77", 0.95, 12, 80), ("1990-01-02", 0.9, 300, 200), types=(license_,))
    assert found == {"LICENSE NUMBER": "AB-77", "BORN": "1990-01-02"}


def test_one_keyword_is_not_enough(spark):
    frame = signatures.card_fields(layout.pages(spark.createDataFrame(page(("FULL NAME", 0.9, 10, 10), ("x y", 0.9, 12, 40)), SCHEMA)))
    assert frame.first()["type"] is None


def test_passport_without_zone_has_defaults(spark):
    frame = layout.pages(spark.createDataFrame(page(("PASSPORT", 0.95, 10, 10), ("SURNAME", 0.95, 10, 50), ("TEST", 0.9, 12, 80), ("1 x/FEB 12", 0.9, 300, 100), ("05 JAN 1990", 0.9, 300, 60), ("2 MAR 2030", 0.9, 300, 140)), SCHEMA), PASSPORT_LABEL_WORDS)
    row = passport.passport_documents(frame, F.lit("2025-01-01").cast("date")).first()
    assert (row.surname, row.full_name, row.date_of_issue, row.expired, row.composite_check_ok) == ("", "", "2012-02-01", False, False)
    assert list(row.asDict())[1:] == list(passport.COLUMNS)


def test_documents_do_not_touch_each_other_and_may_move(spark):
    alone = page(*CARD, doc=1)
    moved = [(2, n, t, c, [[x + 37, y + 11] for x, y in p]) for _, n, t, c, p in alone]
    other = page(("NAME", 0.99, 10, 10), ("Asha", 0.98, 12, 40), doc=3)
    rows = layout.explode_fields(signatures.card_fields(layout.pages(spark.createDataFrame(alone + moved + other, SCHEMA)))).collect()
    by = lambda d: sorted((r.field_no, r.label, r.value) for r in rows if r.doc_id == d)
    assert by(1) == by(2) and by(3) == [(0, "NAME", "Asha")]


def test_empty_input_and_unusable_lines(spark):
    assert layout.pages(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = layout.pages(spark.createDataFrame(page((" ", 0.9, 1, 1), ("x", 0.44, 1, 1)), SCHEMA))
    assert [r.lines for r in empty.collect()] == [[]]
    record = passport.passport_documents(empty).first()
    assert all(record[c] in ("", False) for c in passport.COLUMNS)
    assert layout.fields_json(signatures.card_fields(empty)).first().body == '{"fields":[]}'
    assert layout.pages(spark.createDataFrame(page(("x", 0.45, 1, 1)), SCHEMA)).count() == 1


def test_one_shuffle_serves_a_page(spark):
    frame = signatures.card_fields(layout.pages(spark.createDataFrame(page(*CARD), SCHEMA)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Join" not in plan
