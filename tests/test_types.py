"""Types as a table against types as objects, by the automaton and by the join."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.functions.text import PASSPORT_LABEL_WORDS
from quillframe.operators import layout, signatures, type_tables
from quillframe.operators.signatures import Block, DocumentType, Signature
from tests.test_layout import CARD, SCHEMA, page
from tests.test_wide import scattered

INVOICE = DocumentType("invoice", ("invoice", "Total", "total"), 3, (Signature("SUM", ("TOTAL", "SUM")), Signature("NOTE", (), Block("NOTE", "END", "lowercase")), Signature("DAY", (), None, "date")))


def rows(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()))


@pytest.fixture(scope="module")
def pages(spark):
    made = page(*CARD, doc=1) + page(("Invoice", 0.9, 0, 0), ("TOTAL: 5", 0.9, 0, 40), ("NOTE", 0.9, 0, 80), ("some text", 0.9, 0, 120), ("more", 0.9, 0, 160), ("some text", 0.9, 0, 200), ("END", 0.9, 0, 240), ("2020-01-02", 0.9, 0, 280), doc=2)
    made += page(("PERMANENT ADDRESS", 0.95, 10, 10), ("town", 0.95, 12, 40), ("CITIZENSHIP TYPE", 0.95, 10, 90), ("Descent", 0.95, 14, 120), ("NICIN: 1", 0.95, 0, 160), ("CC NUMBER", 0.95, 300, 10), ("12-34-56", 0.95, 300, 40), doc=3)
    made += page(("plain", 0.1, 0, 0), doc=4) + page(("SURNAME", 0.95, 10, 10), ("Ram", 0.95, 12, 40), ("PASSPORT NO", 0.95, 300, 10), ("L1", 0.95, 302, 40), doc=5) + [line for d in range(10, 20) for line in scattered(d, 25, 500, d)]
    return layout.pages(spark.createDataFrame(made, SCHEMA)).cache()


@pytest.mark.parametrize("bound", [type_tables.AUTOMATON_BYTES, 0])
def test_fields_are_those_of_objects(spark, pages, bound):
    types = (*signatures.CARD_TYPES, INVOICE)
    found = type_tables.typed_fields(pages, type_tables.type_table(spark, types), bound)
    want = signatures.card_fields(pages, types)
    assert rows(found.select("doc_id", "type", "fields")) == rows(want)
    assert {r.type for r in found.select("type").distinct().collect()} == {"identity_card", "citizenship_card", "invoice", None}


@pytest.mark.parametrize("bound", [type_tables.AUTOMATON_BYTES, 0])
def test_passports(spark, bound):
    lines = page(("SURNAME", 0.95, 10, 10), ("Ram", 0.95, 12, 40), ("PASSPORT NO: L1", 0.95, 300, 10), ("SEX", 0.4, 10, 80), ("F", 0.9, 12, 110), doc=5) + page(("NAME: x", 0.95, 0, 0), doc=6)
    found = layout.pages(spark.createDataFrame(lines, SCHEMA), PASSPORT_LABEL_WORDS)
    assert rows(type_tables.typed_fields(found, type_tables.type_table(spark, [signatures.PASSPORT], first=True), bound)) == rows(signatures.passport_fields(found))


@pytest.mark.parametrize("bound", [type_tables.AUTOMATON_BYTES, 0])
def test_any_keywords_and_counts(spark, pages, bound):
    rng = random.Random(1)
    texts = ["NAME", "x 1", "name: r", "DATE", "of b", "s", "", "TYPE NO", "परिचय", "no such text", "1990", "😀"]
    types = [(i, f"t{i}", rng.choice([1, 2, 3, 4, 9]), None, [rng.choice([*texts, None]) for _ in range(4)], None) for i in range(30)] + [(40, "any", 0, None, None, None), (41, "never", None, None, ["NAME"], None)]
    table = spark.createDataFrame(types, type_tables.TYPES)
    got = {r.doc_id: r.type_no for r in type_tables.with_type(pages, table, bound).collect()}
    for r in pages.collect():
        hits = {t: sum(k is not None and any(k.upper() in x.upper for x in r.lines) for k in words or []) for t, _, _, _, words, _ in types}
        assert got[r.doc_id] == min(t for t, _, least, *_ in types if least is not None and hits[t] >= least)
    assert len(set(got.values())) > 2


def test_plan_does_not_grow_with_the_types(spark, pages):
    size = lambda n: len(type_tables.typed_fields(pages, many(spark, n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(2000) - size(20)) < 200


def many(spark, n):
    """``n`` types of ten keywords that no page has enough of, behind the known ones."""
    ids = spark.range(n)
    words = F.concat(F.array(F.lit("NAME")), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat_ws("-", F.lit("KEY"), ids.id, i)))
    more = ids.select((F.col("id") + 100).cast("int").alias("type_no"), F.concat(F.lit("t"), "id").alias("name"), F.lit(2).alias("least"), F.lit(False).alias("first"), words.alias("keywords"), F.array().cast(f"array<{type_tables.SIGNATURE}>").alias("fields"))
    return type_tables.type_table(spark, signatures.CARD_TYPES).unionByName(more)


def test_two_thousand_types(spark, pages):
    assert rows(type_tables.typed_fields(pages, many(spark, 2000)).select("doc_id", "type", "fields")) == rows(signatures.card_fields(pages))


def test_no_types(spark, pages):
    none = spark.createDataFrame([], type_tables.TYPES)
    assert {r.type for r in type_tables.typed_fields(pages, none).collect()} == {None}


def test_a_keyword_of_all_types_asks_about_none(spark, pages, monkeypatch):
    """Each page with NAME met each of the types before, and all keywords went to the driver for a broadcast."""
    seen, kept = {}, type_tables.kept
    monkeypatch.setattr(type_tables, "kept", lambda df, name: seen.setdefault(name, kept(df, name)))
    type_tables.with_type(pages, many(spark, 2000), 0)
    live = seen["live-keywords"]
    assert live.where("keyword = 'NAME'").count() >= 2000 and live.where("rarer AND type_no >= 100").count() == 0
    assert live.where("rarer AND type_no < 100").count() > 0
