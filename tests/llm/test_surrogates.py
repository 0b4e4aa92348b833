"""Surrogates of crowded forms, and of names, addresses and prose of many shapes."""

import re

import pytest
from pyspark.sql import functions as F

from quillframe.llm import pii
from quillframe.llm.registry import QUERIES
from tests.llm.helpers import documents, plain


def one(spark, *texts):
    rows = pii.replace_entities(documents(spark, list(enumerate(texts)))).select("doc_id", "text").collect()
    return [t for _, t in sorted(tuple(r) for r in rows)]


def test_a_form_all_of_whose_values_are_entities(spark):
    """90,000 numbers of five digits: each gets another, and no two the same."""
    texts = [(None, f"score +{i} points") for i in range(10_000, 100_000)]
    frame = pii.replace_entities(documents(spark, texts).withColumn("n", F.col("text")).repartition(4), key="k")
    pairs = {re.search(r"\d+", r.n)[0]: re.fullmatch(r"score \+(\d{5}) points", r.text)[1] for r in frame.select("n", "text").collect()}
    assert len(pairs) == 90_000 and set(pairs.values()) == set(pairs) and all(a != b for a, b in pairs.items())


@pytest.mark.parametrize(("kind", "values"), [("phone", [f"{i}" for i in range(10, 100)]), ("phone", [f"0{i}" for i in range(10)]), ("iban", [f"DE{i}A" for i in range(10)]), ("key", [f"AKIA{a}{i}" for a in "ABCXYZ" for i in range(10)])])
def test_exchanges_are_permutations(spark, kind, values):
    frame = spark.createDataFrame([(kind, v) for v in values], "kind string, norm string")
    found = {r.norm: r.core for r in frame.select("norm", pii._exchanged(F.col("kind"), F.col("norm"), "k").alias("core")).collect()}
    shape = lambda v: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))
    assert all(a != b and shape(a) == shape(b) for a, b in found.items()) and len(set(found.values())) == len(values)
    assert all(a[: pii.FIXED[kind]] == b[: pii.FIXED[kind]] and (a[0] == "0") == (b[0] == "0") for a, b in found.items())


def test_exchanged_cards_pass_the_same_test(spark):
    cards = ["4111111111111111", "4041894974608795", "4242424242424242", "4111111111111112"]
    frame = spark.createDataFrame([("card", v) for v in cards], "kind string, norm string")
    for r in frame.select("norm", pii._exchanged(F.col("kind"), F.col("norm"), "k").alias("core")).collect():
        luhn = lambda n: sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in n)) % 10 == 0
        assert r.core != r.norm and luhn(r.core) == luhn(r.norm) and r.core[0] == "4" and len(r.core) == 16


def test_names_keep_their_shape(spark):
    new = one(spark, "Mr Sean O'Brien", "Ms Anna-Maria McDonald", "Mr Van Der Berg", "Mr Jan van der Berg", "Mr Donald and Mr BRIEN", "Dr Clara Smith's cat", "Mrs Smith", "Mr. J'Smith-Berg", "Dr von Neumann")
    surname = lambda t: t.split(" ")[-1]
    brien = re.fullmatch(r"Mr [A-Z][a-z]+ O'([A-Z][a-z]+)", new[0])[1]
    anna = re.fullmatch(r"Ms ([A-Z][a-z]+)-([A-Z][a-z]+) Mc([A-Z][a-z]+)", new[1]).groups()
    assert any(anna[0].startswith(x) for x in pii.GIVEN["latin", "f"]) and any(anna[1].startswith(x) for x in pii.GIVEN["latin", "f"])
    berg = re.fullmatch(r"Mr Van Der ([A-Z][a-z]+)", new[2])[1]
    assert re.fullmatch(rf"Mr [A-Z][a-z]+ van der {berg}", new[3])
    assert new[4] == f"Mr {anna[2]} and Mr {brien.upper()}"
    assert new[5].endswith(f" {surname(new[6])}'s cat") and re.fullmatch(r"Mrs [A-Z][a-z]+", new[6])
    assert re.fullmatch(rf"Mr\. [A-Z][a-z]*'{surname(new[6])}-{berg}", new[7]) and re.fullmatch(r"Dr von [A-Z][a-z]+", new[8])
    for gone in ("Brien", "Donald", "Berg", "Smith", "Neumann", "Sean"):
        assert not any(gone in t for t in new)


def test_addresses_keep_their_case(spark):
    upper, lower, mixed = one(spark, "ANNA.B@SOME.ORG", "anna.b@some.org", "Anna.B@Some.ORG")
    assert upper == lower.upper() and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]@[A-Z][a-z]{3}\.ORG", mixed) and mixed.lower() == lower and "anna" not in lower


def test_prose_stays(spark):
    texts = ["auth: required now", "at latitude +12.3456 and longitude +101.25", "the secret: understanding people", "token: something else", "Password: forgotten again"]
    assert one(spark, *texts) == texts
    new = one(spark, "password: hunter2222", 'secret: "swordfish"', "token=something", "auth:something", "call +49.30.1234567")
    assert not any(x in "".join(new) for x in ("hunter", "swordfish", "something", "1234567"))


def test_query_takes_clashing_columns(spark, tmp_path):
    docs = documents(spark, [(1, "mail a.b@c.org"), (2, None), (None, "x")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.n_entities) for r in sorted(QUERIES["op9_pii"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id or 9)] == [(1, 1), (2, 0), (None, 0)]
    again = pii.replace_entities(docs, count_col="n_entities")
    assert sorted(again.columns) == sorted(docs.columns) and sum(r.n_entities for r in again.collect()) == 1


def test_the_key_is_the_session_s(spark):
    docs = documents(spark, [(1, "mail a.b@c.org")])
    drawn = plain(pii.replace_entities(docs), "text")
    assert drawn == plain(pii.replace_entities(docs), "text") and drawn != plain(pii.replace_entities(docs, key="an example key"), "text")
    spark.conf.set("spark.quillframe.pii.key", "a")
    try:
        assert plain(pii.replace_entities(docs), "text") == plain(pii.replace_entities(docs, key="a"), "text") != drawn
    finally:
        spark.conf.unset("spark.quillframe.pii.key")
