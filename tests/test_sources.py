"""Multipart bodies, the store of crops, rows apart, and the functions of SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillframe.functions import mrz, sql, text
from quillframe.sources import crop_store, multipart, quarantine

TYPE = "multipart/form-data; boundary=B7"


def body(*parts, end="--B7--\r\n", mark="B7", preamble=b""):
    """A body of parts (headers, content)."""
    out = preamble
    for headers, content in parts:
        out += f"--{mark}\r\n".encode() + "".join(f"{h}\r\n" for h in headers).encode() + b"\r\n" + content + b"\r\n"
    return out + end.encode()


def named(name, extra=""):
    return f'Content-Disposition: form-data; name="{name}"{extra}'


def parse(spark, *requests):
    frame = spark.createDataFrame([(i, t, None if b is None else bytearray(b)) for i, (t, b) in enumerate(requests)], "request_id int, content_type string, body binary")
    return [(r.request_id, r.part_no, r.name, r.filename, r.type, None if r.content is None else bytes(r.content), r.error_kind) for r in multipart.parse_multipart(frame).orderBy("request_id", "part_no").collect()]


def test_bodies(spark):
    every = bytes(range(256)) * 3
    nested = b'--inner\r\n\r\ntext\r\n--B7x\r\n --B7\r\n--inner--'
    found = parse(
        spark,
        (TYPE, body(([named("image", '; filename="a b.jpg"'), "Content-Type: image/jpeg"], every), ([named("note")], b""))),
        ('Multipart/Form-Data; charset=x; boundary="B7"', body((["X: y", named("ünï").encode().decode("latin-1").encode("latin-1").decode()], nested), preamble=b"hello\r\n")),
        (TYPE, body(([], b"no head"), (["Content-Disposition: form-data"], b"no name"))),
        (TYPE, b"--B7--"),
        (TYPE, b"--B7 \t\r\n\r\nx\r\n--B7--\r\nepilogue --B7--"),
    )
    assert found == [
        (0, 0, "image", "a b.jpg", "image/jpeg", every, None), (0, 1, "note", None, None, b"", None),
        (1, 0, "ünï", None, None, nested, None),
        (2, 0, None, None, None, b"no head", None), (2, 1, None, None, None, b"no name", None),
        (3, None, None, None, None, None, None),
        (4, 0, None, None, None, b"x", None),
    ]


def test_bad_bodies_are_one_row(spark):
    good = body(([named("image")], b"pixels"))
    bad = [(TYPE, good[:-6]), (TYPE, good[:30]), (TYPE, b""), (TYPE, None), (None, good), ("application/json", good), ("multipart/form-data", good), ("multipart/form-data; boundary=C", good), (TYPE, b"--B7\r\nX: y\r\n--B7--")]
    assert parse(spark, *bad) == [(i, None, None, None, None, None, "multipart") for i in range(len(bad))]


def test_uploads(spark):
    frame = spark.createDataFrame([(0, TYPE, bytearray(body(([named("a")], b"1"), ([named("image")], b"2")))), (1, TYPE, bytearray(b"--B7--")), (2, TYPE, bytearray(body(([named("a")], b"")))), (3, TYPE, bytearray(b"x")), (4, TYPE, bytearray(body(([named("a")], b"1" * 200))))], "request_id int, content_type string, body binary")
    got = {r.request_id: (r.content and bytes(r.content), r.error_kind) for r in multipart.uploads(frame, limit=150).collect()}
    assert got == {0: (b"2", None), 1: (None, "missing_image"), 2: (bytearray(b""), "empty_image"), 3: (None, "multipart"), 4: (None, "multipart")}


def crops(spark, *rows):
    return spark.createDataFrame([(i, n, bytearray(p)) for i, n, p in rows], "id string, crop_no int, pixels binary")


def test_ten_crops_of_an_id_leave_one(spark, tmp_path):
    path = str(tmp_path / "crops")
    for n in range(10):
        crop_store.add_crops(crops(spark, ("a", n, b"%d" % n), (f"other{n}", n, b"x")), path, buckets=8)
    assert {r.id: bytes(r.pixels) for r in crop_store.crops(spark, path).collect()} == {"a": b"9"} | {f"other{n}": b"x" for n in range(10)}
    assert spark.read.parquet(path).count() == 20
    assert crop_store.compact(spark, path) == 1
    assert spark.read.parquet(path).count() == 11 and crop_store.compact(spark, path) == 0
    assert {r.id: bytes(r.pixels) for r in crop_store.crops(spark, path).collect()} == {"a": b"9"} | {f"other{n}": b"x" for n in range(10)}
    one = crop_store.crops_of(spark, path, ["a"])
    assert [(r.id, r.crop_no) for r in one.collect()] == [("a", 9)]
    assert crop_store.crops_of(spark, path, []).count() == 0
    read = spark.read.parquet(path)
    assert "bucket_of_8 IN" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0] or "bucket_of_8#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert len(crop_store.crops_of(spark, path, ["a"]).inputFiles()) <= len(read.inputFiles())


def test_rows_apart(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "decode").when(F.col("id") % 25 == 1, "strange").alias("error_kind"))
    counts = quarantine.write_apart(rows, str(tmp_path / "apart"))
    assert counts == {"good": 860, "bad": 140, "decode": 100, "other": 40}
    assert quarantine.good_rows(spark, str(tmp_path / "apart")).count() == 860
    assert {r.error_kind for r in quarantine.bad_rows(spark, str(tmp_path / "apart")).collect()} == {"decode", "strange"}
    assert quarantine.write_apart(rows.limit(0), str(tmp_path / "none")) == {"good": 0, "bad": 0}


def test_rows_apart_are_scanned_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(i):
        seen.add(1)
        return "decode" if i % 2 else None

    quarantine.write_apart(spark.range(100).select("id", kind("id").alias("error_kind")), str(tmp_path / "once"))
    assert seen.value == 100


@pytest.mark.parametrize("s", ["L898902C3", "", "<<<", "740812", "ab1", None, "日本"])
def test_check_digits_in_sql(spark, s):
    sql.register(spark)
    row = spark.createDataFrame([(s,)], "s string").select(F.expr("mrz_check_digit(s)").alias("a"), mrz.check_digit(F.col("s")).cast("int").alias("b")).first()
    assert row.a == row.b


def test_functions_of_sql(spark):
    sql.register(spark)
    one = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    dates = ["06 APR 2011", "6 xx/APR 11", "123 APR 2001", "APR", "", "31 FEB 2001", "1 may june 2020"]
    frame = spark.createDataFrame([(d,) for d in dates], "s string")
    assert all(r.a == r.b for r in frame.select(F.expr("printed_date(s)").alias("a"), text.printed_date_iso(F.col("s")).alias("b")).collect())
    assert one("label_value('*NAME*: Asha ')") == ("NAME", "Asha") and one("label_value(': x')") is None
    line1, line2 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    zone = one(f"mrz_parse('{line1}', '{line2}', DATE'2025-01-01')")
    parsed = spark.range(1).select(mrz.parse(F.lit(line1), F.lit(line2), F.lit(datetime.date(2025, 1, 1))).alias("z")).first().z
    assert zone.asDict() == {k: parsed[k] for k in zone.asDict()}
    assert one("mrz_parse('x', 'y', DATE'2025-01-01')") is None
    assert one(f"mrz_line('{line1[:40].lower()}')") == line1[:40] + "<<<<" and one("mrz_line('short')") is None


def test_heads_of_parts_in_odd_forms(spark):
    heads = ['Content-Disposition: form-data; name="a\\"b;c=d"; filename=x.png', 'CONTENT-DISPOSITION: form-data; NAME=q=1; filename=""', "Content-Disposition: form-data; name=", 'X: y\r\ncontent-disposition:form-data;name="' + "n" * 20000 + '"\r\nContent-TYPE:  image/png ', "X: content-disposition: a; name=b", 'Content-Disposition: form-data; filename="f"']
    body = "".join(f"--B7\r\n{h}\r\n\r\n{i}\r\n" for i, h in enumerate(heads)) + "--B7--"
    got = [r[2:5] for r in parse(spark, (TYPE, body.encode()))]
    assert got == [('a"b;c=d', "x.png", None), ("q=1", "", None), ("", None, None), ("n" * 20000, None, "image/png"), (None, None, None), (None, "f", None)]


def test_requests_are_read_once(spark):
    """Good and failed ones were read apart, each from the whole body."""
    made = multipart.uploads(spark.createDataFrame([(1, TYPE, b"x"), (1, TYPE, b"--B7--"), (1, TYPE, b"y")], "request_id long, content_type string, body binary"))
    assert sorted((r.request_id, r.content, r.error_kind) for r in made.collect()) == [(1, None, "missing_image"), (1, None, "multipart"), (1, None, "multipart")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
