"""Settings by name, choice of the backend, the store of crops, and where intermediate results go."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillframe.operators import documents, passport
from quillframe.sources import config, images, store


def test_settings_by_name():
    assert config.RecognizerSettings.read({}) == config.RecognizerSettings()
    found = config.RecognizerSettings.read({"PADDLE_OCR_URL": "http://h:1/x", "PADDLE_OCR_TIMEOUT_SECS": "7", "PADDLE_OCR_QUEUE_TIMEOUT_MS": "0", "PADDLE_OCR_MAX_CONCURRENCY": "3", "PADDLE_OCR_MIN_CONFIDENCE": "1.0", "PADDLE_OCR_API_KEY": "k"})
    assert found == config.RecognizerSettings("http://h:1/x", 7, 0, 3, 1.0, "k")
    for name, value in (("PADDLE_OCR_MAX_CONCURRENCY", "0"), ("PADDLE_OCR_MIN_CONFIDENCE", "1.01"), ("PADDLE_OCR_MIN_CONFIDENCE", "-0.1"), ("PADDLE_OCR_MIN_CONFIDENCE", "nan"), ("PADDLE_OCR_TIMEOUT_SECS", "x"), ("PADDLE_OCR_TIMEOUT_SECS", "-1"), ("PADDLE_OCR_URL", "nowhere")):
        with pytest.raises(ValueError, match=name):
            config.RecognizerSettings.read({name: value})
    assert config.local_min_confidence({"PADDLE_OCR_MIN_CONFIDENCE": "x"}) == config.local_min_confidence({}) == 0.45
    assert config.local_min_confidence({"MRZ_OCR_MIN_CONFIDENCE": "0.6"}, passport=True) == 0.6


def test_backends(spark):
    assert config.backend({}) == "local" and config.backend({"OCR_BACKEND": "paddle"}) == "sidecar"
    with pytest.raises(ValueError, match="OCR_BACKEND"):
        config.backend({"OCR_BACKEND": "other"})
    body = '{"errorCode": 0, "result": {"ocrResults": [%s, %s]}}' % (('{"prunedResult": {"rec_texts": ["a", "b"], "rec_scores": [0.9, 0.8], "rec_polys": [[[1, 2], [3, 2], [3, 4], [1, 4]], [[1, 2], [3, 2], [3, 4], [1, 4]]]}}',) * 2)
    lines = documents.recognized("sidecar", responses=spark.createDataFrame([("d", body)], "doc_id string, body string"))
    assert sorted((r.det_no, r.text) for r in lines.collect()) == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError, match="backend"):
        documents.recognized("other")


def test_dictionary(tmp_path):
    (tmp_path / "symbols").write_text("a\nb\n é\n", encoding="utf-8")
    assert config.dictionary(str(tmp_path / "symbols")) == ["a", "b", " é"]


def test_a_later_crop_overwrites_an_earlier_one(spark, tmp_path):
    path, schema = str(tmp_path / "crops"), "id string, crop_no int, pixels binary"
    images.write_crops(spark.createDataFrame([("a", 1, b"1"), ("b", 1, b"x"), ("b", 1, b"y"), ("b", 1, b"y"), ("c", 5, None)], schema), path)
    images.write_crops(spark.createDataFrame([("a", 2, b"2")], schema), path)
    found = {r.id: (r.crop_no, r.pixels and bytes(r.pixels)) for r in images.read_crops(spark, path).collect()}
    assert images.read_crops(spark, path).count() == 3
    assert found["a"] == (2, b"2") and found["b"][1] in (b"x", b"y") and found["c"] == (5, None)


def test_originals(spark, tmp_path):
    images.write_originals(spark.createDataFrame([("a", b"1", None), ("b", None, "multipart")], "id string, content binary, error_kind string"), str(tmp_path / "o"))
    assert [(r.id, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", b"1")]


def test_first_part_of_any_number(spark):
    parts = [(1, 3, "x", b"3"), (1, 5, "y", b"5"), (2, 2, "x", b"2"), (2, 4, "image", b"4"), (2, 6, "image", b"6"), (3, None, None, None), (4, 9, "z", b"")]
    found = images.first_upload(spark.createDataFrame(parts, "request_id int, part_no int, name string, content binary"))
    assert {r.request_id: (r.content and bytes(r.content), r.error_kind) for r in found.collect()} == {1: (b"3", None), 2: (b"6", None), 3: (None, "missing_image"), 4: (bytearray(b""), "empty_image")}


def test_today_is_that_of_utc(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Pacific/Kiritimati", "Pacific/Pago_Pago", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert abs((spark.range(1).select(passport.today_in_utc()).first()[0] - datetime.datetime.now(datetime.UTC).date()).days) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(Session())
    path = store.written(spark.range(3), "some")
    assert store.exists(spark, path)
    store.clean_up(spark)
    assert not store.exists(spark, path)


def test_only_images_that_are_asked_for_are_joined(spark):
    schema = "id string, height int, width int, data binary, error_kind string"
    held = spark.createDataFrame([(str(i), 8, 8, bytes(192), None) for i in range(20)], schema)
    asked = spark.createDataFrame([("3", [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)]), ("x", [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)])], "id string, corners array<struct<x: float, y: float>>")
    crops, failures = documents.crop(asked, held)
    assert [r.id for r in crops.collect()] == ["3"] and [(r.id, r.error_kind) for r in failures.collect()] == [("x", "not_found")]
    assert "LeftSemi" in crops._jdf.queryExecution().executedPlan().toString()
