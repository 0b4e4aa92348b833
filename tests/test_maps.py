"""Heatmaps, model inputs and dictionaries as plans, against the kernels that work on one image."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import geometry, tensors
from quillframe.operators import blobs, kernels
from quillframe.sources import dictionary

MAPS = "id long, grid array<float>, n string"


def grids(spark, arrays, start=0):
    return spark.createDataFrame([(start + i, np.asarray(a, np.float32).ravel().tolist(), "other") for i, a in enumerate(arrays)], MAPS)


def test_largest_blobs_are_those_of_one_image(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.random((9, 12)) ** k for k in (1, 1, 2, 3, 5) for _ in range(4)]
    found = {r["id"]: (r["x"], r["y"]) for r in blobs.largest_blobs(grids(spark, arrays), 12).collect()}
    wanted = {i: c for i, a in enumerate(arrays) if (c := kernels.largest_blob(a.astype(np.float32)))}
    assert found.keys() == wanted.keys() and all(np.allclose(found[i], wanted[i]) for i in wanted)


def test_a_long_region_is_one(spark):
    snake = np.zeros((41, 41))
    snake[::2] = 1
    for y in range(1, 41, 2):
        snake[y, -1 if y % 4 == 1 else 0] = 1
    rows = blobs.blobs(blobs.label_cells(grids(spark, [snake]), 41), 41).collect()
    assert [(r["n"], r["blob"]) for r in rows] == [(int(snake.sum()), 0)]


def test_maps_without_cells_and_odd_values(spark):
    nan, null = float("nan"), None
    rows = [(1, [], "a"), (2, None, "b"), (3, [nan, null, 0.3, 0.0], "c"), (None, [1.0] * 4, "d"), (4, [0.0, 0.0, 0.5, nan], "e"), (5, [0.4, 0.0, 0.0, 0.0], "f")]
    found = blobs.largest_blobs(spark.createDataFrame(rows, MAPS), 2)
    assert sorted(map(tuple, found.collect())) == [(4, 1, 0.0, 1.0), (5, 1, 0.0, 0.0)]
    assert blobs.largest_blobs(spark.createDataFrame([], MAPS), 2).collect() == []


def test_of_equal_regions_the_first_stays(spark):
    assert [tuple(r) for r in blobs.largest_blobs(grids(spark, [[[0, 1, 0, 1], [0, 1, 0, 1]]]), 4).collect()] == [(0, 2, 1.0, 0.5)]


def test_masked_means(spark):
    rng = np.random.default_rng(4)
    cases = [(rng.random((6, 8)).astype(np.float32), (rng.random((4, 2)) * 2 + np.array([[0, 0], [4, 0], [4, 4], [0, 4]]) + rng.integers(-5, 6, 2)).astype(float)) for _ in range(60)]
    rows = [(i, g.ravel().tolist(), [{"x": x, "y": y} for x, y in q.tolist()]) for i, (g, q) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, grid array<float>, quad array<struct<x:double,y:double>>")
    found = dict(df.select("id", tensors.masked_mean(F.col("grid"), 8, F.col("quad"))).collect())
    assert all(found[i] == pytest.approx(kernels.masked_mean(g.astype(float), q), abs=1e-9) for i, (g, q) in enumerate(cases))
    assert 0 < sum(v == 0 for v in found.values()) < 60


def test_planes(spark):
    image = np.random.default_rng(5).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    df = spark.createDataFrame([(image.ravel().tolist(),), ([],), (None,)], "p array<int>")
    one, empty, null = df.select(tensors.imagenet_planes(F.col("p")), tensors.line_planes(F.col("p"))).collect()
    assert np.allclose(one[0], kernels.imagenet_planes(image).ravel(), atol=1e-6) and np.array_equal(np.float32(one[1]), kernels.line_planes(image).ravel())
    assert tuple(empty) == ([], []) and tuple(null) == (None, None)


def test_straightening(spark):
    rng = np.random.default_rng(6)
    quads = [(np.array([[0, 0], [50, 0], [50, 30], [0, 30]]) + rng.random((4, 2)) * 20).tolist() for _ in range(30)]
    flat = [[0, 0], [10, 0], [20, 0], [0, 10]]
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in q]) for i, q in enumerate([*quads, flat])]
    df = spark.createDataFrame(rows, "id int, quad array<struct<x:double,y:double>>").withColumn("m", geometry.straightening(F.col("quad"), F.lit(61), F.lit(37)))
    found = df.select("id", geometry.project(F.col("m"), F.lit(23.5), F.lit(17.25)).alias("p")).collect()
    for r in found[:-1]:
        at = kernels.homography(quads[r["id"]], [[0, 0], [60, 0], [60, 36], [0, 36]]) @ [23.5, 17.25, 1]
        assert np.allclose((r["p"]["x"], r["p"]["y"]), at[:2] / at[2])
    assert found[-1]["p"]["x"] is None


@pytest.mark.parametrize("body, symbols", [("a\nb\n é\n", ["", "a", "b", " é", " "]), ("a\r\n\r\nb", ["", "a", "", "b", " "]), ("", ["", " "])])
def test_a_dictionary_keeps_its_order(spark, tmp_path, body, symbols):
    (tmp_path / "symbols").write_bytes(body.encode())
    assert [tuple(r) for r in dictionary.read_dictionary(spark, str(tmp_path / "symbols")).orderBy("at").collect()] == list(enumerate(symbols))


def test_files_of_a_dictionary_follow_each_other(spark, tmp_path):
    for name in "ba":
        (tmp_path / name).write_text(f"{name}\n{name}2\n")
    assert [r["symbol"] for r in dictionary.read_dictionary(spark, str(tmp_path)).orderBy("at").collect()] == ["", "a", "a2", "b", "b2", " "]


def test_outputs_read_with_a_dictionary(spark, tmp_path):
    (tmp_path / "symbols").write_text("a\nb\n")
    symbols = dictionary.read_dictionary(spark, str(tmp_path / "symbols")).repartition(3)
    step = lambda k, v: [v if i == k else 0.0 for i in range(4)]
    rows = [(1, [step(1, 0.5), step(1, 0.5), step(0, 0.9), step(2, 1.0), step(3, 0.75)], "old"), (2, [], "old"), (3, None, "old")]
    outputs = spark.createDataFrame(rows, "id int, logits array<array<float>>, text string")
    found = dictionary.decode_outputs(outputs, symbols)
    assert found.columns == ["id", "logits", "text", "confidence"]
    assert [(r["id"], r["text"], r["confidence"]) for r in found.orderBy("id").collect()] == [(1, "ab ", 0.75), (2, "", 0.0), (3, None, None)]
    assert math.isclose(found.where("id = 1").first()["confidence"], 0.75)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
