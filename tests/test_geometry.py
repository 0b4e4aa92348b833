"""Quads, sizes and decoding of model outputs."""

import itertools
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import geometry, tensors

QUAD = "doc int, q array<struct<x: float, y: float>>, w int, h int"


def quads(spark, rows):
    return spark.createDataFrame([(i, q, w, h) for i, (q, w, h) in enumerate(rows)], QUAD)


def points(row):
    return [(p.x, p.y) for p in row]


def test_corners_in_any_order(spark):
    want = [(10.0, 10.0), (90.0, 12.0), (95.0, 80.0), (8.0, 85.0)]
    frame = quads(spark, [(list(p), 100, 100) for p in itertools.permutations(want)])
    assert {tuple(points(r.q)) for r in frame.select(geometry.order_corners(F.col("q")).alias("q")).collect()} == {tuple(want)}


def test_ties_of_corners(spark):
    q = [(0.0, 2.0), (1.0, 1.0), (2.0, 0.0), (1.0, 1.0)]
    found = quads(spark, [(q, 10, 10)]).select(geometry.order_corners(F.col("q")).alias("q")).first().q
    assert points(found) == [(0, 2), (2, 0), (1, 1), (0, 2)]


def test_expanding_stays_inside(spark):
    found = quads(spark, [([(0.0, 0.0), (99.0, 0.0), (99.0, 49.0), (0.0, 49.0)], 100, 50), ([(40.0, 20.0), (60.0, 20.0), (60.0, 30.0), (40.0, 30.0)], 100, 50)])
    rows = found.orderBy("doc").select(geometry.expand_quad(F.col("q"), F.col("w"), F.col("h")).alias("q")).collect()
    assert points(rows[0].q) == [(0, 0), (99, 0), (99, 49), (0, 49)]
    assert np.allclose(points(rows[1].q), [(39.75, 19.875), (60.25, 19.875), (60.25, 30.125), (39.75, 30.125)])


def test_crop_errors(spark):
    square = [(10.0, 10.0), (60.0, 10.0), (60.0, 60.0), (10.0, 60.0)]
    cases = [
        (square, None), ([(math.nan, 1.0), *square[1:]], 0), ([(math.inf, 1.0), *square[1:]], 0), ([(100.0, 1.0), *square[1:]], 0), ([(-0.5, 1.0), *square[1:]], 0),
        ([(10.0, 10.0), (11.9, 10.0), (11.9, 60.0), (10.0, 60.0)], 1), ([(10.0, 10.0), (60.0, 60.0), (60.0, 60.0), (10.0, 10.0)], 1), ([(10.0, 10.0), (20.0, 10.0), (40.0, 10.0), (30.0, 10.0)], 3),
    ]
    rows = quads(spark, [(q, 100, 100) for q, _ in cases]).orderBy("doc").select(geometry.crop_error(F.col("q"), F.col("w"), F.col("h")).alias("e")).collect()
    assert [r.e for r in rows] == [None if k is None else geometry.CROP_ERRORS[k] for _, k in cases]
    huge = quads(spark, [([(0.0, 0.0), (20000.0, 0.0), (20000.0, 9.0), (0.0, 9.0)], 30000, 100)])
    assert huge.select(geometry.crop_error(F.col("q"), F.col("w"), F.col("h")).alias("e")).first().e == geometry.CROP_ERRORS[2]


def test_detector_sizes(spark):
    cases = {(480, 640): (480, 640), (10, 1000): (64, 4000), (5000, 5000): (4000, 4000), (100, 47): (128, 64), (33, 65): (64, 128)}
    frame = spark.createDataFrame(list(cases), "h int, w int").select(geometry.detector_size(F.col("h"), F.col("w")).alias("s"))
    found = [tuple(r.s) for r in frame.collect()]
    # 10 x 1000 grows by 6.4 to 64 x 6400, is cut to 40 x 4000, and rounds up to 32 at least.
    assert found == [(480, 640), (32, 4000), (4000, 4000), (128, 64), (64, 128)]


def test_growing_and_scaling_boxes(spark):
    row = spark.range(1).select(geometry.unclip(F.lit(30), F.lit(10)).alias("u"), geometry.unclip(F.lit(0), F.lit(0)).alias("z"), geometry.recognizer_width(F.lit(320), F.lit(32)).alias("w"), geometry.recognizer_width(F.lit(9999), F.lit(3)).alias("m")).first()
    assert np.allclose(tuple(row.u), (41.25, 21.25)) and tuple(row.z) == (0, 0) and (row.w, row.m) == (480, 2000)
    quad = quads(spark, [([(10.0, 10.0), (300.0, 10.0), (300.0, 50.0), (-4.0, 50.0)], 100, 40)])
    scaled = quad.select(geometry.rescale_box(F.col("q"), F.lit(2.0), F.lit(2.0), F.col("w"), F.col("h")).alias("q")).first().q
    assert points(scaled) == [(5, 5), (99, 5), (99, 25), (0, 25)]


def test_ctc(spark):
    # Symbols by step: a a blank a b b out-of-range; NaN never wins.
    steps = [[0, 9, 0, 0], [0, 8, 0, 0], [7, 0, 0, 0], [0, 6, 0, 0], [0, float("nan"), 5, 0], [0, 0, 4, 0], [0, 0, 0, 3]]
    frame = spark.createDataFrame([([[float(v) for v in s] for s in steps],), ([[1.0, 0.0]],), ([],)], "x array<array<float>>")
    found = [r.d for r in frame.select(tensors.ctc_decode(F.col("x"), F.array(F.lit(""), F.lit("a"), F.lit("b"))).alias("d")).collect()]
    assert found[0].text == "aab" and found[0].confidence == np.float32((9 + 6 + 5 + 3) / 4)
    assert [(d.text, d.confidence) for d in found[1:]] == [("", 0.0), ("", 0.0)]


def test_mask_centroid(spark):
    grid = [0.0] * 16
    grid[5] = grid[6] = 0.9
    frame = spark.createDataFrame([(grid,), ([0.3] * 16,)], "g array<float>")
    found = [r.c for r in frame.select(tensors.mask_centroid(F.col("g"), 4).alias("c")).collect()]
    assert tuple(found[0]) == (1.5, 1.0) and found[1] is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 500)), min_size=4, max_size=4, unique=True))
def test_shoelace(spark, corners):
    q = [(float(x), float(y)) for x, y in corners]
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1])))
    assert quads(spark, [(q, 9, 9)]).select(geometry.twice_area(F.col("q")).alias("a")).first().a == want
