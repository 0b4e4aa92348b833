"""Lines read in batches against lines read one by one, and fields by a table function."""

import numpy as np
from pyspark.sql import functions as F

from quillframe.functions import udtf
from quillframe.operators import documents, layout
from tests.test_layout import SCHEMA
from tests.test_wide import scattered

STRIDE, SYMBOLS = 8, ["", *"abcdefg"]


def detector(planes):
    """Bars of text of several widths, other ones for other images."""
    out = np.zeros(planes.shape[1:], np.float32)
    shift = int(abs(planes[0, 0, 0]) * 7) % 9
    for k, (top, width) in enumerate([(6, 30), (24, 48), (42, 20 + shift)]):
        out[top : top + 10, 6 : 6 + width + 2 * k] = 0.9
    return out


def read(planes):
    """Logits of each step depend on the columns of that step alone."""
    steps = -(-planes.shape[-1] // STRIDE)
    padded = np.zeros((*planes.shape[:-1], steps * STRIDE), np.float32)
    padded[..., : planes.shape[-1]] = planes
    cells = padded.reshape(*planes.shape[:-1], steps, STRIDE).sum(axis=(-4, -3, -1))
    return np.stack([np.cos(cells * (k + 1)) for k in range(len(SYMBOLS))], axis=-1).astype(np.float32)


def test_batches(spark):
    rng = np.random.default_rng(2)
    images = [(f"i{i}", 64, 64, bytearray(rng.integers(0, 256, 64 * 64 * 3, dtype=np.uint8).tobytes()), None) for i in range(9)] + [("bad", 1, 1, None, "decode")]
    frame = spark.createDataFrame(images, "id string, height int, width int, data binary, error_kind string").repartition(2)
    reader = documents.LineReader(detector, lambda line: (0.2, 0.8) if line[0, 0, 0] % 2 else (0.8, 0.2), read, SYMBOLS)
    one = documents.recognize(frame, reader)
    calls = spark.sparkContext.accumulator(0)

    def counted(planes):
        calls.add(1)
        return read(planes)

    lines = documents.line_images(frame, reader)
    many = documents.read_in_batches(lines, counted, SYMBOLS, lambda wide: -(-wide // STRIDE), size=4, bucket=64)
    got = {(r.doc_id, r.det_no): (r.text, round(r.confidence, 4), r.polygon) for r in many.collect()}
    used, n = calls.value, len(got)
    assert got == {(r.doc_id, r.det_no): (r.text, round(r.confidence, 4), r.polygon) for r in one.collect()} and n == 27
    assert n / 4 <= used < n / 2 and "Exchange" not in lines.select("wide")._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]
    assert documents.read_in_batches(lines.limit(0), read, SYMBOLS, lambda wide: wide).count() == 0


def test_table_function(spark):
    made = [line for d in range(8) for line in scattered(d, 40, [200, 400, 800, 1500][d % 4], d)] + [(9, 0, None, 0.9, [[0, 0], [1, 0], [1, 1], [0, 1]]), (9, 1, "x", None, [[0, 0], [1, 0], [1, 1], [0, 1]])]
    frame = spark.createDataFrame(made, SCHEMA).repartition(3)
    frame.createOrReplaceTempView("udtf_lines")
    udtf.register(spark)
    found = spark.sql("SELECT * FROM page_fields(TABLE(udtf_lines) PARTITION BY doc_id ORDER BY det_no)")
    want = layout.explode_fields(layout.pages(frame).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
