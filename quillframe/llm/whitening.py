"""Embedding whitening by TSQR.

Exact integer sums centre the rows; a QR of the rows of each partition leaves one triangle; triangles are stacked and
factored again up a tree; the right singular vectors of the last triangle are the components. No covariance matrix is
formed, so small eigenvalues keep the digits that squaring would cost. Only sums, triangles and one model for each
vector length move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import durable

#: Bytes of the triangles that one task stacks at a time, and rows that are stacked upon a triangle.
STACK_BYTES, ROWS = 64 << 20, 4096
#: Entries beyond this many bits are no numbers to count with: their rows count as not finite.
ENTRY_BITS = 52
#: A singular value below this share of the largest (times the dimensions) is none: rounding makes such of no variance.
NONE = 2.0**-48


def _integers(batch: pa.RecordBatch, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, x) of its valid vectors, for each length: x = floor(scale * c) + shift as 64-bit integers."""
    lists = batch.column("x")
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    good = ~np.asarray(lists.is_null()) & (size > 0)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    for dim in np.unique(size[good]):
        at = np.flatnonzero(good & (size == dim))
        x = np.floor(scale * values[offsets[at][:, None] + np.arange(dim)])
        fits = (np.abs(x) < 2.0**ENTRY_BITS).all(axis=1)  # false for nan and infinities
        if fits.any():
            yield at[fits], x[fits].astype(np.int64) + shift


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold the squares' sum too, else Python's."""
    # n * x - S = n * (x - S // n) - S % n keeps the products as small as the spread of the data.
    whole, rest = np.array([s // n for s in sums], object), np.array([s % n for s in sums], object)
    near = x - whole.astype(np.int64)
    most = int(np.abs(near).max(initial=0)) * n + n
    if most * most * x.shape[1] < 2**63:
        return near * n - rest.astype(np.int64)
    return near.astype(object) * n - rest


def _sums(scale: float, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in _integers(batch, scale, shift):
                held = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                held[0] += len(x)
                for i in range(0, len(x), 512):  # 512 entries of 53 bits stay within 64
                    held[1] = held[1] + x[i : i + 512].sum(axis=0).astype(object)
        for dim, (n, sums) in total.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "place": list(range(dim)), "n": [n] * dim, "total": [str(s) for s in sums]}, pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    return run


def _stack(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def _triangles(centres: dict[int, tuple[int, list[int]]], scale: float, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _integers(batch, scale, shift):
                n, sums = centres[x.shape[1]]
                for i in range(0, len(x), ROWS):
                    centred = _deviations(x[i : i + ROWS], n, sums).astype(np.float64) / n
                    held[x.shape[1]] = _stack(held.get(x.shape[1]), centred)
        for dim, triangle in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([triangle.tobytes()])], ["dim", "triangle"])

    return run


def _merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    (dim, no), merged = key, None
    for data in frame["triangle"]:
        merged = _stack(merged, np.frombuffer(data).reshape(-1, int(dim)))
    return pd.DataFrame({"dim": [dim], "triangle": [merged.tobytes()], "no": [no]})


def _project(centres: dict[int, tuple[int, list[int]]], models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], scale: float, shift: int):
    """(dim, id, deviation as text, whitened) of each valid row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _integers(batch, scale, shift):
                dim = x.shape[1]
                (n, sums), (axes, deviation, _) = centres[dim], models[dim]
                far = _deviations(x, n, sums)
                square = (far * far).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = (far.astype(np.float64) / n) @ axes / deviation
                white = np.where(deviation > 0, white, np.nan)
                found = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), batch.column("id").take(pa.array(at)), pa.array([str(s) for s in square]), found], ["dim", "id", "deviation", "white"])

    return run


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double,
    deviation_exact decimal(38,0): a row for each valid vector and each of the first ``components`` components.

    Entries c become the integers x = floor(scale * c) + shift. Vectors that are null or empty, or hold entries that are null, not
    finite, or scaled beyond 52 bits, are dropped. Rows without an id and rows that repeat another take part like others. ``deviation`` is
    the exact sum of (n*x-S)^2 over the dimensions; where 64 bits don't hold it, it is null, and ``deviation_exact`` holds it.
    ``whitened`` is null for a component without variance (constant or dependent dimensions, a lone vector), whose ``explained`` is 0,
    and ``explained`` is null where nothing varies. Vectors of each length are a list of their own, with its own n, components and
    error. ``identity_error`` is the largest absolute entry of the covariance of what is whitened, minus the identity;
    components without variance take no part in it. Tied eigenvalues have any basis of their space. An empty table gives no rows. Other columns are not read.

    The vectors are read three times: for the sums, the triangles and the projection.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    parts = read.mapInArrow(_sums(scale, shift), "dim int, place int, n long, total string")
    sums = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    centres: dict[int, tuple[int, list[int]]] = {}
    for row in durable(sums, "sums").orderBy("dim", "place").collect():  # one row for each dimension
        centres.setdefault(row["dim"], (row["n"], []))[1].append(int(row["total"]))
    triangle = durable(read.mapInArrow(_triangles(centres, scale, shift), "dim int, triangle binary").withColumn("no", F.spark_partition_id()), "triangles")
    fan = max(2, min(64, STACK_BYTES // max(1, 8 * max(centres, default=1) ** 2)))
    while (triangle.agg(F.max("no")).first()[0] or 0) > 0:
        merged = triangle.groupBy("dim", F.expr(f"no div {fan}").cast("int").alias("no")).applyInPandas(_merge, "dim int, triangle binary, no int")
        triangle = durable(merged, "triangles")
    models = {}
    for row in triangle.collect():  # one triangle for each length of vectors
        dim = row["dim"]
        _, sigma, axes = np.linalg.svd(np.frombuffer(row["triangle"]).reshape(-1, dim), full_matrices=True)
        sigma = np.r_[sigma, np.zeros(dim - len(sigma))]
        sigma[sigma <= sigma.max(initial=0.0) * dim * NONE] = 0.0
        spread = (sigma**2).sum()
        kept = min(components, dim)
        models[dim] = axes[:kept].T, sigma[:kept] / np.sqrt(centres[dim][0]), (sigma[:kept] ** 2 / spread if spread else np.full(kept, np.nan))
    white = durable(read.mapInArrow(_project(centres, models, scale, shift), "dim int, id long, deviation string, white array<double>"), "whitened")
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    item = lambda i: F.get("white", F.lit(i))
    off = [F.abs(F.covar_pop(item(i), item(j)) - (1.0 if i == j else 0.0)) for i, j in pairs]
    spreads = white.groupBy("dim").agg(F.array_max(F.array_compact(F.array(*off))).alias("identity_error"))
    shape = "dim int, n long, explained array<double>"
    facts = white.sparkSession.createDataFrame([(dim, centres[dim][0], [None if np.isnan(e) else float(e) for e in model[2]]) for dim, model in models.items()], shape)
    found = white.join(F.broadcast(facts.join(spreads, "dim")), "dim")  # a row for each length of vectors
    exact = F.col("deviation").try_cast("decimal(38,0)")
    rows = found.select("id", "n", exact.alias("deviation_exact"), "explained", "identity_error", F.posexplode("white").alias("place", "whitened"))
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), "n", F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened", F.get("explained", F.col("place")).alias("explained"), "identity_error", "deviation_exact",
    )
