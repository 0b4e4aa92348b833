"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks of integer vectors, of the narrowest type that holds them, and dealt to a
grid: a cell holds some query blocks, and some candidate blocks pass by them, one matrix product for each pair. Rounds of
global histograms, summed up within a cell first, narrow for each query the range of scores that holds its kth value; then
the candidates that reach it are kept and ties go to the smaller id. Only counts and the final rows leave a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import durable

#: Vectors of a block of candidates, and of queries; bins of a histogram; query blocks that a cell holds at most.
CANDIDATES, QUERIES, BINS, HELD = 4096, 512, 1024, 16


def _narrow(matrix: np.ndarray) -> tuple[int, bytes]:
    """Bytes of an element, and the elements, of the narrowest of 16, 32 and 64 bits."""
    most = int(np.abs(matrix).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, matrix.astype(f"<i{width}").tobytes()


def _blocks(rows: int, scale: float):
    """Packs valid vectors into blocks: (dim, n, ids, width, vectors, most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, values = zip(*held.pop(dim))
            matrix = np.stack(values)
            width, data = _narrow(matrix)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([width], pa.int32()), pa.array([data]), pa.array([float(np.abs(matrix).max(initial=0))])],
                ["dim", "n", "ids", "width", "vectors", "most"],
            )

        for batch in batches:
            for vec, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                if vec is None or x is None:
                    continue
                x = np.asarray(x, np.float64)  # null components become nan
                if not np.isfinite(x).all():
                    continue
                scaled = np.floor(scale * x)
                if np.abs(scaled).max(initial=0) >= 2**62:
                    raise ValueError(f"vector {vec}: a scaled component does not fit 64 bits")
                held.setdefault(len(x), []).append((vec, scaled.astype(np.int64)))
                if len(held[len(x)]) == rows:
                    yield block(len(x))
        for dim in list(held):
            yield block(dim)

    return run


_BLOCK = "dim int, n int, ids binary, width int, vectors binary, most double"


def _scores(queries: np.ndarray, vectors: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products, exact: in floating point where every sum stays within its mantissa, else in integers."""
    dim = vectors.shape[1]
    if most * dim < 2**24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if most * dim < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    wide = queries.astype(object) @ vectors.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)  # scores beyond 64 bits end at their limit


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, float]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(row["n"], row["dim"]), row["most"]


def _over_cells(start, meet, finish, columns: list[str], kinds: list[pa.DataType]):
    """Goes through cells: ``start`` of each query block makes what is held of it, ``meet`` gives rows for it and a candidate
    block (or none), ``finish`` rows at the end of the cell. Rows are tuples of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], columns)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["gq"], row["gc"]) != cell:
                    yield from (out(r) for h in held if (r := finish(h)) is not None)
                    cell, held = (row["gq"], row["gc"]), []
                if row["side"] == 0:
                    held.append(start(row))
                    continue
                ids, vectors, most = _unpack(row)
                for h in held:
                    if h["dim"] == row["dim"] and (r := meet(h, ids, _scores(h["vectors"], vectors, most * h["most"]))) is not None:
                        yield out(r)
        yield from (out(r) for h in held if (r := finish(h)) is not None)

    return run


def grid(queries: int, candidates: int, tasks: int, query_bytes: float, candidate_bytes: float) -> tuple[int, int]:
    """Groups of query blocks and of candidate blocks, about ``tasks`` cells: a candidate block is sent to as many cells as there
    are query groups and the other way round, so the groups balance the bytes sent. A group holds at most ``HELD`` query blocks."""
    balanced = math.sqrt(tasks * queries * query_bytes / max(1.0, candidates * candidate_bytes))
    of_queries = min(queries, max(-(-queries // HELD), round(balanced), 1))
    return of_queries, min(candidates, max(1, -(-tasks // of_queries)))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS) -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the ``k`` highest scores of each query over all other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``. Ties go to the smaller
    id. Rows take no part whose id is null or whose vector is null or holds null or non-finite components; vectors of
    different lengths have no score, and empty ones score 0. Every row is a candidate, so a row that repeats an id and vector has a
    rank of its own; rows that repeat a query are one query, and none is compared with its own id. A lone vector gets no
    rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = durable(vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("x")), "vectors")
    # Full blocks, however finely the input was dealt: their number decides how many products there are.
    blocks = durable(rows.coalesce(max(1, -(-rows.count() // (CANDIDATES * 4)))).mapInArrow(_blocks(CANDIDATES, scale), _BLOCK), "candidates")
    wanted = rows.where(F.col("vec") % every == 0).distinct()
    asked = durable(wanted.coalesce(max(1, -(-wanted.count() // (QUERIES * 4)))).mapInArrow(_blocks(QUERIES, scale), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "queries")
    size = lambda df: df.agg(F.count(F.lit(1)), F.avg(F.length("vectors")), F.max(F.col("most") * F.col("most") * F.col("dim"))).first()
    (n_queries, query_bytes, _), (n_blocks, block_bytes, bound) = size(asked), size(blocks)
    pairs = max(1, n_queries * n_blocks)
    tasks = min(pairs, max(spark.sparkContext.defaultParallelism * 4, int(math.sqrt(pairs))))
    of_queries, of_blocks = grid(max(1, n_queries), max(1, n_blocks), tasks, query_bytes or 1.0, block_bytes or 1.0)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(state: DataFrame) -> DataFrame:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("low", "binary"), ("step", "binary"))]
        left = asked.join(state, "block").select(F.pmod(F.col("block"), F.lit(of_queries)).cast("int").alias("gq"), spread(of_blocks).alias("gc"), F.lit(0).alias("side"), "dim", "n", "ids", "width", "vectors", "most", "block", "low", "step")
        right = blocks.select(spread(of_queries).alias("gq"), F.pmod(F.xxhash64("ids"), F.lit(of_blocks)).cast("int").alias("gc"), F.lit(1).alias("side"), "dim", "n", "ids", "width", "vectors", "most", *none)
        return left.union(right).repartition(min(of_queries * of_blocks, tasks * 2), "gq", "gc").sortWithinPartitions("gq", "gc", "side")

    def start(row: dict) -> dict:
        ids, values, most = _unpack(row)
        low, step = (np.frombuffer(row[c], "<i8") for c in ("low", "step"))
        return {"block": row["block"], "dim": row["dim"], "ids": ids, "vectors": values, "most": most, "low": low, "step": step, "counts": None}

    def count(h: dict, ids: np.ndarray, scores: np.ndarray) -> None:
        # Unsigned differences hold the whole range of 64-bit scores; those below the range take no part.
        above = scores.view(np.uint64) - h["low"].view(np.uint64)[:, None]
        live = (scores >= h["low"][:, None]) & (ids[None, :] != h["ids"][:, None])
        bin_of = np.minimum(above // h["step"].view(np.uint64)[:, None], np.uint64(bins)).astype(np.int64)  # above the range: one bin for all
        n = len(h["ids"])
        counts = np.bincount((np.arange(n)[:, None] * (bins + 1) + bin_of)[live], minlength=n * (bins + 1)).reshape(n, bins + 1)
        h["counts"] = counts if h["counts"] is None else h["counts"] + counts

    def emit(h: dict):
        """Counts from the top bin down to where this cell alone has ``k``: the kth value of all is not below that."""
        if h["counts"] is None:
            return None
        counts = h["counts"][:, ::-1]
        q, down = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < k))
        return np.full(len(q), h["block"]), q, bins - down, counts[q, down]

    histogram = _over_cells(start, count, emit, ["block", "q", "bin", "n"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])
    top = int(bound or 0.0) + 1
    lowest = max(-top, -(2**63))
    step = -(-(min(top, 2**63 - 1) - lowest + 1) // bins)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = lambda v: pa.array([np.full(n, v, "<i8").tobytes() for n in batch.column("n").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), full(lowest), full(step)], ["block", "low", "step"])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, steps = [], []
            for row in batch.to_pylist():
                low, width = np.frombuffer(row["low"], "<i8").copy(), np.frombuffer(row["step"], "<i8")
                for x in row["bins"]:
                    # A kth value above the range cannot be: the range was chosen to hold it.
                    low[x["q"]] += x["bin"] * width[x["q"]]
                lows.append(low.tobytes())
                steps.append(np.maximum(1, -(-width // bins)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(lows, pa.binary()), pa.array(steps, pa.binary())], ["block", "low", "step"])

    shape = "block long, low binary, step binary"
    state = durable(asked.select("block", "n").mapInArrow(begin, shape), "state")
    while True:
        counts = cells(state).mapInArrow(histogram, "block long, q int, bin int, n long").groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "q").orderBy(F.desc("bin"))
        summed = counts.withColumn("upto", F.sum("n").over(down))
        # The bin in which the count from the top reaches k; the lowest bin found if there are fewer.
        at = summed.groupBy("block", "q").agg(F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("at"), F.min("bin").alias("least"))
        chosen = at.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("at", "least").alias("bin")))).alias("bins"))  # of a block: as many as it has queries
        state = durable(state.join(chosen, "block").mapInArrow(narrow, shape), "state")
        if step == 1:
            break
        step = max(1, -(-step // bins))

    def keep(h: dict, ids: np.ndarray, scores: np.ndarray):
        """Scores at or above the kth value; of one pair of blocks, no more than its own best k can be needed."""
        q, c = np.nonzero((scores >= h["low"][:, None]) & (ids[None, :] != h["ids"][:, None]))
        best = np.lexsort((ids[c], -scores[q, c].astype(object) if scores.size and scores.min() == -(2**63) else -scores[q, c], q))
        q, c = q[best], c[best]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c = q[kept], c[kept]
        return np.full(len(q), h["block"]), q, h["ids"][q], ids[c], scores[q, c]

    found = cells(state).mapInArrow(_over_cells(start, keep, lambda h: None, ["block", "q", "query_id", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]), "block long, q int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
