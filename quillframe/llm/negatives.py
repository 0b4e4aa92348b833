"""Hard negatives by a pivot table.

A further component turns the inner product into a Euclidean distance: candidates x become (x, sqrt(M^2 - |x|^2)) and
anchors q become (q, 0), so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Distances of all candidates to a few pivots are stored
once; by the triangle inequality d(q, p) - d(x, p) and d(q, p) + d(x, p) bracket d(q, x), and so the score. Candidates are
sorted by their nearest pivot and their distance to it and packed into blocks with the range of their distances to
every pivot. An anchor skips the blocks whose bracket cannot reach what it seeks, takes only a run of the others, and scores what
is left exactly. Brackets have slack for rounding, so results do not depend on the pivots.

One pass finds the positives of the anchors, a second one the negatives in the window of each positive. Anchors
and candidates meet on a grid of cells; labels are compared within a cell, so a hot label is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import durable
from quillframe.llm.topk import _narrow, _scores, grid

#: Rows of a block of candidates, and of anchors; pivots; rows of the sample that pivots are chosen from.
CANDIDATES, ANCHORS, PIVOTS, SAMPLE = 4096, 256, 16, 2048
#: Share of the largest distance that brackets allow for rounding: near 0, a distance is the root of a difference of squares.
SLACK = 1e-6
LOWEST, HIGHEST = -(2**63), 2**63 - 1

_BLOCK = "dim int, n int, ids binary, labels binary, width int, vectors binary, most double, home int, far binary, low binary, high binary"


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    """Candidates with the component that gives all of them the norm of the longest."""
    return np.c_[x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))]


def choose_pivots(sample: list[list[int]], square: float, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each length of vectors, up to ``count`` lifted vectors of the sample, each the farthest from those before it."""
    by_dim: dict[int, list[list[int]]] = {}
    for x in sample:
        by_dim.setdefault(len(x), []).append(x)
    out = {}
    for dim, rows in by_dim.items():
        points = _lift(np.array(rows, np.float64).reshape(len(rows), dim), square)
        at, away = [0], np.linalg.norm(points - points[0], axis=1)
        while len(at) < min(count, len(points)) and away.max() > 0:
            at.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(points - points[at[-1]], axis=1))
        out[dim] = points[at]
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _homes(pivots: dict[int, np.ndarray], square: float, lifted: bool):
    """Adds the nearest pivot of each vector, and the distance to it (0 and 0 where its length has no pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = batch.column("x"), batch.num_rows
            size = np.diff(x.offsets.to_numpy())
            home, far = np.zeros(n, np.int32), np.zeros(n)
            for dim in np.unique(size):
                if int(dim) in pivots:
                    at = np.flatnonzero(size == dim)
                    points = x.values.to_numpy()[x.offsets.to_numpy()[at][:, None] + np.arange(dim)].astype(np.float64)
                    away = distances(_lift(points, square) if lifted else np.c_[points, np.zeros(len(at))], pivots[int(dim)])
                    home[at], far[at] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size.astype(np.int32)), pa.array(home), pa.array(far)], [*batch.schema.names, "dim", "home", "far"])

    return run


def _blocks(rows: int, pivots: dict[int, np.ndarray], square: float, lifted: bool):
    """Packs sorted vectors of one length and nearest pivot into blocks, with their distances to it and the range to each pivot."""

    def block(dim: int, home: int, ids: list, labels: list, values: list) -> pa.RecordBatch:
        matrix = np.array(values, np.int64).reshape(len(ids), dim)
        width, data = _narrow(matrix)
        points = matrix.astype(np.float64)
        away = distances(_lift(points, square) if lifted else np.c_[points, np.zeros(len(ids))], pivots.get(dim, np.zeros((1, dim + 1))))
        order = np.argsort(away[:, home], kind="stable")
        row = {
            "dim": dim, "n": len(ids), "ids": np.array(ids, "<i8")[order].tobytes(), "labels": np.array(labels, "<i4")[order].tobytes(), "width": width,
            "vectors": np.frombuffer(data, f"<i{width}").reshape(len(ids), dim)[order].tobytes(), "most": float(np.abs(matrix).max(initial=0)), "home": home,
            "far": away[order].tobytes() if not lifted else away[order, home].tobytes(), "low": away.min(axis=0).tobytes(), "high": away.max(axis=0).tobytes(),
        }
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, labels, values = None, [], [], []
        for batch in batches:
            for dim, home, vec, label, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "home", "vec", "label")), batch.column("x").to_numpy(zero_copy_only=False)):
                if (dim, home) != key or len(ids) == rows:
                    if ids:
                        yield block(*key, ids, labels, values)
                    key, ids, labels, values = (dim, home), [], [], []
                ids.append(vec)
                labels.append(label)
                values.append(x)
        if ids:
            yield block(*key, ids, labels, values)

    return run


def _unpack(row: dict, lifted: bool) -> dict:
    n = row["n"]
    far = np.frombuffer(row["far"])
    return {
        "dim": row["dim"], "n": n, "ids": np.frombuffer(row["ids"], "<i8"), "labels": np.frombuffer(row["labels"], "<i4"), "vectors": np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(n, row["dim"]),
        "most": row["most"], "home": row["home"], "far": far if lifted else far.reshape(n, -1), "low": np.frombuffer(row["low"]), "high": np.frombuffer(row["high"]),
    }


class Wanted:
    """What the anchors of a block seek: for each of several windows of scores the best ``k`` found so far.

    ``least`` and ``most`` are the bounds of the windows, arrays of (anchors, windows); a window with least > most seeks nothing.
    """

    def __init__(self, anchors: dict, least: np.ndarray, most: np.ndarray, k: int, same: bool, square: float):
        self.a, self.k, self.same, self.square = anchors, k, same, square
        self.least, self.most = least, most
        n, windows = least.shape
        self.scores, self.ids = np.full((n, windows, k), LOWEST), np.full((n, windows, k), HIGHEST)
        self.found = np.zeros((n, windows), np.int64)
        self.norms = (anchors["vectors"].astype(np.float64) ** 2).sum(axis=1)

    def floor(self) -> np.ndarray:
        """The lowest score that can still be of use, for each anchor and window."""
        return np.maximum(self.least, np.where(self.found == self.k, self.scores[:, :, -1], LOWEST))

    def _reach(self, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor's score is ``score``."""
        return np.sqrt(np.maximum(self.norms + self.square - 2.0 * score, 0.0))

    def meet(self, block: dict) -> None:
        if block["dim"] != self.a["dim"]:
            return
        floor = self.floor()
        open_ = (self.least <= self.most) & (floor <= self.most)
        low = np.where(open_, floor, HIGHEST).min(axis=1)
        high = np.where(open_, self.most, LOWEST).max(axis=1)
        slack = SLACK * (1.0 + math.sqrt(self.square) + np.sqrt(self.norms))
        outer, inner = self._reach(low.astype(np.float64)) + slack, self._reach(high.astype(np.float64)) - slack
        away = self.a["far"]
        nearest = np.maximum(away - block["high"], block["low"] - away).max(axis=1)  # of d(q, x), by the best pivot
        farthest = (away + block["high"]).min(axis=1)
        alive = np.flatnonzero(open_.any(axis=1) & (nearest <= outer) & (farthest >= inner))
        if not len(alive):
            return
        # Within the block the distances to its pivot are sorted: what an anchor may need is one run of them.
        home = away[alive, block["home"]]
        start = int(np.minimum(np.searchsorted(block["far"], home - outer[alive]), block["n"]).min())
        start = max(start, int(np.searchsorted(block["far"], inner[alive] - home).min()))
        end = int(np.searchsorted(block["far"], home + outer[alive], "right").max())
        if start >= end:
            return
        run = slice(start, end)
        ids, labels = block["ids"][run], block["labels"][run]
        scores = _scores(self.a["vectors"][alive], block["vectors"][run], self.a["most"] * block["most"])
        fits = (self.a["labels"][alive][:, None] == labels) == self.same
        fits &= self.a["ids"][alive][:, None] != ids
        for w in range(floor.shape[1]):
            ok = fits & (scores >= floor[alive, w][:, None]) & (scores <= self.most[alive, w][:, None])
            self._take(alive, w, ok, scores, ids)

    def _take(self, alive: np.ndarray, w: int, ok: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.flatnonzero(ok.any(axis=1))
        if not len(rows):
            return
        k, ok, at = self.k, ok[rows], alive[rows]
        if ok.shape[1] > k:  # no more than k of this block, and their ties
            masked = np.where(ok, scores[rows], LOWEST)
            ok &= masked >= np.partition(masked, -k, axis=1)[:, -k][:, None]
        q, c = np.nonzero(ok)
        held = np.arange(k) < self.found[at, w][:, None]
        hq, hk = np.nonzero(held)
        q_all = np.r_[q, hq]
        s_all = np.r_[scores[rows[q], c], self.scores[at[hq], w, hk]]
        i_all = np.r_[ids[c], self.ids[at[hq], w, hk]]
        order = np.lexsort((i_all, -s_all.astype(object) if s_all.min() == LOWEST else -s_all, q_all))
        q_all, s_all, i_all = q_all[order], s_all[order], i_all[order]
        place = np.arange(len(q_all)) - np.searchsorted(q_all, q_all)
        kept = place < k
        q_all, place = q_all[kept], place[kept]
        self.scores[at[q_all], w, place], self.ids[at[q_all], w, place] = s_all[kept], i_all[kept]
        self.found[at, w] = np.bincount(q_all, minlength=len(at))

    def rows(self) -> tuple[np.ndarray, ...]:
        """(anchor, window, id, score) of all that is held."""
        q, w, k = np.nonzero(np.arange(self.k) < self.found[:, :, None])
        return q, w, self.ids[q, w, k], self.scores[q, w, k]


def window(score: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integers s with least * score <= 100 * s <= most * score, without leaving 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * least - (-rest * least) // 100, whole * most + rest * most // 100


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, scale: float = 256.0, least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    candidates: int = CANDIDATES, anchors: int = ANCHORS,
) -> DataFrame:
    """anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long.

    Components become floor(scale * x). Anchors are the rows whose id is divisible by ``every``; scores are inner products of integers,
    ties go to the smaller id. An anchor's positives are the ``positives`` best other rows of its label; each gets the best
    ``negatives`` rows of other labels whose score is from ``least`` to ``most`` percent of the positive's. Positives of negative
    score have none, and those of score 0 only such of score 0.

    Rows take no part whose id, label or vector is null, or whose vector holds null or non-finite components; a component
    beyond 62 bits is an error. Vectors of different lengths have no score; empty ones score 0. "Other" is by id: no row of the
    anchor's own id is its positive or negative. Rows that repeat an anchor (id, label and vector) are one anchor; other
    repeated rows have ranks of their own. An anchor without positives has no rows, as has an empty table. Other columns are not read.

    Pivots are chosen from at most ``SAMPLE`` rows, those of the least hash; every row is a candidate, and results are exact.
    """
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(F.lit(scale) * c))
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    small = F.when(F.forall(x, lambda c: F.abs(F.lit(scale) * c) < 2.0**62), scaled).otherwise(F.raise_error("a scaled component does not fit 64 bits").cast("array<bigint>"))
    read = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("int").alias("label"), F.when(finite, small).alias("x")).where("vec IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = durable(read, "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    count, square = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    square = float(square or 0.0)
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("vec", "label", "x"), "vec").limit(SAMPLE).select("x").collect()]
    pivots = choose_pivots(sample, square)

    def packed(frame: DataFrame, size: int, tasks: int, lifted: bool) -> DataFrame:
        homes = frame.mapInArrow(_homes(pivots, square, lifted), "vec long, label int, x array<bigint>, dim int, home int, far double")
        dealt = homes.repartitionByRange(max(1, tasks), "dim", "home", "far", "vec").sortWithinPartitions("dim", "home", "far", "vec")
        return dealt.mapInArrow(_blocks(size, pivots, square, lifted), _BLOCK)

    parallel = spark.sparkContext.defaultParallelism
    of_tasks = lambda n, size: max(1, min(parallel, -(-n // size)), n // (16 * size))
    blocks = durable(packed(rows, candidates, of_tasks(count, candidates), True), "candidates")
    wanted = rows.where(F.col("vec") % every == 0).distinct()
    asked = durable(packed(wanted, anchors, of_tasks(count // every, anchors), False).withColumn("block", F.monotonically_increasing_id()), "anchors")
    bytes_of = lambda df: df.agg(F.count(F.lit(1)), F.avg(F.length("vectors"))).first()
    (n_asked, asked_bytes), (n_blocks, block_bytes) = bytes_of(asked), bytes_of(blocks)
    pairs = max(1, n_asked * n_blocks)
    tasks = min(pairs, max(parallel * 2, int(math.sqrt(pairs))))
    of_anchors, of_blocks = grid(max(1, n_asked), max(1, n_blocks), tasks, asked_bytes or 1.0, block_bytes or 1.0)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = _BLOCK.replace(" int", "").replace(" binary", "").replace(" double", "").split(", ")

    def cells(state: DataFrame | None) -> DataFrame:
        """Anchor blocks before candidate blocks in each cell."""
        left = asked.withColumn("found", F.lit(None).cast("array<struct<q:int,w:int,id:long,score:long>>")) if state is None else asked.join(state, "block")
        left = left.select(F.pmod(F.col("block"), F.lit(of_anchors)).cast("int").alias("gq"), spread(of_blocks).alias("gc"), F.lit(0).alias("side"), *columns, "block", "found")
        right = blocks.select(spread(of_anchors).alias("gq"), F.pmod(F.xxhash64("ids"), F.lit(of_blocks)).cast("int").alias("gc"), F.lit(1).alias("side"), *columns, F.lit(None).cast("long").alias("block"), F.lit(None).cast("array<struct<q:int,w:int,id:long,score:long>>").alias("found"))
        return left.union(right).repartition(min(of_anchors * of_blocks, tasks * 2), "gq", "gc").sortWithinPartitions("gq", "gc", "side", "home")

    def search(begin):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held = None, []

            def results() -> Iterator[pa.RecordBatch]:
                for block, seeking, aims in held:
                    q, w, ids, scores = seeking.rows()
                    if len(q):
                        aim = aims[:, q, w]
                        arrays = [np.full(len(q), block), q.astype(np.int32), w.astype(np.int32), seeking.a["ids"][q], aim[0], aim[1], ids, scores]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["block", "q", "w", "anchor", "aim_id", "aim_score", "id", "score"])

            for batch in batches:
                for row in batch.to_pylist():
                    if (row["gq"], row["gc"]) != cell:
                        yield from results()
                        cell, held = (row["gq"], row["gc"]), []
                    block = _unpack(row, row["side"] == 1)
                    if row["side"] == 0:
                        held.append((row["block"], *begin(row, block)))
                        continue
                    for _, seeking, _ in held:
                        seeking.meet(block)
            yield from results()

        return run

    def begin_positives(row: dict, block: dict):
        n = block["n"]
        return Wanted(block, np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST), positives, True, square), np.zeros((2, n, 1), np.int64)

    def begin_negatives(row: dict, block: dict):
        n = block["n"]
        low, high, aims = np.full((n, positives), 1), np.full((n, positives), 0), np.zeros((2, n, positives), np.int64)
        found = row["found"]
        q, w = (np.array([f[c] for f in found]) for c in ("q", "w"))
        aims[0, q, w], aims[1, q, w] = [f["id"] for f in found], [f["score"] for f in found]
        low[q, w], high[q, w] = window(aims[1, q, w], least, most)
        return Wanted(block, low, high, negatives, False, square), aims

    shape = "block long, q int, w int, anchor long, aim_id long, aim_score long, id long, score long"

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("block", "q", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = best(cells(None).mapInArrow(search(begin_positives), shape), positives)
    state = durable(near.groupBy("block").agg(F.collect_list(F.struct("q", (F.col("rank") - 1).alias("w"), "id", "score")).alias("found")), "positives")  # of a block: its anchors times their positives
    far = best(cells(state).mapInArrow(search(begin_negatives), shape), negatives)
    return far.select(F.col("anchor").alias("anchor_id"), F.col("aim_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("aim_score").alias("positive_score"), F.col("score").alias("negative_score"))
