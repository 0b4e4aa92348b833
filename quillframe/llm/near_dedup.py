"""Near-duplicate documents by MinHash.

Many universal hash minima of each document's shingle set, in bands, give candidates; full sets confirm links; components
come from alternating large-star and small-star. Equal sets collapse to one representative first. The candidates of a
bucket are not spread into pairs: each member is first compared with one centre of its bucket, and what is confirmed is
contracted, so that a large group of near copies takes work in proportion to its documents. Only what is still in
different components then meets in cells of bounded size that emit a forest of links: signatures first, then full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import drop_ids, distinct, durable, gram_hashes, marked_texts, mix64, small_batches, split_by, texts_of, utf8, word_hashes, word_lists
from quillframe.llm.components import connected_components

#: Chance that a pair at the threshold shares no band; most minima of a document; minima that verify a pair; how far
#: below the threshold their agreement may be (over six standard deviations).
MISS, MINIMA, VERIFYING, SLACK = 2e-6, 480, 256, 0.15
#: Rounds of stars; documents of a star that share a task's copy of its centre; documents, and shingles, of one side of a cell.
STARS, LEAVES, CELL_DOCS, CELL_SHINGLES = 2, 64, 512, 1_000_000
#: Sets of up to so many shingles are told apart by their words, larger ones by the hashes of their shingles.
SPELLED = 8
#: Documents of a cluster whose open members meet each other as one group; members of larger clusters meet bucket by bucket.
GROUP = 20_000


def choose_bands(threshold: float, minima: int = MINIMA, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows with which ``minima`` hash functions still miss few enough pairs at the threshold."""
    for rows in range(32, 0, -1):
        need = max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if need * rows <= minima:
            return need, rows
    return minima, 1


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of a text, by the digests of its words; fewer words are one shingle."""
    return gram_hashes(hashes, min(size, len(hashes))) if len(hashes) else hashes


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words, A-Z in lower case; fewer words are one shingle."""
    return distinct(_shingles(word_hashes(utf8(text).lower()), size))


class Shingles:
    """The shingle set of a text: sorted distinct hashes and, where those suggest a link, the words, which settle it."""

    def __init__(self, text: str | None, size: int):
        self.data, self.size = utf8(text).lower(), size
        self.hashes = distinct(_shingles(word_hashes(self.data), size))

    @cached_property
    def first(self) -> np.ndarray:
        """Where each shingle stands first."""
        return np.unique(_shingles(word_hashes(self.data), self.size), return_index=True)[1]

    @cached_property
    def words(self) -> list[bytes]:
        return [w for part in word_lists(self.data) for w in part]

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(dict.fromkeys(self.words))}

    def numbered(self, numbers: dict[bytes, int]) -> np.ndarray:
        """The words as ``numbers`` has them, with so many that it lacks as to fill up a shingle at the end."""
        found = [numbers.get(w, -1) for w in self.words]
        return np.array(found + [-2] * (self.size - 1))

    def linked(self, other: Shingles, num: int, den: int) -> bool:
        """den * |a and b| >= num * |a or b|; what the two have in common is compared word by word."""
        small, large = (self.hashes, other.hashes) if len(self.hashes) <= len(other.hashes) else (other.hashes, self.hashes)
        a, b = len(small), len(large)
        if den * a < num * b:
            return False
        at = np.searchsorted(large, small)
        at[at == b] = 0
        shared = int(np.count_nonzero(large[at] == small))
        if den * shared < num * (a + b - shared):
            return False
        _, i, j = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        x, y, p, q = self.numbered(self.numbers), other.numbered(self.numbers), self.first[i], other.first[j]
        same = np.ones(len(p), bool)
        for k in range(self.size):
            same &= x[p + k] == y[q + k]
        shared = int(same.sum())
        return den * shared >= num * (a + b - shared)


@cache
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return (rng.integers(0, 2**32, k, np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 2**32, k, np.uint64).astype(np.uint32)


def minima(hashes: np.ndarray, k: int) -> np.ndarray:
    """Minima of ``hashes`` under ``k`` universal hash functions a * x + b modulo 2**32."""
    a, b = _family(k)
    x, out, held = (hashes >> np.uint64(32)).astype(np.uint32), np.full(k, 2**32 - 1, np.uint32), np.empty((64, k), np.uint32)
    for at in range(0, len(x), 64):
        part = x[at : at + 64, None]
        values = held[: len(part)]
        np.multiply(part, a, out=values)
        values += b
        np.minimum(out, values.min(axis=0), out=out)
    return out


@cache
def _weights(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.random.default_rng(12).integers(0, 2**63, rows, np.uint64) | np.uint64(1), np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights, offsets = _weights(bands, rows)
    sums = (signature[: bands * rows].reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return mix64(sums + offsets).astype(np.int64)


def _digest(data: bytes, hashes: np.ndarray, size: int) -> bytes:
    """What tells shingle sets apart, 128 bits: by the words of a few shingles, else by the hashes of all."""
    if len(hashes) > SPELLED:
        return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    words = [w for part in word_lists(data) for w in part]
    spelled = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
    return hashlib.blake2b(b"\n".join(sorted(spelled)), digest_size=16, person=b"few").digest()


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for text in batch.column("text").to_pylist():
                data = utf8(text).lower()
                found = distinct(_shingles(word_hashes(data), size))
                counts.append(len(found))
                digests.append(_digest(data, found, size) if len(found) else None)
                keys.append(band_keys(minima(found, bands * rows), bands, rows).astype("<i8").tobytes() if len(found) else None)
            out = batch.select(["id", "m1", "m2"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary())], [*out.schema.names, "n", "digest", "bands"])

    return run


def _spread_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = [np.frombuffer(x, "<i8") for x in part.column("bands").to_pylist()]
            reps = np.repeat(part.column("rep").to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(reps, pa.int64())], ["key", "rep"])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _confirm_stars(size: int, num: int, den: int):
    """Links of leaves with their centre. A centre comes before its leaves; one set of each is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            found = []
            for head, chunk, rep, text in zip(*(batch.column(c).to_pylist() for c in ("centre", "chunk", "rep", "text"))):
                if (head, chunk) != star:
                    star, centre = (head, chunk), Shingles(text, size)
                elif centre.linked(Shingles(text, size), num, den):
                    found.append((head, rep))
            yield _edges(found)

    return run


def _confirm_cells(size: int, num: int, den: int):
    """Links across the two sides of each cell, one forest for each. The first side is held, the other passes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, root, signatures = None, [], {}, None

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = i = root.setdefault(root[i], root[i])
            return i

        for batch in batches:
            found = []
            cells = zip(*(batch.column(c).to_pylist() for c in ("whole", "key", "i", "j")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("side", "rep", "component", "rest", "text")))
            for now, (side, rep, component, rest, text) in zip(cells, rows):
                if now != cell:
                    cell, held, root, signatures = now, [], {}, None
                own = Shingles(text, size)
                if side == 0:
                    held.append((rep, component, own))
                    continue
                if signatures is None:
                    signatures = np.stack([minima(x.hashes, VERIFYING).astype(np.uint8) for _, _, x in held])
                close = np.count_nonzero(signatures == minima(own.hashes, VERIFYING).astype(np.uint8), axis=1) >= VERIFYING * (num / den - SLACK)
                for k in np.flatnonzero(close).tolist():
                    other, of, theirs = held[k]
                    if rest and other >= rep:  # both are of the first side: compared once
                        continue
                    if (a := find(component)) != (b := find(of)) and own.linked(theirs, num, den):
                        root[a] = b
                        found.append((rep, other))
            yield _edges(found)

    return run


def _labelled(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """(key, members, rep, component) of the buckets (key, members, rep) whose members are in different components."""
    if components is None:
        return buckets.withColumn("component", F.col("rep"))
    known = buckets.join(components, F.col("rep") == F.col("node"), "left").select("key", "members", "rep", F.coalesce("component", "rep").alias("component"))
    known = durable(known, "labelled")
    still = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return durable(known.join(durable(still, "open"), "key"), "open-buckets")


def _stars(labelled: DataFrame, texts: DataFrame, turn: int, confirm) -> DataFrame:
    """Confirmed links of bucket members with the centre of their bucket: the member whose hash in this round is least.

    A member of several buckets is compared with one centre in a round, so that a round takes work in proportion to the
    documents; in the second round also with its partner in each bucket of two, which settles those.
    """
    centre = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "component")).alias("c"))
    centre = durable(centre.select("key", "c.h", F.col("c.rep").alias("centre"), F.col("c.component").alias("of")), "centres")
    met = labelled.join(centre, "key").where("component <> of")
    pairs = met.where("members > 2").groupBy("rep").agg(F.min(F.struct("h", "centre")).alias("c")).select("c.centre", "rep")
    if turn == 1:
        pairs = pairs.union(met.where("members = 2").select("centre", "rep")).distinct()
    pairs = durable(pairs, "pairs")
    sizes = durable(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("chunks")), "stars")
    leaves = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "rep")
    heads = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("centre").alias("rep"))
    rows = leaves.unionByName(heads).join(texts.select("rep", "text"), "rep")
    return rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "side").select("centre", "chunk", "rep", "text").mapInArrow(confirm, "a long, b long")


def _cells(labelled: DataFrame, texts: DataFrame, confirm) -> DataFrame:
    """Confirmed links between all members of a group that are in different components.

    A group is all members of open buckets that overlap, so that a pair meets once; where that would be a long chain, the
    members of each bucket, and buckets with the same members count once. Of each group, the largest component meets the
    rest, and the rest meets itself.
    """
    centres = labelled.groupBy("key").agg(F.min("rep").alias("b"))
    clusters = durable(connected_components(labelled.join(centres, "key").where("rep <> b").select(F.col("rep").alias("a"), "b")), "clusters")
    large = durable(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select(F.col("component").alias("cluster")), "large")
    of = labelled.join(clusters.withColumnRenamed("component", "cluster"), F.col("rep") == F.col("node")).select("key", "rep", "component", "cluster")
    groups = of.join(large, "cluster", "left_anti").select(F.lit(True).alias("whole"), F.col("cluster").alias("key"), "rep", "component").distinct()
    if not large.isEmpty():
        chained = durable(of.join(large, "cluster", "left_semi"), "chained")
        seen = chained.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), F.col("rep"))).alias("y"))
        once = durable(seen.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "once")
        groups = groups.union(chained.join(once, "key").select(F.lit(False).alias("whole"), "key", "rep", "component"))
    groups = durable(groups, "groups")
    name = ["whole", "key"]
    parts = durable(groups.join(texts.select("rep", "n"), "rep").groupBy(*name, "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")), "parts")
    largest = parts.groupBy(*name).agg(F.max(F.struct("docs", "component")).alias("m"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"))
    rest = parts.join(largest.select(*name, F.col("m.component").alias("core")), name).where("component <> core").groupBy(*name).agg(F.sum("docs").alias("rdocs"), F.sum("shingles").alias("rshingles"))
    chunks = lambda docs, shingles: F.greatest(F.ceil(F.col(docs) / CELL_DOCS), F.ceil(F.col(shingles) / CELL_SHINGLES)).cast("int")
    grid = durable(largest.join(rest, name).select(*name, F.col("m.component").alias("core"), chunks("rdocs", "rshingles").alias("ni"), chunks("docs", "shingles").alias("nj")), "grid")
    members = groups.join(grid, name).withColumn("rest", F.col("component") != F.col("core"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = members.where("rest").select(*name, place("ni").alias("i"), spread("nj").alias("j"), F.lit(0).alias("side"), "rep", "component", "rest")
    second = members.select(*name, spread("ni").alias("i"), place("nj").alias("j"), F.lit(1).alias("side"), "rep", "component", "rest")
    rows = first.unionByName(second).join(texts.select("rep", "text"), "rep")
    cell = [*name, "i", "j"]
    return rows.repartition(*cell).sortWithinPartitions(*cell, "side").select(*cell, "side", "rep", "component", "rest", "text").mapInArrow(confirm, "a long, b long")


def _classify(docs: DataFrame, num: int, den: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, m1, m2, n, component_id, kept): a row per input row; m1 and m2 are hashes of its text."""
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(num / den)
    read = marked_texts(docs, id_col, text_col)
    found = read.mapInArrow(_features(size, bands, rows), "id long, m1 long, m2 long, n long, digest binary, bands binary")
    features = durable(found.withColumn("row", F.monotonically_increasing_id()), "features")
    # A class is named after its first row, so that rows without an id are classes like others. Equal sets have equal bands.
    classes = features.where("n > 0").groupBy("digest").agg(F.min(F.struct("row", "m1", "m2")).alias("first"), F.min("id").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    classes = durable(classes.select("digest", F.col("first.row").alias("rep"), "first.m1", "first.m2", "least", "n", "bands"), "classes")

    keys = classes.select("rep", "bands").mapInArrow(_spread_bands, "key long, rep long")
    # Written before they are joined: a join between two plain shuffles is one whose hot keys Spark can split.
    shared = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    buckets = durable(keys.join(shared, "key"), "buckets")
    candidates = durable(buckets.select("rep").distinct().join(classes.select("rep", "m1", "m2", "n"), "rep"), "candidates")
    texts = durable(texts_of(read, candidates).select("rep", "n", "text"), "texts")

    components, still = None, buckets
    for turn in range(STARS + 1):
        still = _labelled(still, components)
        if still.isEmpty():
            break
        links = _stars(still, texts, turn, _confirm_stars(size, num, den)) if turn < STARS else _cells(still, texts, _confirm_cells(size, num, den))
        links = durable(links, "links")
        if turn == 1:
            still = still.where("members > 2")
        if not links.isEmpty():
            known = links if components is None else components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
            components = durable(connected_components(known), "components")
        still = still.select("key", "members", "rep")

    # An id with several texts joins their classes.
    again = durable(features.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id"), "repeated-ids")
    if not again.isEmpty():
        of_id = durable(features.where("n > 0").join(again, "id").join(classes.select("digest", "rep"), "digest").select("id", "rep").distinct(), "classes-of-ids")
        several = of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("b")), "id").where("rep <> b").select(F.col("rep").alias("a"), "b")
        links = several if components is None else components.select("node", "component").union(several)
        components = durable(connected_components(links.toDF("a", "b")), "components")
    if components is None:
        components = docs.sparkSession.createDataFrame([], "node long, component long")
    rooted = classes.select("digest", "rep", "least").join(components, F.col("rep") == F.col("node"), "left").select("digest", "least", F.coalesce("component", "rep").alias("root"))
    rooted = durable(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_digest = durable(rooted.select("digest", "root").join(named, "root"), "components-of-classes")
    out = features.select("row", "id", "m1", "m2", "n", "digest").join(of_digest, "digest", "left")
    alone = F.col("component_id").isNull() & ((F.col("n") == 0) | (F.col("row") == F.col("root")))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("row", "id", "m1", "m2", "n", component.alias("component_id"), F.when(F.col("id").isNull(), alone).otherwise(F.col("id").eqNullSafe(component)).alias("kept"))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles long, component_id (smallest id reachable), kept (doc_id = component_id).

    Documents are linked when den * intersection >= num * union of their sets of ``size``-word shingles. A null, empty
    or blank text has an empty set and no links. Rows with equal sets are one class. A row without an id takes its component's
    id; where no row of a component has one, component_id is null and the first of its rows in the scan is kept. Rows that
    repeat an id are joined by it, unless their text has no words. Other columns are not read. An empty table gives an empty result.
    """
    return _classify(docs, num, den, size, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_copies(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays, one document of each component, with their columns.

    Rows that repeat the id that stays all stay. Of a component without any id one row stays. Only documents that may go take
    part in the joins that decide.
    """
    found = durable(_classify(docs, num, den, size, id_col, text_col).select("id", "m1", "m2", "kept"), "classified")
    gone = durable(found.where("NOT kept AND id IS NOT NULL").select(F.col("id").alias("__id")).distinct(), "gone")
    stay = drop_ids(docs, id_col, gone)
    # Rows without an id are told apart by their texts; of equal ones, one stays or none.
    nameless = found.where("id IS NULL").groupBy(F.col("m1").alias("__m1"), F.col("m2").alias("__m2")).agg(F.count(F.when(F.col("kept"), 1)).alias("__keep"), F.count(F.lit(1)).alias("n")).where("__keep < n").drop("n")
    nameless = durable(nameless, "nameless")
    if nameless.isEmpty():
        return stay
    text = F.col(text_col).cast("string")
    null = stay.where(F.col(id_col).isNull()).withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})
    half = split_by(null, "__h1", nameless.select("__m1"))
    judged = half(True).join(nameless, (F.col("__h1") == F.col("__m1")) & (F.col("__h2") == F.col("__m2")), "left")
    one = judged.where("__keep = 1").dropDuplicates(["__h1", "__h2"]).unionByName(judged.where("__keep IS NULL"))
    return stay.where(F.col(id_col).isNotNull()).union(half(False).drop("__h1", "__h2")).union(one.select(*half(False).columns).drop("__h1", "__h2"))
