"""Removal of word sequences that occur again anywhere in the corpus.

A window is ``width`` consecutive words. Equal texts collapse to one with a count, whatever their rows. Windows are dealt to
shards by their minimiser, the least of the hashes of their shorter word sequences: equal windows meet in one shard
wherever they stand, and neighbours mostly stay together as one run. Equal runs collapse to one with a count, and runs whose
minimiser occurs once in the corpus are left out. Each shard is a compressed FM-index over the words of its runs; all of them
are streamed through it by backward search over its wavelet matrix, whose matching statistics give the windows with an
interval of two occurrences or more. Minimisers only say where to search; what repeats is decided in an index. The runs of a
minimiser that too many share are divided by longer minimisers, the last of which is a whole window, and dealt to indexes by
those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import durable, marked_texts, mix64, small_batches, split_by, texts_of, utf8, word_spans
from quillframe.llm.fm_index import FMIndex

#: Words of a minimiser; different runs of one minimiser that share a shard; words of an index, about 60 bytes each.
GRAM, CROWD, INDEX_WORDS = 8, 128, 200_000
#: Words of the minimisers that divide a crowded one, before the whole window.
GRAMS = (24,)


#: Seed of the digests of runs.
SEED = 0x2545F4914F6CDD1D


#: Bytes whose sums are taken at once; a random value of each byte; powers of an odd base modulo 2^64, and of its inverse.
STRETCH = 1 << 14
_BYTES = np.random.default_rng(20250611).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [x] * (STRETCH - 1), np.uint64)) for x in (_BASE, _INVERSE))


def stretch_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of ``data`` from ``starts`` to ``ends`` (both rise), by the bytes in them alone.

    A stretch is the difference of two sums over the bytes before its ends, each byte times a power of the base for its place,
    moved back to the first place; so a stretch costs the same however long it is.
    """
    held = np.frombuffer(data, np.uint8)
    if len(held) <= STRETCH:
        sums = np.zeros(len(held) + 1, np.uint64)
        np.cumsum(_BYTES[held] * _POWERS[: len(held)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _INVERSES[starts])
    first, last = np.empty(len(starts), np.uint64), np.empty(len(ends), np.uint64)
    back, whole, power, inverse = np.empty(len(starts), np.uint64), 0, 1, 1
    for at in range(0, len(held) + 1, STRETCH):
        part = held[at : at + STRETCH]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _POWERS[: len(part)], out=sums[1:])
        sums = sums * np.uint64(power) + np.uint64(whole)
        for places, out in ((starts, first), (ends, last)):
            i, j = np.searchsorted(places, (at, at + STRETCH))
            out[i:j] = sums[places[i:j] - at]
            if out is first:
                back[i:j] = _INVERSES[places[i:j] - at] * np.uint64(inverse)
        whole, power, inverse = int(sums[-1]), power * pow(_BASE, STRETCH, 2**64) % 2**64, inverse * pow(_INVERSE, STRETCH, 2**64) % 2**64
    return mix64((last - first) * back)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the first of the least values of each ``span`` neighbours stands: of stretches that double, two make up the last."""
    least, reach = np.arange(len(values)), 1
    while reach < span:
        step = min(reach, span - reach)
        near, far = least[:-step], least[step:]
        least, reach = np.where(values[far] < values[near], far, near), reach + step
    return least


def runs_of(joined: bytes, starts: np.ndarray, ends: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one minimiser: (minimiser, first word, windows, digest of the run's words)."""
    n = len(starts) - width + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    grams, span = stretch_hashes(joined, starts[: len(starts) - gram + 1], ends[gram - 1 :]), width - gram + 1
    least = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        least[at:end] = _least(grams[at : end + span - 1], span) + at
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(first, append=n)
    held = memoryview(joined)
    whole = [xxhash.xxh3_64_intdigest(held[i:j], SEED) for i, j in zip(starts[first].tolist(), ends[first + count + width - 2].tolist())]
    return grams[least[first]].view(np.int64), first, count, np.array(whole, np.uint64).view(np.int64)


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shas, blobs = [], [], []
            for text in batch.column("text").to_pylist():
                joined, starts, ends = word_spans(utf8(text))
                words.append(len(starts))
                shas.append(hashlib.sha256(joined).hexdigest())
                key, first, count, whole = runs_of(joined, starts, ends, width)
                blobs.append(np.stack([key, first << 8 | count, whole]).astype("<i8").tobytes() if len(key) else None)
            out = batch.select(["id", "m1", "m2"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(words, pa.int64()), pa.array(shas), pa.array(blobs, pa.binary())], ["id", "m1", "m2", "n_words", "sha", "runs"])

    return run


def _explode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [np.frombuffer(x, "<i8").reshape(3, -1) for x in part.column("runs").to_pylist()]
            many = [x.shape[1] for x in found]
            rows, times = (np.repeat(part.column(c).to_numpy(), many) for c in ("row", "times"))
            key, place, whole = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, whole, rows, place, times)], ["key", "run", "row", "place", "times"])


#: A run that is to be searched: its minimiser, the digest of its words, how often it occurs, its windows, and its words.
_RUN = "key long, run long, n long, windows int, words binary"


def _lists(column: pa.Array, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The named fields of each list of structs, as arrays of integers."""
    flat, ends = column.flatten(), column.value_lengths().to_numpy().cumsum().tolist()
    fields = [flat.field(c).to_numpy() for c in names]
    for i, j in zip([0, *ends], ends):
        yield tuple(x[i:j] for x in fields)


def _words(width: int):
    """The words of the chosen runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, (key, name, n, place) in zip(batch.column("text").to_pylist(), _lists(batch.column("chosen"), "key", "run", "n", "place")):
                joined, starts, ends = word_spans(utf8(text))
                first, count = place >> 8, place & 255
                data = [joined[i:j] for i, j in zip(starts[first].tolist(), ends[first + count + width - 2].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(n), pa.array(count.astype(np.int32)), pa.array(data, pa.binary())], ["key", "run", "n", "windows", "words"])

    return run


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _search(width: int):
    """Repeated windows of the runs of a shard. Runs come in order of their minimiser; those of one are never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, np.ndarray]] = []
        numbers = _Numbers()
        held, last = 0, None

        def done() -> pa.RecordBatch:
            key, name, times, windows, texts = zip(*rows)
            masks = FMIndex(list(texts), np.array(times)).repeated_windows(np.arange(len(rows)), np.array(windows), width)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(name, pa.int64()), pa.array(masks.astype(np.int64))], ["key", "run", "mask"])

        for batch in batches:
            for key, name, n, windows, data in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "n", "windows", "words"))):
                if key != last and held >= INDEX_WORDS:
                    yield done()
                    rows, numbers, held = [], _Numbers(), 0
                found = data.split(b" ")
                words = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                rows.append((key, name, n, windows, words))
                held, last = held + len(words), key
        if rows:
            yield done()

    return run


def _divide(width: int, gram: int):
    """Runs of a crowded minimiser, cut anew by minimisers of ``gram`` words: (key, run, n, from, sub, subrun, windows, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, name, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "n", "words"))):
                joined, starts, ends = word_spans(data)
                sub, first, count, whole = runs_of(joined, starts, ends, width, gram)
                for s, i, m, digest in zip(sub.tolist(), first.tolist(), count.tolist(), whole.tolist()):
                    for column, x in zip(out, (key, name, n, i, s, digest, m, joined[starts[i] : ends[i + m + width - 2]])):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["key", "run", "n", "from", "sub", "subrun", "windows", "words"])

    return run


def _settle(words: DataFrame, width: int, crowd: int, grams: tuple[int, ...]) -> DataFrame:
    """(key, run, mask): the repeated windows of runs (key, run, n, windows, words); the mask has a bit for each window.

    Keys of up to ``crowd`` runs are searched in their shard. The runs of other keys are divided by a longer minimiser, and
    their parts settled in the same way; after the last, all that is left is searched.
    """
    search = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(_search(width), "key long, run long, mask long")
    if not grams:
        return search(words)
    crowds = durable(words.groupBy("key").agg(F.count(F.lit(1)).alias("runs")), "crowds")
    counted = words.join(crowds, "key")
    # A single run that occurs once has no window that another place has.
    found = search(counted.where(((F.col("runs") > 1) | (F.col("n") > 1)) & (F.col("runs") <= crowd)).drop("runs"))
    crowded = counted.where(F.col("runs") > crowd).drop("runs")
    parts = durable(crowded.mapInArrow(_divide(width, grams[0]), "key long, run long, n long, from int, sub long, subrun long, windows int, words binary"), "parts")
    if parts.isEmpty():
        return found
    below = parts.groupBy(F.col("sub").alias("key"), F.col("subrun").alias("run")).agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("words").alias("words"))
    masks = _settle(durable(below, "subruns"), width, crowd, grams[1:]).select(F.col("key").alias("sub"), F.col("run").alias("subrun"), "mask")
    windows = F.expr("mask & shiftrightunsigned(-1L, 64 - windows)")
    divided = parts.join(durable(masks, "submasks"), ["sub", "subrun"]).select("key", "run", windows.alias("mask"), "from")
    return found.unionByName(divided.groupBy("key", "run").agg(F.bit_or(F.expr("shiftleft(mask, `from`)")).alias("mask")))


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, (place, mask) in zip(batch.column("text").to_pylist(), _lists(batch.column("found"), "place", "mask")):
                words = utf8(text).split()
                bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                run, bit = np.nonzero(bits)
                at = (place[run] >> 8) + bit
                edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + width, minlength=len(words) + 1)
                stays = np.cumsum(edges[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                shas.append(hashlib.sha256(b" ".join(compress(words, stays.tolist()))).hexdigest())
            out = batch.select(["m1", "m2"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(removed, pa.int64()), pa.array(shas)], ["m1", "m2", "n_removed", "kept_sha256"])

    return run


def _one_of_each(rows: DataFrame) -> DataFrame:
    """(row, times, runs): the first row of each different text with windows, and how many rows have that text."""
    rows = rows.where("runs IS NOT NULL")
    copies = durable(rows.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("first")).where("times > 1"), "copies")
    half = split_by(rows, "m1", copies.select("m1"))
    some = half(True).join(copies, ["m1", "m2"], "left").where("first IS NULL OR row = first")
    return half(False).select("row", F.lit(1).cast("long").alias("times"), "runs").unionByName(some.select("row", F.coalesce("times", F.lit(1)).cast("long").alias("times"), "runs"))


def repeated_substrings(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows, repeats): what the scan saw of each input row, and where in each different text windows begin that occur again.

    rows: row, id, m1, m2 (hashes of the text), n_words, sha (of all words joined by one space). repeats: row (the first of
    the text), place (first word << 8 | windows), mask (a bit for each window). ``width`` is from 9 to 71 words.
    """
    small_batches(docs.sparkSession)
    grams = tuple(g for g in GRAMS if g < width)
    if not GRAM < width <= 63 + GRAM:
        raise ValueError("the width must be from 9 to 71 words")
    read = marked_texts(docs, id_col, text_col)
    scanned = read.mapInArrow(_scan(width), "id long, m1 long, m2 long, n_words long, sha string, runs binary")
    rows = durable(scanned.withColumn("row", F.monotonically_increasing_id()), "runs")
    runs = _one_of_each(rows).mapInArrow(_explode_runs, "key long, run long, row long, place long, times long")
    again = durable(runs.groupBy("key").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("key"), "again")
    found = durable(runs.join(again, "key", "left_semi"), "candidates")

    different = durable(found.groupBy("key", "run").agg(F.sum("times").alias("n"), F.min(F.struct("row", "place")).alias("at")), "classes")
    # One place of each run gives its words.
    chosen = different.select(F.col("at.row").alias("row"), F.struct("key", "run", "n", F.col("at.place").alias("place")).alias("x"))
    chosen = chosen.groupBy("row").agg(F.collect_list("x").alias("chosen"))  # of one document: as many as it has runs
    by_text = durable(chosen.join(rows.select("row", "m1", "m2"), "row").drop("row"), "chosen")
    words = durable(texts_of(read, by_text).select("text", "chosen").mapInArrow(_words(width), _RUN), "words")
    masks = durable(_settle(words, width, crowd, (*grams, width)).where("mask <> 0"), "masks")
    windows = F.expr("shiftrightunsigned(-1L, 64 - cast(place & 255 AS int))")
    repeats = found.join(masks, ["key", "run"]).select("row", "place", F.col("mask").bitwiseAND(windows).alias("mask"))
    return rows.drop("runs"), repeats


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed (long), kept_sha256 string (kept words joined by one space).

    Every word goes that a window covers whose words also begin anywhere else, in the same document too; windows are
    those of the input. Null, empty and blank texts have no words. A null id stays null; repeated rows are documents of
    their own, so their windows repeat. Other columns are not read. An empty table gives an empty result.
    """
    rows, repeats = repeated_substrings(docs, width, id_col, text_col, crowd)
    found = repeats.groupBy("row").agg(F.collect_list(F.struct("place", "mask")).alias("found"))  # of one document
    hit = durable(rows.select("row", "m1", "m2").join(durable(found, "found"), "row").drop("row"), "hit")
    changed = texts_of(marked_texts(docs, id_col, text_col), hit).select("m1", "m2", "found", "text").mapInArrow(_remove(width), "m1 long, m2 long, n_removed long, kept_sha256 string")
    out = rows.join(durable(changed, "changed"), ["m1", "m2"], "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
