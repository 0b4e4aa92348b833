"""Best-fit packing of token sequences by large-item matching.

A document is its ids and one id 0; documents over the capacity are cut into pieces. All that the packing needs to
know is how many pieces there are of each length, at most ``capacity`` numbers however large the corpus. It is solved
on those counts, in ranges of equal sequences: pieces of over a third of the capacity pair at most twice in a
sequence, by greedy matching of each with the longest that still fits; shorter ones, longest first, go to the sequence
whose gap they fit best. The ranges are broadcast, and each piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.bpe import byte_alphabet, little_endian
from quillframe.llm.common import durable, small_batches

CAPACITY = 2048
#: Texts whose characters are all of these have the same pieces in both engines, whatever their Unicode tables.
_COMMON = regex.compile(r"[\x00-\u024f\u0370-\u0373\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u2122]*+")
# Fixed value: the pattern of byte-level pre-tokenisers.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE file. Common texts go through an engine that reads the file's merges as byte ranks,
    all others (rare scripts, long runs of one kind, failures) through the library that the file is for."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = {str(x): i for i, x in self.library.get_added_tokens_decoder().items()}
        special = {self.library.id_to_token(i): i for i in special.values()}
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in s): i for s, i in self.library.get_vocab(with_added_tokens=False).items() if s not in special}
        self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.long_run = regex.compile(r"\S{2000}|\s{2000}")

    def __call__(self, text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not self.long_run.search(text):
            return self.fast.encode(text, allowed_special=self.allowed)
        return self.library.encode(text, add_special_tokens=False).ids


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all as long as the capacity but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def solve(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs ``counts`` pieces of each length: (ranges, sequences).

    A range (length, first rank, first sequence, offset, pieces per sequence) says where the pieces of a length from a
    rank on go: ``pieces per sequence`` to each of the sequences from the first on, the first at the offset.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}
    total = 0

    def put(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        ranges.append((length, used.get(length, 0), first, offset, each))
        used[length] = used.get(length, 0) + n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    left = {k: v for k, v in counts.items() if v}
    large = [k for k in sorted(left, reverse=True) if 3 * k > capacity]
    for a in large:
        for b in (x for x in large if x <= a and a + x <= capacity):
            if not left[a]:
                break
            if n := left[a] // 2 if a == b else min(left[a], left[b]):
                left[a] -= n
                left[b] -= n
                put(a, n, total, 0)
                put(b, n, total, a)
                leave(capacity - a - b, total, n)
                total += n
        if n := left[a]:
            left[a] = 0
            put(a, n, total, 0)
            leave(capacity - a, total, n)
            total += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        for gap in sorted(g for g in gaps if g >= s):
            each = gap // s
            while n and gaps.get(gap):
                first, bins = gaps[gap].pop()
                full = min(bins, n // each)
                if full:
                    put(s, full * each, first, capacity - gap, each)
                    leave(gap - each * s, first, full)
                    n -= full * each
                if full < bins and n:  # fewer than fill one sequence
                    put(s, n, first + full, capacity - gap, n)
                    leave(gap - n * s, first + full, 1)
                    full, n = full + 1, 0
                leave(gap, first + full, bins - full)
            if not n:
                break
        if n:
            each = capacity // s
            full = n // each
            if full:
                put(s, full * each, total, 0, each)
                leave(capacity - each * s, total, full)
                total += full
            if rest := n - full * each:
                put(s, rest, total, 0, rest)
                leave(capacity - rest * s, total, 1)
                total += 1
    return ranges, total


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of all documents with their rank among those of their length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "")
                data = little_endian([*ids, end_id])
                for piece, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                    row = (doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), int(seen[length]))
                    seen[length] += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(columns[0]), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece int, start, length, ids_crc32, sequence_id, offset (all long).

    A null or empty text is a document of the end id alone. A null id stays null; repeated rows are documents of their
    own. Other columns are not read. An empty table gives no sequences. A piece as long as the capacity fills its own.
    """
    small_batches(docs.sparkSession)
    cuts = durable(pieces(docs, vocabulary, capacity, id_col, text_col), "pieces")
    per_task = cuts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    counts = {r[0]: r[1] for r in offsets.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    ranges, _ = solve(counts, capacity)
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 5)
    spread = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity: ranges of equal sequences, not pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = spread.value
        # Ranges in order of (length, first rank) become one sorted key; ranks stay below 2**48.
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = rows[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            inside = rank - found[:, 1]
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            sequence, offset = found[:, 2] + inside // found[:, 4], found[:, 3] + inside % found[:, 4] * length
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*out.schema.names, "sequence_id", "offset"])

    # Pieces, some 60 bytes each, and offsets are dealt by length and task, so the table of all offsets is never in one place.
    ranked = cuts.join(offsets.select("length", "task", "before").hint("merge"), ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
