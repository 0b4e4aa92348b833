"""Shared pieces of the training-data operators: tables, durable intermediate results, byte hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.store import clean_up, own_dir  # noqa: F401

#: The bytes that separate words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs only the tasks that it ran, and a costly step that
    feeds several others runs once. Values that depend on the task (row numbers, partition ids) are fixed by it.
    """
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (the one of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``data`` joined by one space, and their starts and ends in that."""
    joined = b" ".join(data.split())
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


class _Digests(dict):
    """Seeded 64-bit hashes by word; bounded, as a long tail of words never comes again."""

    WORDS = 300_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, 0x9E3779B97F4A7C15)
        if len(word) <= 64:
            if len(self) >= self.WORDS:
                self.clear()
            self[word] = value
        return value


_DIGESTS = _Digests()


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, some ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """A seeded 64-bit hash of every word of ``data``, in order."""
    get = _DIGESTS.__getitem__
    parts = [np.fromiter(map(get, words), np.uint64, len(words)) for words in word_lists(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


_PLACES = np.random.default_rng(20250318).integers(0, 2**63, 4096, np.uint64) << np.uint64(1) | np.uint64(1)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size`` consecutive elements of ``words`` (hashes): a random odd weight for each place, then mixed."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACES[0]
    for k in range(1, size):
        out += words[k : k + n] * _PLACES[k]
    return mix64(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def marked_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, m1, m2, text); m1 and m2 are independent hashes of the text, by which it is found again."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(1), text).alias("m2"), text.alias("text"))


#: Bits of a membership filter: at most half a million 16-byte rows are broadcast, whatever the keys.
FILTER_BITS = 1 << 25


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> Callable[[bool], DataFrame]:
    """Cuts ``rows`` by a hashed bitmap of ``keys`` (its first column, long): those that may have a partner, and those that surely have none.

    The bitmap (a Bloom filter with one bit a key, as a table of 64-bit words) has a bounded size and is all that is
    broadcast. With more keys than it has room for it merely lets more rows pass as possible partners. Nulls are keys like others.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long"), F.lit(1)), F.lit(FILTER_BITS))
    word, bit = (lambda p: F.shiftright(p, 6).cast("int")), (lambda p: p.bitwiseAND(F.lit(63)).cast("int"))
    found = place(F.col(keys.columns[0]))
    words = durable(keys.groupBy(word(found).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(found))).alias("__bits")), "bitmap")
    here = place(F.col(key))
    hit = (word(here) == F.col("__word")) & (F.call_function("shiftrightunsigned", F.col("__bits"), bit(here)).bitwiseAND(F.lit(1)) == 1)
    return lambda possible: rows.join(F.broadcast(words), hit, "left_semi" if possible else "left_anti")


def may_join(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``, ahead of a join on it: wide rows without a partner
    are then not shuffled. No row with a partner is lost."""
    return split_by(rows, key, keys)(True)


def texts_of(read: DataFrame, marks: DataFrame) -> DataFrame:
    """The columns of ``marks`` (m1, m2 and others, a row for each text) with the text. Copies of a text collapse within each
    task of the scan, before any text is shuffled."""
    return may_join(read, "m1", marks.select("m1")).select("m1", "m2", "text").dropDuplicates(["m1", "m2"]).join(marks, ["m1", "m2"])


def drop_ids(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not among ``gone`` (a column ``__id``, null-safe). Rows that surely stay are passed on where they are;
    only those that may go are shuffled to the join that decides."""
    half = split_by(rows, key, gone)
    return half(False).unionByName(half(True).join(gone, F.col(key).eqNullSafe(F.col("__id")), "left_anti"))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds what Spark hands to Python at once to ``size`` bytes, where the setting allows more (64 MB by default): several
    copies of a batch are held at a time, as texts and as what is made of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name).lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    now = int(was[:-1]) * units[was[-1]] if was and was[-1] in units else int(was or 0)
    if not 0 < now <= size:
        spark.conf.set(name, str(size))
