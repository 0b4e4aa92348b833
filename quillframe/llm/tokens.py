"""Token counts, and encoding with decoding, of whole texts. Both are map-only: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.bpe import Codec, Counts, Vocabulary, Words
from quillframe.llm.common import small_batches, utf8


@cache
def _counter(path: str) -> tuple[Words, Counts]:
    vocabulary = Vocabulary(path)
    return Words(path, vocabulary), Counts(vocabulary)


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > ``limit``), a row per input row.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows are counted each. Special
    strings inside a text are one token each. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _counter(vocabulary)
        get = counts.__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(utf8(text)))
                tokens.append(sum((special is not None) + sum(map(get, found)) for special, found in words.segments(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string, a row per input row.

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. A null text
    counts as empty: no ids, an empty decoded text. A null id stays null; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            rows = [codec.round_trip(text or "") for text in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
