"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after their ASCII white space is deleted. A Misra-Gries summary per task
finds the digests that may be frequent; their winners, verified by exact counts, are broadcast and settle their rows
map-side. All other digests go through one ordinary shuffle of short rows. Texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPACE, drop_ids, durable, small_batches

#: Counters of a Misra-Gries summary; also the most digests that are ever broadcast (about 80 bytes each).
COUNTERS = 8192


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            new = pa.table({"digest": found.field("values"), "hits": found.field("counts")})
            held = new if held is None else pa.concat_tables([held, new]).group_by("digest").aggregate([("hits", "sum")]).rename_columns(["digest", "hits"])
            if held.num_rows > counters:  # the merge rule of the summary: take off the largest count that does not fit
                ranked = held.sort_by([("hits", "descending"), ("digest", "ascending")])
                hits = pc.subtract(ranked["hits"], ranked["hits"][counters])
                held = ranked.set_column(1, "hits", hits).filter(pc.greater(hits, 0))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def heavy_hitters(digests: DataFrame, column: str = "digest", counters: int = COUNTERS) -> DataFrame:
    """The values of ``column`` that may make up more than 1/``counters`` of the rows: (digest), at most ``counters`` rows.

    A summary undercounts a value by at most rows/(counters + 1) of its task, so the summed counts of a value over
    all tasks lack at most rows/(counters + 1). Every value with over twice rows/counters occurrences is therefore returned;
    and as the summed counts never exceed the rows, no more than ``counters`` values can reach rows/counters.
    """
    rows = digests.count()
    parts = digests.select(F.col(column).alias("digest")).where("digest is not null").mapInArrow(_summaries(counters), "digest binary, hits long")
    return parts.groupBy("digest").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= max(2, -(-rows // counters))).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size long, kept boolean, text_sha256 string.

    Of equal texts the row with the most code points stays, then the smallest id. A null text counts as empty; empty
    and blank texts are equal. A null id loses to every other id; repeated rows of one id count each, and one of them
    stays. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = durable(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(F.regexp_replace(text, f"[{SPACE}]+", "").cast("binary"), 256)).alias("digest"),
            F.char_length(text).cast("long").alias("points"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # ~x falls as x rises and never overflows, so the maximum of the struct is the longest text, then the smallest id.
    place = F.struct("points", F.expr("~id").alias("id"), F.expr("~row").alias("row"))
    heavy = durable(heavy_hitters(read, counters=counters), "heavy")  # at most `counters` rows
    winners = read.join(F.broadcast(heavy), "digest").groupBy("digest").agg(F.max(place).alias("best"), F.count(F.lit(1)).alias("group_size"))
    settled = read.join(F.broadcast(durable(winners, "winners")), "digest")
    light = read.join(F.broadcast(heavy), "digest", "left_anti")
    # Aggregated within tasks first, then joined: a group goes through a task as one row for each task that has it.
    groups = light.groupBy("digest").agg(F.max(place).alias("best"), F.count(F.lit(1)).alias("group_size"))
    shuffled = light.join(durable(groups, "light-groups"), "digest")
    return settled.unionByName(shuffled.select(settled.columns)).select(
        F.col("id").alias("doc_id"),
        F.expr("~best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.expr("~best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("row").alias("row_in_scan"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. An id that repeats keeps one row of each of its texts that stay.

    Only documents that may go take part in the join that decides.
    """
    small_batches(docs.sparkSession)
    groups = durable(exact_groups(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"), "groups")
    ids = groups.groupBy("__id").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    stay = drop_ids(docs, id_col, durable(ids.where("NOT any").select("__id"), "gone"))
    several = durable(ids.where("any AND n > 1").select("__id"), "repeated-ids")
    if several.isEmpty():
        return stay
    # The rare rest: rows of one id, told apart by their texts.
    same = lambda: F.col(id_col).eqNullSafe(F.col("__id"))
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+", "").cast("binary"), 256)
    kept = groups.where("kept").select("__id", "__sha")
    more = stay.join(several, same(), "left_semi").withColumn("__sha2", digest).join(kept, same() & (F.col("__sha2") == F.col("__sha")), "left_semi").dropDuplicates([id_col, "__sha2"])
    return stay.join(several, same(), "left_anti").unionByName(more.drop("__sha2"))
