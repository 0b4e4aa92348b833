"""Crops by id in hashed buckets: a later crop of an id replaces the earlier ones.

Writing appends to the buckets of the ids, reading an id opens its bucket alone, and compaction leaves the last crop of each id
in the buckets that have more. The number of buckets is part of the store's column, so that every reader knows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.images import latest_crops
from quillframe.sources.store import kept

COLUMN = "bucket_of_"


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_.cast("string")), F.lit(buckets)).cast("int")


def _column(frame: DataFrame) -> tuple[str, int]:
    name = next(c for c in frame.columns if c.startswith(COLUMN))
    return name, int(name.removeprefix(COLUMN))


def _data(frame: DataFrame) -> str:
    return "pixels" if "pixels" in frame.columns else "content"


def add_crops(crops: DataFrame, path: str, buckets: int = 256) -> None:
    """Adds crops (id, crop_no, pixels or content, ...). ``buckets`` counts for a new store; it must be the same for later writes."""
    name = f"{COLUMN}{buckets}"
    dealt = crops.withColumn(name, _bucket(F.col("id"), buckets))
    # A bucket gets few files of each write, and a bucket of many crops is split.
    dealt.hint("rebalance", name).write.mode("append").partitionBy(name).parquet(path)


def crops(spark: SparkSession, path: str) -> DataFrame:
    """The last crop of each id."""
    found = spark.read.parquet(path)
    return latest_crops(found.drop(_column(found)[0]), _data(found))


def crops_of(spark: SparkSession, path: str, ids: Sequence) -> DataFrame:
    """The last crops of some ids; only their buckets are read."""
    found = spark.read.parquet(path)
    name, buckets = _column(found)
    of = [F.lit(i) for i in ids]
    mine = found.where(F.col(name).isin(*(_bucket(i, buckets) for i in of)) & F.col("id").isin(*of)) if of else found.limit(0)
    return latest_crops(mine.drop(name), _data(found))


def compact(spark: SparkSession, path: str) -> int:
    """Leaves the last crop of each id, and tells how many buckets were rewritten: those that hold an id more than once.

    The crops that stay are written aside first, and then replace their buckets (dynamic partition overwrite); other buckets are not touched.
    Crops that are added while it runs may be lost: it wants the store for itself.
    """
    found = spark.read.parquet(path)
    name, _ = _column(found)
    crowded = [r[0] for r in found.groupBy(name, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name).distinct().collect()]  # at most as many as there are buckets
    if not crowded:
        return 0
    stay = kept(latest_crops(found.where(F.col(name).isin(crowded)), _data(found)), "compacted")
    stay.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return len(crowded)
