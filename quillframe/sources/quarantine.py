"""Good and bad rows apart, in one pass, with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.errors import FAILURES


def write_apart(rows: DataFrame, path: str, kind: str = "error_kind") -> dict[str, int]:
    """Writes rows without a failure and those with one to parts of ``path``, and returns their numbers.

    ``rows`` are computed once, whatever they cost: both parts are partitions of one write, and the numbers (``good``, ``bad``
    and one for each kind of failure that occurs; kinds that are not known count as ``other``) are observed on its way.
    """
    known = list(FAILURES)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    seen = Observation("apart")
    counts = {"good": F.col(kind).isNull(), "bad": F.col(kind).isNotNull(), **{k: F.col(kind) == k for k in known}, "other": F.col(kind).isNotNull() & ~F.col(kind).isin(known)}
    rows.observe(seen, *(count(test).alias(name) for name, test in counts.items())).withColumn("quarantined", F.col(kind).isNotNull().cast("string")).write.mode("overwrite").partitionBy("quarantined").parquet(path)
    return {name: n for name, n in seen.get.items() if n or name in ("good", "bad")}


def good_rows(spark: SparkSession, path: str, kind: str = "error_kind") -> DataFrame:
    return spark.read.parquet(path).where("quarantined = 'false'").drop("quarantined", kind)


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("quarantined = 'true'").drop("quarantined")
