"""Images: uploads, decoded pixels, and the store of originals and crops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from quillframe.sources.store import written

#: Largest upload in bytes.
LIMIT = 25 * 1024 * 1024
BINARY_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def scan_id(path: F.Column) -> F.Column:
    """An id in the form of a UUID that depends on the path alone, so that a replay gives the same one."""
    digest = F.sha2(F.regexp_replace(path, "^file:/+", "file:/").cast("binary"), 256)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))


def read_uploads(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,gif}") -> DataFrame:
    """(id, path, length, content, error_kind): one row per file. Files that are too large keep a row, without content.

    Spark's reader passes over files of no bytes; empty uploads of a table are told by ``first_upload``. The limit is a filter on ``length`` next to the scan: contents over it are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    good = files.where((F.col("length") > 0) & (F.col("length") <= LIMIT)).select(scan_id(F.col("path")).alias("id"), "path", "length", "content", F.lit(None).cast("string").alias("error_kind"))
    bad = files.where((F.col("length") <= 0) | (F.col("length") > LIMIT)).select(
        scan_id(F.col("path")).alias("id"), "path", "length", F.lit(None).cast("binary").alias("content"), F.when(F.col("length") == 0, "empty_image").otherwise("multipart").alias("error_kind")
    )
    return good.unionByName(bad)


def first_upload(parts: DataFrame, *by: str) -> DataFrame:
    """(request_id, content, error_kind) of multipart requests (request_id, part_no, name, content), for each value of the columns ``by``.

    The first part, the one with the least number, counts whatever its name; the last later one named ``image`` replaces it. No
    part (a row without a number) and an empty one are different failures.
    """
    part = F.when(F.col("part_no").isNotNull(), F.struct("part_no", "content"))
    best = parts.groupBy("request_id", *by).agg(F.coalesce(F.max(F.when(F.col("name") == "image", part)), F.min(part)).alias("best"))
    content = F.col("best.content")
    kind = F.when(content.isNull(), "missing_image").when(F.length(content) == 0, "empty_image")
    return best.select("request_id", *by, content.alias("content"), kind.alias("error_kind"))


@F.pandas_udf(BinaryType())
def _three(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Pixels of one channel or four as blue, green, red: gray is repeated, alpha dropped."""

    def one(pixels: bytes | None, n: int) -> bytes | None:
        if pixels is None:
            return None
        flat = np.frombuffer(pixels, np.uint8)
        return (np.repeat(flat, 3) if n == 1 else flat.reshape(-1, n)[:, :3]).tobytes()

    return pd.Series([one(x, n) for x, n in zip(data, channels)], dtype=object)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, height, width, data, error_kind): decoded pixels, three bytes a pixel in the order blue, green, red.

    Gray images and those with alpha are converted. Files that do not decode are 'decode', and so are gray PNG files of 16
    bits, of which Spark's reader keeps the low byte alone; these are told by the header of their file, in a pass of its own.
    """
    images = spark.read.format("image").load(path).select("image.*")
    # Signature, IHDR, bit depth 16, colour type gray (0) or gray with alpha (4). Their ids are written, so that Spark knows their
    # size when it plans the join: a few are broadcast, and only where they are too many are pixels shuffled.
    head = F.hex(F.substring("content", 1, 26))
    deep = spark.read.format("binaryFile").load(path).where(head.rlike("^89504E470D0A1A0A.{32}10(?:00|04)$")).select(scan_id(F.col("path")).alias("id"), F.lit(True).alias("deep"))
    deep = spark.read.schema(deep.schema).parquet(written(deep, "deep"))
    found = images.withColumn("id", scan_id(F.col("origin"))).join(deep, "id", "left")
    kind = F.when((F.col("height") < 0) | F.col("deep"), "decode").when(~F.col("nChannels").isin(1, 3, 4), "decode")
    odd = _three(F.when(kind.isNull() & (F.col("nChannels") != 3), F.col("data")), F.col("nChannels"))
    return found.select("id", "height", "width", F.when(kind.isNull(), F.when(F.col("nChannels") == 3, F.col("data")).otherwise(odd)).alias("data"), kind.alias("error_kind"))


def write_originals(uploads: DataFrame, path: str) -> None:
    """Bytes as they came, whatever their format."""
    uploads.where("error_kind IS NULL").select("id", "content").write.mode("append").parquet(path)


def latest_crops(crops: DataFrame, data_col: str = "pixels") -> DataFrame:
    """The last crop of each scan: (id, crop_no, ...) with the greatest ``crop_no``; a later one replaces an earlier one.

    The maximum is of numbers and digests, so pixels are shuffled once, with the rows that stay. Of crops of one number the one
    with the greatest digest of its ``data_col`` (raw pixels, or the content of a file) stays.
    """
    marked = crops.withColumn("__digest", F.sha2(F.col(data_col), 256))
    last = marked.groupBy("id").agg(F.max(F.struct("crop_no", F.col("__digest").alias("d"))).alias("last")).select(F.col("id").alias("__id"), "last")
    same = (F.col("id") == F.col("__id")) & (F.col("crop_no") == F.col("last.crop_no")) & F.col("__digest").eqNullSafe(F.col("last.d"))
    return marked.join(last, same, "left_semi").drop("__digest").dropDuplicates(["id"])


def write_crops(crops: DataFrame, path: str) -> None:
    """Adds crops (id, crop_no, pixels or content, ...) to the store; ``read_crops`` sees the last of each scan, so a later one overwrites an earlier one."""
    crops.write.mode("append").parquet(path)


def read_crops(spark: SparkSession, path: str) -> DataFrame:
    crops = spark.read.parquet(path)
    return latest_crops(crops, "pixels" if "pixels" in crops.columns else "content")


def look_up(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests (id, ...) with the stored row of their id; ``error_kind`` is not_found where there is none."""
    found = store.withColumn("__stored", F.lit(True))
    return requests.join(found, "id", "left").withColumn("error_kind", F.when(F.col("__stored").isNull(), "not_found")).drop("__stored")
