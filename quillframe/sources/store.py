"""Folders of the application: intermediate results and the store of crops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, as in
    tests; an error on a cluster, whose machines would each write to a folder of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate results need a folder that all machines share")
        found = tempfile.mkdtemp(prefix="quillframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillframe/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def clean_up(spark: SparkSession) -> None:
    """Deletes the intermediate results of this application. Results of operators that are not written yet are lost with them."""
    system, place = _file_system(spark, own_dir(spark))
    system.delete(place, True)


def written(df: DataFrame, name: str) -> str:
    """The path of ``df`` as Parquet among the application's intermediate results."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written among the application's intermediate results and read from there: its lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))
