"""The dictionary of a recognizer as a table, and its model outputs read with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.tensors import ctc_decode


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(at, symbol) of a text file with a symbol on each line: 0 is blank, lines count from 1, a space comes last.

    The file is read by Spark, whole, so that lines keep their order; a line break at the end ends the last line. Spaces
    are symbols, and an empty line is one without text. An empty file has blank and space alone. The files of a folder
    follow each other by path.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"))
    files = whole.select("path", lines.alias("lines")).agg(F.array_sort(F.collect_list(F.struct("path", "lines"))).alias("files"))
    symbols = F.concat(F.array(F.lit("")), F.flatten(F.transform("files", lambda f: f["lines"])), F.array(F.lit(" ")))
    return files.select(F.posexplode(symbols).alias("at", "symbol"))


def decode_outputs(outputs: DataFrame, symbols: DataFrame, logits_col: str = "logits") -> DataFrame:
    """``outputs`` with ``text`` and ``confidence``: greedy decoding with the symbols (at, symbol) of a dictionary.

    The symbols come as one array by a scalar subquery. A model's step has a value for each symbol, so that array is no
    longer than one step of one row. Null outputs have null results; columns called ``text`` or ``confidence`` are replaced.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda s: s["symbol"])
    all_symbols = symbols.agg(ordered.alias("symbols")).scalar()
    rest = [c for c in outputs.columns if c.lower() not in ("text", "confidence")]
    logits = F.col(logits_col)
    found = outputs.withColumn("__symbols", all_symbols).withColumn("__read", F.when(logits.isNotNull(), ctc_decode(logits, F.col("__symbols"))))
    return found.select(*(F.col(f"`{c}`") for c in rest), F.col("__read.text").alias("text"), F.col("__read.confidence").alias("confidence"))
