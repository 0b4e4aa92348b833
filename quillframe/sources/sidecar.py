"""Recorded requests and responses of an external recognizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import LINE_CONFIDENCE, real, strip

# Fixed value: the response as the recognizer sends it.
RESPONSE = "errorCode INT, errorMsg STRING, result STRUCT<ocrResults: ARRAY<STRUCT<prunedResult: STRUCT<rec_texts: ARRAY<STRING>, rec_scores: ARRAY<FLOAT>, rec_polys: ARRAY<ARRAY<ARRAY<INT>>>>>>>"


def request_body(content: Column, min_confidence: float = LINE_CONFIDENCE) -> Column:
    """A request as JSON: the image in base64 on one line (``base64`` breaks long lines), and the confidence floor."""
    image = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    flag = lambda name, value: F.lit(value).alias(name)
    return F.to_json(F.struct(
        image.alias("file"), flag("fileType", 1), flag("useDocOrientationClassify", False), flag("useDocUnwarping", False), flag("useTextlineOrientation", True),
        F.lit(min_confidence).cast("float").alias("textRecScoreThresh"), flag("visualize", False),
    ))


def parse_responses(responses: DataFrame, body: str = "body", status: str | None = None) -> DataFrame:
    """(doc_id, response, error_kind): another status than 2xx or an error code is a rejection; a response without a
    result, or whose texts, scores and polygons differ in number, breaks the protocol."""
    parsed = F.from_json(F.col(body), RESPONSE)
    refused = ~F.col(status).between(200, 299) if status else F.lit(False)
    uneven = F.exists(
        F.col("response.result.ocrResults"),
        lambda p: (F.size(p["prunedResult"]["rec_texts"]) != F.size(p["prunedResult"]["rec_scores"])) | (F.size(p["prunedResult"]["rec_texts"]) != F.size(p["prunedResult"]["rec_polys"])),
    )
    out = responses.withColumn("response", parsed)
    kind = (
        F.when(refused, "rejected")
        .when(F.coalesce(F.col("response.errorCode"), F.lit(0)) != 0, "rejected")
        .when(F.col("response.result.ocrResults").isNull(), "protocol")
        .when(F.coalesce(uneven, F.lit(True)), "protocol")
    )
    return out.select("doc_id", "response", kind.alias("error_kind"))


def flatten_lines(parsed: DataFrame, min_confidence: float = LINE_CONFIDENCE) -> DataFrame:
    """(doc_id, det_no, text, confidence, polygon) of the good responses: stripped texts that are not empty and sure enough, in order of pages and lines."""
    one = lambda p: F.arrays_zip(p["prunedResult"]["rec_texts"].alias("text"), p["prunedResult"]["rec_scores"].alias("confidence"), p["prunedResult"]["rec_polys"].alias("polygon"))
    all_lines = F.flatten(F.transform("response.result.ocrResults", one))  # numbered through all pages, however many lines a page has
    lines = parsed.where("error_kind IS NULL").select("doc_id", F.posexplode(all_lines).alias("det_no", "line"))
    out = lines.select("doc_id", "det_no", strip(F.col("line.text")).alias("text"), F.col("line.confidence").alias("confidence"), F.col("line.polygon").alias("polygon"))
    return out.where((F.col("text") != "") & (F.col("confidence") >= real(min_confidence)))
