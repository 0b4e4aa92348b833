"""Failures as data: kind to status and message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status and public message by kind of failure; messages of internal failures say nothing of their cause.
FAILURES = {
    "missing_image": (400, "no image field found in multipart body"),
    "empty_image": (400, "uploaded image is empty"),
    "decode": (400, "failed to decode image"),
    "invalid_crop": (400, None),
    "multipart": (400, "invalid multipart upload"),
    "not_found": (404, "scan id not found"),
    "queue_timeout": (503, "OCR service is busy"),
    "transport_timeout": (504, "OCR service timed out"),
    "transport": (502, "OCR service is unavailable"),
    "rejected": (502, "OCR service is unavailable"),
    "protocol": (502, "OCR service is unavailable"),
    "unavailable": (500, "OCR service is unavailable"),
    "processing": (500, "internal server error"),
    "io": (500, "internal server error"),
    "config": (500, "internal server error"),
    "input_too_large": (500, "internal server error"),
    "blocking_task": (500, "internal server error"),
}


def error_response(kind: Column, detail: Column | None = None) -> Column:
    """struct(status, message) of a failure; 200 and null without one. ``detail`` is the message of an invalid crop."""
    status, message = F.lit(200), F.lit(None).cast("string")
    for name, (code, text) in FAILURES.items():
        status = F.when(kind == name, code).otherwise(status)
        message = F.when(kind == name, F.lit(text) if text else (detail if detail is not None else F.lit(None))).otherwise(message)
    return F.struct(status.alias("status"), message.alias("message"))
