"""Fields of a page as a table function of SQL: ``page_fields(TABLE(lines) PARTITION BY doc_id ORDER BY det_no)``."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillframe.functions.text import CARD_LABEL_WORDS, LABEL_CONFIDENCE, LINE_CONFIDENCE, VALUE_CONFIDENCE, WHITE_SPACE
from quillframe.operators.layout import DRIFT, HEIGHTS


#: Confidences are 32-bit, and come as the doubles that equal them.
_LINE, _VALUE, _LABEL = (float(np.float32(x)) for x in (LINE_CONFIDENCE, VALUE_CONFIDENCE, LABEL_CONFIDENCE))
_WORDS, _OTHER, _SMALL = frozenset(CARD_LABEL_WORDS), re.compile(rf"[^A-Za-z{WHITE_SPACE}]+"), re.compile("[a-z]")


def _is_label(text: str) -> bool:
    if _SMALL.search(text):
        return False
    words = _OTHER.sub("", text).split()
    return any(len(w) > 1 for w in words) and all(len(w) == 1 or w in _WORDS for w in words)


class _Line:
    __slots__ = ("text", "det_no", "left", "top", "right", "bottom", "height", "is_label", "is_value", "at")

    def __init__(self, det_no: int, text: str, confidence: float, polygon: list):
        self.text, self.det_no = text, det_no
        x, y = [p[0] for p in polygon], [p[1] for p in polygon]
        self.left, self.top, self.right, self.bottom = min(x), min(y), max(x), max(y)
        self.height = max(self.bottom - self.top, 1)
        self.is_label = confidence >= _LABEL and _is_label(text)
        self.is_value = not self.is_label and confidence >= _VALUE

    def gap(self, other: _Line) -> int:
        return max(other.left - self.right, self.left - other.right, 0)

    def shares_row(self, other: _Line) -> bool:
        return self.top < other.bottom and other.top < self.bottom and self.gap(other) <= 2 * max(self.height, other.height)

    def shares_value_row(self, other: _Line) -> bool:
        tallest = max(self.height, other.height)
        return abs(self.top + self.bottom - other.top - other.bottom) // 2 <= tallest // 2 and self.gap(other) <= tallest


def _joined(lines: list[_Line]) -> str:
    return " ".join(x.text for x in sorted(lines, key=lambda x: (x.left, x.at)))


def _field(label: str, value: str) -> tuple[str, str] | None:
    label, value = (x.strip(WHITE_SPACE).strip("*").strip(WHITE_SPACE) for x in (label, value))
    return (label, value) if label and value else None


@udtf(returnType="doc_id BIGINT, field_no INT, label STRING, value STRING")
class PageFields:
    """The generic fields of one page, which is one partition of the table argument; its lines are held in memory, as a page's are."""

    def __init__(self):
        self.doc_id, self.lines = None, []

    def eval(self, row):
        self.doc_id = row["doc_id"]
        confidence = row["confidence"]
        if confidence is not None and (confidence >= _LINE or confidence != confidence):
            text = (row["text"] or "").strip(WHITE_SPACE)
            if text:
                self.lines.append(_Line(row["det_no"], text, math.inf if confidence != confidence else confidence, row["polygon"]))  # not a number: above all, as in Spark

    def terminate(self):
        lines = sorted(self.lines, key=lambda x: (x.top, x.left, x.det_no))
        groups: list[list[_Line]] = []
        for at, x in enumerate(lines):
            x.at = at
            if x.is_label:
                touched = [g for g in groups if any(x.shares_row(y) for y in g)]
                groups = [g for g in groups if g not in touched] + [[y for g in touched for y in g] + [x]]
        found = []
        for x in lines:
            if ":" in x.text:
                found.append((x.at, 0, _field(*x.text.split(":", 1))))
        for g in groups:
            left, top, bottom = min(x.left for x in g), min(x.top for x in g), max(x.bottom for x in g)
            height = max(bottom - top, 1)
            near = [(v.top - bottom, abs(v.left - left), v.at) for v in lines if v.is_value and v.top >= bottom - height // 2 and v.top - bottom <= HEIGHTS * height and abs(v.left - left) <= DRIFT]
            if near:
                anchor = lines[min(near)[2]]
                found.append((min(x.at for x in g), 1, _field(_joined(g), _joined([v for v in lines if v.is_value and v.shares_value_row(anchor)]))))
        for no, (label, value) in enumerate(f for _, _, f in sorted(found, key=lambda f: f[:2]) if f):
            yield self.doc_id, no, label, value


def register(spark: SparkSession) -> None:
    """Makes ``page_fields`` known to the session. Its table has doc_id, det_no, text, confidence and polygon."""
    spark.udtf.register("page_fields", PageFields)
