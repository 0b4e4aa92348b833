"""Document types and field signatures as data, and the operator that applies them.

A new document type is a new ``DocumentType``; no code changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import contains_ci, has_devanagari, join_unique, let, make_field, matches_shape
from quillframe.operators.layout import by_left, field_value, generic_fields, keyword_value


@dataclass(frozen=True)
class Block:
    """Lines of one shape between the first line with ``label`` and the next with ``stop``: ``concat`` joins pieces of one
    value from left to right, ``unique`` lists forms of the same value in reading order."""

    label: str
    stop: str
    shape: str
    join: str = "unique"


@dataclass(frozen=True)
class Signature:
    label: str
    keywords: tuple[str, ...] = ()
    block: Block | None = None
    shape: str | None = None
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class DocumentType:
    """``least`` of the keywords must occur for a page to be of this type."""

    name: str
    keywords: tuple[str, ...]
    least: int
    fields: tuple[Signature, ...]


# The known document types, tried in this order.
IDENTITY_CARD = DocumentType(
    "identity_card",
    ("IDENTITY", "NATIONALITY", "FULL NAME", "परिचय", "राष्ट्रिय"),
    2,
    (
        Signature("NATIONAL ID NUMBER", (), Block("परिचय", "नाम", "identity_number"), "identity_number"),
        Signature("NATIONALITY", ("NATIONALITY",)),
        Signature("FULL NAME", ("FULL NAME",), Block("नाम", "FULL NAME", "devanagari", "concat")),
        Signature("DATE OF ISSUE", ("DATE OF ISSUE",)),
        Signature("DATE OF BIRTH", (), None, "date"),
        Signature("SEX", ("SEX",), None, "enum", ("पुरुष", "पुरूष", "महिला", "अन्य")),
    ),
)
CITIZENSHIP_CARD = DocumentType(
    "citizenship_card",
    ("CITIZENSHIP TYPE", "CC NUMBER", "ICC NUMBER"),
    2,
    (
        Signature("PERMANENT ADDRESS", ("PERMANENT ADDRESS",), Block("PERMANENT ADDRESS", "CITIZENSHIP TYPE", "lowercase", "concat")),
        Signature("NICIN", ("NICIN",)),
        Signature("CITIZENSHIP TYPE", ("CITIZENSHIP TYPE",)),
        Signature("CITIZENSHIP NUMBER", ("CC NUMBER", "ICC NUMBER")),
    ),
)
CARD_TYPES = (IDENTITY_CARD, CITIZENSHIP_CARD)
PASSPORT = DocumentType(
    "passport",
    ("PASSPORT", "SURNAME", "GIVEN NAMES", "NATIONALITY", "DATE OF BIRTH", "राहदानी"),
    2,
    tuple(
        Signature(label, (keyword,))
        for label, keyword in (
            ("TYPE", "TYPE"), ("COUNTRY CODE", "COUNTRY CODE"), ("PASSPORT NUMBER", "PASSPORT NO"), ("SURNAME", "SURNAME"), ("GIVEN NAMES", "GIVEN NAMES"),
            ("NATIONALITY", "NATIONALITY"), ("DATE OF BIRTH", "DATE OF BIRTH"), ("SEX", "SEX"), ("DATE OF ISSUE", "DATE OF ISSUE"), ("DATE OF EXPIRY", "DATE OF EXPIRY"),
            ("CITIZENSHIP NUMBER", "CITIZENSHIP NO"), ("PLACE OF BIRTH", "PLACE OF BIRTH"), ("ISSUING AUTHORITY", "ISSUING AUTHORITY"),
        )
    ),
)


def keyword_hits(lines: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur on any line, in any letter case."""
    total = F.lit(0)
    for keyword in keywords:
        total = total + _hit(lines, keyword)
    return total


def _hit(lines: Column, keyword: str) -> Column:
    return F.exists(lines, lambda x: contains_ci(x["text"], keyword)).cast("int")


def detect_type(lines: Column, types: Sequence[DocumentType] = CARD_TYPES) -> Column:
    """The name of the first type with enough keywords; null if none has."""
    return F.coalesce(*(F.when(keyword_hits(lines, t.keywords) >= t.least, F.lit(t.name)) for t in types))


def collect_block(lines: Column, block: Block) -> Column:
    """struct(text, consumed) of a block's lines; null if it has none."""
    start = F.array_min(F.transform(F.filter(lines, lambda x: F.contains(x["text"], F.lit(block.label))), lambda x: x["line_no"]))

    def between(s: Column) -> Column:
        stop = F.array_min(F.transform(F.filter(lines, lambda x: (x["line_no"] > s) & F.contains(x["text"], F.lit(block.stop))), lambda x: x["line_no"]))
        return let(F.coalesce(stop, F.lit(2**31 - 1)), lambda e: F.filter(lines, lambda x: (x["line_no"] > s) & (x["line_no"] < e) & matches_shape(x["text"], block.shape)))

    def joined(found: Column) -> Column:
        if block.join == "concat":
            ordered = F.transform(F.sort_array(F.transform(found, lambda x: F.struct(x["left"], x["line_no"], x["text"]))), lambda x: x["text"])
            text = by_left(found)
        else:
            ordered = F.transform(found, lambda x: x["text"])
            text = join_unique(ordered)
        return F.when(F.size(found) > 0, F.struct(F.coalesce(text, F.lit("")).alias("text"), ordered.alias("consumed")))

    whole = let(start, lambda s: F.when(s.isNotNull(), let(between(s), joined)))
    return let(whole, lambda b: F.when(b["text"] != "", b))


def _signature_fields(pages: DataFrame, kind: DocumentType, out: str) -> DataFrame:
    """Adds ``out``: the fields of one document type, null for pages of another.

    Signatures are applied in order and share what earlier ones have used: a shape found anywhere on the page is not a
    value that a block or a keyword took before, of this field or of an earlier one.
    """
    empty = F.filter(F.col("lines"), lambda _: F.lit(False))
    frame = pages.withColumns({"__lines": F.when(F.col("type") == kind.name, F.col("lines")).otherwise(empty), "__used": F.array().cast("array<string>")})
    made = []
    for i, signature in enumerate(kind.fields):
        lines, taken = F.col("__lines"), F.col("__used")
        parts = []
        if signature.block:
            frame = frame.withColumn("__block", collect_block(lines, signature.block))
            parts.append(F.col("__block")["text"])
            taken = F.concat(taken, F.coalesce(F.col("__block")["consumed"], F.array().cast("array<string>")))
        for n, keyword in enumerate(signature.keywords):
            frame = frame.withColumn(f"__key{n}", F.when(F.size("__lines") > 0, F.coalesce(field_value(F.col("generic"), keyword), keyword_value(lines, keyword))))
            parts.append(F.col(f"__key{n}"))
        if signature.keywords:
            taken = F.concat(taken, F.array_compact(F.array(*(F.col(f"__key{n}") for n in range(len(signature.keywords))))))
        frame = frame.withColumn("__used", taken)
        if signature.shape:
            texts = F.transform(_shaped(lines, signature), lambda x: x["text"])
            parts.append(join_unique(F.filter(texts, lambda t: ~F.array_contains(F.col("__used"), t))))
        found = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
        ordered = let(found, lambda p: F.concat(F.filter(p, has_devanagari), F.filter(p, lambda x: ~has_devanagari(x))))
        frame = frame.withColumn(f"__field{i}", make_field(F.lit(signature.label), join_unique(ordered)))
        made.append(f"__field{i}")
    frame = frame.withColumn(out, F.when(F.col("type") == kind.name, F.array_compact(F.array(*map(F.col, made)))))
    return frame.drop("__lines", "__used", "__block", *made, *(f"__key{n}" for n in range(9)))


def _shaped(lines: Column, signature: Signature) -> Column:
    return F.filter(lines, lambda x: matches_shape(x["text"], signature.shape, signature.options))


def card_fields(pages: DataFrame, types: Sequence[DocumentType] = CARD_TYPES) -> DataFrame:
    """(doc_id, type, fields): signature fields of pages with a known type, generic fields of the others (type null)."""
    frame = pages.withColumns({"generic": generic_fields(F.col("lines")), "type": detect_type(F.col("lines"), types)})
    names = []
    for kind in types:
        frame = _signature_fields(frame, kind, f"__{kind.name}")
        names.append(f"__{kind.name}")
    return frame.select("doc_id", "type", F.coalesce(*map(F.col, names), F.col("generic")).alias("fields"))


def passport_fields(pages: DataFrame, kind: DocumentType = PASSPORT) -> DataFrame:
    """(doc_id, type, fields): as ``card_fields``, but a keyword's own line and the one below it come first and the generic
    field second, and the first keyword that finds a value ends the search."""
    frame = pages.withColumns({"generic": generic_fields(F.col("lines")), "type": detect_type(F.col("lines"), (kind,))})
    made = []
    for signature in kind.fields:
        value = F.coalesce(*(x for k in signature.keywords for x in (keyword_value(F.col("lines"), k), field_value(F.col("generic"), k))))
        made.append(make_field(F.lit(signature.label), value))
    return frame.select("doc_id", "lines", "type", F.when(F.col("type") == kind.name, F.array_compact(F.array(*made))).otherwise(F.col("generic")).alias("fields"))
