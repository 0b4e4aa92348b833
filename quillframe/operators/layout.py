"""Label/value extraction by page geometry.

A page is one row with an array of its recognized lines in reading order. Lines meet in their page by one aggregation on
``doc_id``; everything after it is expressions over that array: no self-join, no further shuffle, and the same code
runs in batches and in streams. The work on a page grows with the square of its lines, which are tens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import (
    CARD_LABEL_WORDS,
    LABEL_CONFIDENCE,
    LINE_CONFIDENCE,
    VALUE_CONFIDENCE,
    inline_field,
    let,
    looks_like_label,
    make_field,
    real,
    strip,
)

#: Pixels by which a value may be off its label's left edge; twice that for a keyword lookup. Label heights down to a value.
DRIFT, FAR_DRIFT, HEIGHTS = 120, 240, 4
#: What a page knows of a line, in the order by which lines are sorted.
LINE_FIELDS = ("top", "left", "det_no", "text", "confidence", "right", "bottom", "height", "labelish")


def is_usable(text: Column, confidence: Column, min_confidence: float = LINE_CONFIDENCE) -> Column:
    """Whether a line of stripped text counts: it is not empty and sure enough."""
    return F.coalesce((text != "") & (confidence >= real(min_confidence)), F.lit(False))


def usable_lines(lines: DataFrame, min_confidence: float = LINE_CONFIDENCE) -> DataFrame:
    """Lines with stripped, non-empty text and enough confidence. Filters stay next to the scan."""
    return lines.withColumn("text", strip(F.col("text"))).where(is_usable(F.col("text"), F.col("confidence"), min_confidence))


def with_bounds(lines: DataFrame) -> DataFrame:
    """Adds left, top, right, bottom and height (1 at least) of each line's polygon."""
    side = lambda fold, axis: fold(F.transform("polygon", lambda p: p[axis]))
    out = lines.withColumns({"left": side(F.array_min, 0), "top": side(F.array_min, 1), "right": side(F.array_max, 0), "bottom": side(F.array_max, 1)})
    return out.withColumn("height", F.greatest(F.col("bottom") - F.col("top"), F.lit(1)))


def pages(lines: DataFrame, words: Sequence[str] = CARD_LABEL_WORDS, min_confidence: float = LINE_CONFIDENCE) -> DataFrame:
    """(doc_id, lines): one row per document with its usable lines by top, left and detection order, numbered from 0.

    A page without a usable line is a row with no lines, as it still has a result: a record of empty fields. Lines that are
    not usable bring only their page's id to the aggregation.

    Each line carries what the operators ask again and again: bounds, whether it reads as a label, whether it counts as
    a label or as a value.
    """
    known = with_bounds(lines.withColumn("text", strip(F.col("text")))).withColumn("labelish", looks_like_label(F.col("text"), words))
    usable = is_usable(F.col("text"), F.col("confidence"), min_confidence)
    by_doc = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(usable, F.struct(*LINE_FIELDS)))).alias("found"))
    return by_doc.select("doc_id", F.transform("found", _numbered).alias("lines"))


def whole_pages(frame: DataFrame, words: Sequence[str] = CARD_LABEL_WORDS, min_confidence: float = LINE_CONFIDENCE, lines: str = "lines") -> DataFrame:
    """Pages as ``pages`` makes them, of rows that hold all lines of their page already: array<struct<det_no, text, confidence, polygon>>. Nothing is shuffled."""

    def known(x: Column) -> Column:
        side = lambda fold, axis: fold(F.transform(x["polygon"], lambda p: p[axis]))
        bounds = F.struct(side(F.array_min, 1).alias("top"), side(F.array_min, 0).alias("left"), strip(x["text"]).alias("text"), side(F.array_max, 0).alias("right"), side(F.array_max, 1).alias("bottom"))

        def line(b: Column) -> Column:
            made = {"det_no": x["det_no"], "confidence": x["confidence"], "height": F.greatest(b["bottom"] - b["top"], F.lit(1)), "labelish": looks_like_label(b["text"], words)}
            return F.struct(*((made[c] if c in made else b[c]).alias(c) for c in LINE_FIELDS))

        return let(bounds, line)

    found = F.sort_array(F.filter(F.transform(lines, known), lambda x: is_usable(x["text"], x["confidence"], min_confidence)))
    return frame.withColumn("lines", F.transform(found, _numbered))


def _numbered(x: Column, i: Column) -> Column:
    is_label = x["labelish"] & (x["confidence"] >= real(LABEL_CONFIDENCE))
    value = ~is_label & (x["confidence"] >= real(VALUE_CONFIDENCE))
    return F.struct(
        i.alias("line_no"), *(x[c].alias(c) for c in ("text", "confidence", "left", "top", "right", "bottom", "height", "labelish")), F.upper(x["text"]).alias("upper"), is_label.alias("is_label"), value.alias("is_value")
    )


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(b["left"] - a["right"], a["left"] - b["right"], F.lit(0))


def share_row(a: Column, b: Column) -> Column:
    """Lines overlap vertically and are at most two heights apart."""
    return (a["top"] < b["bottom"]) & (b["top"] < a["bottom"]) & (_gap(a, b) <= F.greatest(a["height"], b["height"]) * 2)


def share_value_row(a: Column, b: Column) -> Column:
    """Lines whose middles differ by half a height at most and which are at most one height apart."""
    tallest = F.greatest(a["height"], b["height"])
    middle = F.floor(F.abs((a["top"] + a["bottom"]) - (b["top"] + b["bottom"])) / 2)
    return (middle <= F.floor(tallest / 2)) & (_gap(a, b) <= tallest)


def is_below(label: Column, value: Column) -> Column:
    """A value may overlap the lower half of its label."""
    return value["top"] >= label["bottom"] - F.floor(label["height"] / 2)


def vertical_gap(label: Column, value: Column) -> Column:
    """Negative where they overlap; then it is the nearest."""
    return value["top"] - label["bottom"]


def left_distance(label: Column, value: Column) -> Column:
    return F.abs(value["left"] - label["left"])


def by_left(lines: Column) -> Column:
    """Texts from left to right, joined by spaces; lines that begin at one place keep their order."""
    return F.array_join(F.transform(F.sort_array(F.transform(lines, lambda x: F.struct(x["left"], x["line_no"], x["text"]))), lambda x: x["text"]), " ")


def label_groups(lines: Column) -> Column:
    """Label lines in connected rows: an array of arrays. Each line in turn joins the groups that it touches into one."""
    labels = F.filter(lines, lambda x: x["is_label"])

    def add(groups: Column, x: Column) -> Column:
        touches = lambda g: F.exists(g, lambda y: share_row(x, y))
        joined = F.concat(F.flatten(F.filter(groups, touches)), F.array(x))
        return F.concat(F.filter(groups, lambda g: ~touches(g)), F.array(joined))

    return F.aggregate(labels, F.filter(F.array(labels), lambda g: F.lit(False)), add)


def group_bounds(group: Column) -> Column:
    fold = lambda f, name: f(F.transform(group, lambda x: x[name]))
    box = F.struct(fold(F.array_min, "left").alias("left"), fold(F.array_min, "top").alias("top"), fold(F.array_max, "right").alias("right"), fold(F.array_max, "bottom").alias("bottom"), fold(F.array_min, "line_no").alias("line_no"))
    return let(box, lambda b: F.struct(*(b[c].alias(c) for c in ("left", "top", "right", "bottom", "line_no")), F.greatest(b["bottom"] - b["top"], F.lit(1)).alias("height")))


def nearest_below(lines: Column, box: Column) -> Column:
    """The value line nearest below a label's box, by vertical gap, then left distance, then reading order; null if none is near."""
    near = F.filter(lines, lambda x: x["is_value"] & is_below(box, x) & (vertical_gap(box, x) <= box["height"] * HEIGHTS) & (left_distance(box, x) <= DRIFT))
    ranked = F.transform(near, lambda x: F.struct(vertical_gap(box, x).alias("gap"), left_distance(box, x).alias("distance"), x["line_no"].alias("line_no"), x.alias("line")))
    return F.array_min(ranked)["line"]


def value_row(lines: Column, anchor: Column) -> Column:
    """The value lines on the anchor's own row, with the anchor."""
    return F.filter(lines, lambda x: x["is_value"] & share_value_row(anchor, x))


def generic_fields(lines: Column) -> Column:
    """array<struct<label, value>>: fields in ``label: value`` lines and fields of label rows with the values below them.

    They are in the order of the label's first line; a line's own field comes before one that it labels.
    """
    inline = F.transform(lines, lambda x: F.struct(x["line_no"].alias("at"), F.lit(0).alias("kind"), inline_field(x["text"]).alias("field")))

    def spatial(group: Column) -> Column:
        def field(box: Column) -> Column:
            made = let(nearest_below(lines, box), lambda a: F.when(a.isNotNull(), make_field(by_left(group), by_left(value_row(lines, a)))))
            return F.struct(box["line_no"].alias("at"), F.lit(1).alias("kind"), made.alias("field"))

        return let(group_bounds(group), field)

    found = F.concat(inline, F.transform(label_groups(lines), spatial))
    return F.transform(F.sort_array(F.filter(found, lambda f: f["field"].isNotNull())), lambda f: f["field"])


def keyword_value(lines: Column, keyword: str) -> Column:
    """The value of the first line that holds the keyword: after its colon, else the nearest line below that is no label.

    There is no floor of confidence and no limit downwards; a value may be off by twice the usual drift.
    """

    def below(label: Column) -> Column:
        near = F.filter(lines, lambda x: (x["line_no"] != label["line_no"]) & is_below(label, x) & ~x["labelish"] & (left_distance(label, x) <= FAR_DRIFT))
        return F.array_min(F.transform(near, lambda x: F.struct(vertical_gap(label, x).alias("gap"), x["line_no"].alias("line_no"), strip(x["text"]).alias("text"))))["text"]

    def value(label: Column) -> Column:
        at = F.instr(label["text"], ":")
        after = F.when(at > 0, strip(F.substring(label["text"], at + 1, F.length(label["text"])))).otherwise("")
        return F.when(label.isNotNull(), let(after, lambda a: F.when(a != "", a).otherwise(below(label))))

    return let(F.get(F.filter(lines, lambda x: F.contains(x["upper"], F.lit(keyword))), F.lit(0)), value)


def field_value(fields: Column, keyword: str) -> Column:
    """The value of the first field whose label holds the keyword."""
    return F.get(F.filter(fields, lambda f: F.contains(f["label"], F.lit(keyword))), F.lit(0))["value"]


def explode_fields(frame: DataFrame, fields: str = "fields") -> DataFrame:
    """(doc_id, field_no, label, value) rows.

    The outer form, with a filter after it, keeps Spark from testing the array's size ahead of the explosion, for which
    it would work out the whole expression of the fields once more.
    """
    rows = frame.select("doc_id", F.posexplode_outer(fields).alias("field_no", "field")).where("field_no IS NOT NULL")
    return rows.select("doc_id", "field_no", "field.label", "field.value")


def fields_json(frame: DataFrame, fields: str = "fields") -> DataFrame:
    """(doc_id, body): the fields of a page as the JSON of a response; a page without any has an empty array."""
    made = F.coalesce(F.transform(fields, lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"))), F.array().cast("array<struct<label: string, value: string>>"))
    return frame.select("doc_id", F.to_json(F.struct(made.alias("fields"))).alias("body"))
