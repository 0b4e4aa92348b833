"""Pages of any size: label rows, nearest values and fields as joins of lines.

``layout`` holds a page as one row, which suits pages of tens of lines. Here lines stay rows of their own, a page may have
millions of them, and what is near is found by a join on the cells of a grid, so that no page is a key. Results are
those of ``layout``, line by line and field by field.

Cells have the size of the lines in them: a line's level is the logarithm of its height, the taller of two lines waits in
the cells that it reaches at its own level, and the shorter one visits the cells that it covers at every level from its own
upwards. Each line has a few cells a level, and work grows with the lines and with the pairs that are near each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.text import CARD_LABEL_WORDS, LABEL_CONFIDENCE, LINE_CONFIDENCE, VALUE_CONFIDENCE, inline_field, looks_like_label, make_field, real
from quillframe.operators import layout
from quillframe.operators.connect import components
from quillframe.sources.store import kept

#: Widths of a cell in heights of its level: lines are long.
ASPECT = 8
#: What is shuffled of a line or a label row; its height follows from it.
SIDES = ("line_no", "left", "top", "right", "bottom")


def _numbers(group: str):
    """Adds ``__at``, the number of each row among those of its group in the task, from 0; the rows of a group follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(group))
            ends = runs.run_ends.to_numpy()
            at = np.arange(batch.num_rows) - np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0))
            if runs.values[0].as_py() == last:
                at[: ends[0]] += held
            last, held = runs.values[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "__at"])

    return run


def in_order(rows: DataFrame, group: str, order: Sequence[str], out: str, name: str = "order") -> DataFrame:
    """Numbers the rows of each group from 0 by ``order``, however many a group has.

    Rows are dealt by range and shuffled this once, so a large group is spread over many tasks. A task numbers its part of a
    group while the part is written; what the parts before it have is added as it is read. Only groups that several tasks share need
    that: fewer than there are tasks.
    """
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order).withColumn("__part", F.spark_partition_id())
    part = kept(dealt.mapInArrow(_numbers(group), T.StructType([*dealt.schema, T.StructField("__at", T.LongType())])), name)
    sizes = part.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    shared = kept(before.where("__before IS NOT NULL").select(F.col(group).alias("__group"), F.col("__part").alias("__of"), "__before"), "shared")
    found = part.join(F.broadcast(shared), (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")), "left")
    number = (F.col("__at") + F.coalesce(F.col("__before"), F.lit(0))).cast("long")
    return found.withColumn(out, number).drop("__part", "__at", "__of", "__group", "__before")


def ordered_lines(lines: DataFrame, words: Sequence[str] = CARD_LABEL_WORDS, min_confidence: float = LINE_CONFIDENCE) -> DataFrame:
    """Usable lines with bounds, flags and their number in reading order, written once for all that follows."""
    known = layout.with_bounds(layout.usable_lines(lines, min_confidence)).withColumn("labelish", looks_like_label(F.col("text"), words))
    is_label = F.col("labelish") & (F.col("confidence") >= real(LABEL_CONFIDENCE))
    flagged = known.select("doc_id", *layout.LINE_FIELDS, is_label.alias("is_label"), (~is_label & (F.col("confidence") >= real(VALUE_CONFIDENCE))).alias("is_value"))
    return in_order(flagged, "doc_id", layout.LINE_FIELDS, "line_no", "wide-lines")


def _level(height: Column) -> Column:
    """The least k with 2^k >= height."""
    return F.when(height <= 1, 0).otherwise(F.length(F.bin(height - 1))).cast("int")


def _levels(rows: DataFrame) -> list[int]:
    """The levels of heights that occur, 32 at most."""
    return sorted(r[0] for r in rows.select(_level(F.col("height"))).distinct().collect())


def _boxes(rows: DataFrame, prefix: str, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
    """The sides of lines or groups under a prefix, and the rectangle (x0, x1, y0, y1) by which they meet others."""
    sides = (F.col(c).alias(f"{prefix}{c}") for c in SIDES)
    return rows.select("doc_id", *sides, *(c.cast("long").alias(f"{prefix}{n}") for n, c in zip(("x0", "x1", "y0", "y1"), (*x, *y))), _level(F.col("height")).alias(f"{prefix}level"))


def _side(prefix: str) -> Column:
    height = F.greatest(F.col(f"{prefix}bottom") - F.col(f"{prefix}top"), F.lit(1))
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in SIDES), height.alias("height"))


def _cells(rows: DataFrame, prefix: str, level: Column, tall: Callable[[Column], Column], wide: Callable[[Column], Column]) -> DataFrame:
    """Rows for each cell that their rectangle covers; ``first`` has a bit for each axis on which it is the first of these cells."""
    out = rows.withColumn("level", level)
    firsts = F.lit(0)
    for axis, size, bit in (("x", wide, 1), ("y", tall, 2)):
        ends = [F.floor(F.col(f"{prefix}{axis}{i}") / size(F.col("level"))) for i in (0, 1)]
        out = out.withColumns({f"__{axis}": ends[0], f"cell_{axis}": F.explode(F.sequence(ends[0], ends[1]))})
        firsts = firsts + F.when(F.col(f"cell_{axis}") == F.col(f"__{axis}"), bit).otherwise(0)
    return out.withColumn(f"{prefix}first", firsts).drop("__x", "__y")


def meet(waiting: DataFrame, visiting: DataFrame, levels: Sequence[int], heights: int = 1, width: int | None = None, above: int = 0) -> DataFrame:
    """Pairs of rows of one page whose rectangles share a cell, each pair once: all that overlap, and some that are close.

    Rows are of ``_boxes`` with the prefixes ``w_`` and ``v_``. A visitor meets those who wait at its own level (or ``above`` it) and
    upwards. Cells are ``heights`` times 2^level high, and ``width`` wide, or ``ASPECT`` times their height.
    """
    tall = lambda k: F.call_function("shiftleft", F.lit(heights).cast("long"), k)
    wide = lambda k: F.lit(width).cast("long") if width else tall(k) * ASPECT
    here = _cells(waiting, "w_", F.col("w_level"), tall, wide)
    at = F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col("v_level") + above))
    there = _cells(visiting, "v_", at, tall, wide)
    keys = ["level", "cell_x", "cell_y"]
    # The first cell that both cover is on each axis the first of one of them.
    return here.join(there, ["doc_id", *keys]).where(F.col("w_first").bitwiseOR(F.col("v_first")) == 3).drop(*keys)


def label_groups(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, group_no): the connected row of each label line, by the number of its first line. ``lines`` are of ``ordered_lines``."""
    labels = lines.where("is_label").select("doc_id", *SIDES, "height")
    # Boxes that are the same overlap, unless they are flat: the first stands for all.
    first = F.min("line_no").over(Window.partitionBy("doc_id", "left", "top", "right", "bottom"))
    tall, flat = labels.where("top < bottom").withColumn("b", first), labels.where("top = bottom").withColumn("b", F.col("line_no"))
    known = kept(tall.unionByName(flat), "label-boxes")
    copies = known.where("line_no <> b").select("doc_id", F.col("line_no").alias("a"), "b")
    boxes = known.where("line_no = b").drop("b")
    y = (F.col("top"), F.greatest(F.col("bottom") - 1, F.col("top")))
    reach = F.col("height") * 2
    waiting = _boxes(boxes, "w_", (F.col("left") - reach, F.col("right") + reach), y)
    visiting = _boxes(boxes, "v_", (F.col("left"), F.col("right")), y)
    near = meet(waiting, visiting, _levels(boxes)).where(F.col("w_line_no") != F.col("v_line_no")).where(layout.share_row(_side("w_"), _side("v_")))
    edges = near.select("doc_id", F.col("w_line_no").alias("a"), F.col("v_line_no").alias("b")).unionByName(copies)
    found = components(edges, "doc_id")
    return labels.select("doc_id", F.col("line_no").alias("a")).join(found, ["doc_id", "a"], "left").select("doc_id", F.col("a").alias("line_no"), F.coalesce("b", "a").alias("group_no"))


def group_boxes(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, line_no, left, top, right, bottom, height, label) of label rows; ``line_no`` is that of the first line."""
    held = groups.join(lines.where("is_label").select("doc_id", "line_no", "left", "top", "right", "bottom", "text"), ["doc_id", "line_no"])
    made = held.groupBy("doc_id", F.col("group_no").alias("line_no")).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), layout.by_left(F.collect_list(F.struct("left", "line_no", "text"))).alias("label")
    )
    return made.withColumn("height", F.greatest(F.col("bottom") - F.col("top"), F.lit(1)))


def nearest_below(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, group_no, anchor, gap, distance): the value line nearest below each label row, where there is one near."""
    y = (F.col("bottom") - F.floor(F.col("height") / 2), F.col("bottom") + F.col("height") * layout.HEIGHTS)
    waiting = _boxes(boxes, "w_", (F.col("left") - layout.DRIFT, F.col("left") + layout.DRIFT), y)
    points = _boxes(lines.where("is_value"), "v_", (F.col("left"), F.col("left")), (F.col("top"), F.col("top"))).withColumn("v_level", F.lit(0))  # a point visits every level
    pairs = meet(waiting, points, _levels(boxes), heights=layout.HEIGHTS + 1, width=2 * layout.DRIFT)
    box, value = _side("w_"), _side("v_")
    gap, distance = layout.vertical_gap(box, value), layout.left_distance(box, value)
    near = pairs.where(layout.is_below(box, value) & (gap <= box["height"] * layout.HEIGHTS) & (distance <= layout.DRIFT))
    best = near.groupBy("doc_id", F.col("w_line_no").alias("group_no")).agg(F.min(F.struct(gap.alias("gap"), distance.alias("distance"), F.col("v_line_no").alias("anchor"))).alias("best"))
    return best.select("doc_id", "group_no", "best.anchor", "best.gap", "best.distance")


def value_rows(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, anchor, value): the texts of the value lines on the row of each anchor (doc_id, anchor), from left to right."""
    values = lines.where("is_value")
    wanted = values.join(anchors.select("doc_id", F.col("anchor").alias("line_no")).distinct(), ["doc_id", "line_no"], "left_semi")
    middle = F.col("top") + F.col("bottom")  # twice the middle, which differs by the taller height and 1 at most
    far = F.col("height") + 1
    waits = lambda rows: _boxes(rows, "w_", (F.col("left") - F.col("height"), F.col("right") + F.col("height")), (middle - far, middle + far))
    visits = lambda rows: _boxes(rows, "v_", (F.col("left"), F.col("right")), (middle, middle))
    levels = _levels(values)
    anchor_waits = meet(waits(wanted), visits(values), levels, heights=2).select("doc_id", _side("w_").alias("a"), _side("v_").alias("v"))
    met = anchor_waits
    if len(levels) > 1:  # else no value is taller than an anchor by a level
        taller = waits(values).where(F.col("w_level") > levels[0])
        met = met.unionByName(meet(taller, visits(wanted), levels, heights=2, above=1).select("doc_id", _side("v_").alias("a"), _side("w_").alias("v")))
    row = met.where(layout.share_value_row(F.col("a"), F.col("v"))).select("doc_id", F.col("a.line_no").alias("anchor"), F.col("v.line_no").alias("line_no"))
    texts = row.join(values.select("doc_id", "line_no", "left", "text"), ["doc_id", "line_no"])
    return texts.groupBy("doc_id", "anchor").agg(layout.by_left(F.collect_list(F.struct("left", "line_no", "text"))).alias("value"))


def generic_fields(lines: DataFrame) -> DataFrame:
    """(doc_id, field_no, label, value): the fields of ``layout.generic_fields``; ``lines`` are of ``ordered_lines``."""
    boxes = kept(group_boxes(lines, label_groups(lines)), "label-rows")
    nearest = kept(nearest_below(lines, boxes), "nearest")
    found = nearest.join(boxes.select("doc_id", F.col("line_no").alias("group_no"), "label"), ["doc_id", "group_no"]).join(value_rows(lines, nearest), ["doc_id", "anchor"])
    spatial = found.select("doc_id", F.col("group_no").alias("at"), F.lit(1).alias("kind"), make_field(F.col("label"), F.col("value")).alias("field"))
    inline = lines.select("doc_id", F.col("line_no").alias("at"), F.lit(0).alias("kind"), inline_field(F.col("text")).alias("field"))
    fields = inline.unionByName(spatial).where("field IS NOT NULL")
    return in_order(fields, "doc_id", ["at", "kind"], "number", "fields").select("doc_id", F.col("number").cast("int").alias("field_no"), "field.label", "field.value")
