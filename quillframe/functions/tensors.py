"""Decoding of model outputs held in array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import let, real

#: Heatmap cells over this count as part of a blob.
BLOB = 0.3
# Channel means and deviations (red, green, blue) of the detector's input.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def vocabulary(lines: list[str]) -> list[str]:
    """Symbols of a recognizer by index: blank, the dictionary's lines, space."""
    return ["", *lines, " "]


def best_symbol(step: Column) -> Column:
    """struct(at, value): index from 0 of the first greatest value, and the value; NaN never wins."""
    known = F.transform(step, lambda v: F.when(F.isnan(v), F.lit(float("-inf")).cast("float")).otherwise(v.cast("float")))
    return let(known, lambda k: let(F.array_max(k), lambda m: F.struct((F.array_position(k, m) - 1).cast("int").alias("at"), m.alias("value"))))


def ctc_decode(logits: Column, symbols: Column) -> Column:
    """struct(text, confidence): greedy decoding of ``logits`` (steps x symbols) with ``symbols`` (an array of strings, 0 is blank).

    A step emits its best symbol unless that is blank or the same as at the step before, blanks included. Indexes beyond
    the symbols are passed over in the text. The confidence is the mean, in 32 bits, of the best values of emitting steps; 0 without any.
    """
    best = F.transform(logits, best_symbol)

    def emitted(b: Column) -> Column:
        kept = F.filter(b, lambda x, i: (x["at"] != 0) & F.when(i == 0, True).otherwise(x["at"] != F.get(b, i - 1)["at"]))
        return let(kept, read)

    def read(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda x: F.get(symbols, x["at"])), "")
        total = F.aggregate(kept, real(0), lambda a, x: a + x["value"])
        return F.struct(text.alias("text"), F.when(F.size(kept) > 0, (total / F.size(kept).cast("float")).cast("float")).otherwise(real(0)).alias("confidence"))

    return let(best, emitted)


def mask_centroid(grid: Column, width: int, threshold: float = BLOB) -> Column:
    """struct(x, y): centroid of all cells of a small grid (row by row) over the threshold; null without any.

    This takes the whole mask. The largest of several blobs alone is ``blobs.largest_blobs``.
    """
    cells = F.filter(F.transform(grid, lambda v, i: F.struct((i % width).alias("x"), F.floor(i / width).cast("int").alias("y"), (v > real(threshold)).alias("on"))), lambda c: c["on"])
    mean = lambda c, name: F.aggregate(c, F.lit(0), lambda a, x: a + x[name]) / F.size(c)
    return let(cells, lambda c: F.when(F.size(c) > 0, F.struct(mean(c, "x").alias("x"), mean(c, "y").alias("y"))))


def _planes(pixels: Column, value: Callable[[Column, int], Column]) -> Column:
    """Interleaved values of three channels, each by ``value``, one channel after the other."""
    count = F.floor(F.size(pixels) / 3).cast("int")
    channel = lambda c: F.transform(F.filter(pixels, lambda _, i: (i % 3 == c) & (i < count * 3)), lambda v: value(v.cast("float"), c).cast("float"))
    return F.concat(*(channel(c) for c in range(3)))


def imagenet_planes(pixels: Column) -> Column:
    """Bytes (red, green, blue, pixel after pixel) as three planes in 32 bits: scaled to 0-1, less the mean, over the deviation."""
    return _planes(pixels, lambda v, c: ((v / real(255)).cast("float") - real(MEAN[c])) / real(DEVIATION[c]))


def line_planes(pixels: Column) -> Column:
    """Bytes of three channels, pixel after pixel, as three planes from -1 to 1 in 32 bits."""
    return _planes(pixels, lambda v, _: (v - real(127.5)) / real(127.5))


def masked_mean(grid: Column, width: int, quad: Column) -> Column:
    """Mean of the cells of a map (rows of ``width``) inside a convex quad, its border included; 0 without any.

    Corners are rounded to cells, halves to the even one; only cells of the map within the quad's bounding box are visited.
    """
    height = F.floor(F.size(grid) / width).cast("int")
    axis = lambda name: F.transform(quad, lambda p: p[name].cast("double"))

    def span(name: str, size: Column) -> Column:
        low, high = F.floor(F.array_min(axis(name))).cast("int"), F.ceil(F.array_max(axis(name))).cast("int")
        low, high = F.greatest(low, F.lit(0)), F.least(high, size - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def inside(x: Column, y: Column, corners: Column) -> Column:
        sides = []
        for i in range(4):
            a, b = corners[i], corners[(i + 1) % 4]
            sides.append((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
        return (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)

    def mean(corners: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        within = lambda y: F.filter(span("x", F.lit(width)), lambda x: inside(x, y, corners))
        values = F.flatten(F.transform(span("y", height), lambda y: F.transform(within(y), lambda x: F.get(grid, y * width + x).cast("double"))))
        total = F.aggregate(values, zero, lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n")))
        return let(total, lambda t: F.when(t["n"] > 0, t["sum"] / t["n"]).otherwise(F.lit(0.0)))

    return let(F.transform(quad, lambda p: F.struct(F.rint(p["x"]).alias("x"), F.rint(p["y"]).alias("y"))), mean)


def is_upside_down(scores: Column) -> Column:
    """Whether an orientation model prefers the turned class."""
    return scores[1] > scores[0]
