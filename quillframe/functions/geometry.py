"""Quadrilaterals and box sizes as column expressions. Points are struct<x float, y float>; quads are arrays of four, from the top left clockwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import let, real

# Outward expansion of a quad, crop limits in pixels, detector sizes, unclip ratio, recognizer sizes, box thresholds.
EXPAND = 0.025
SMALLEST_EDGE, LARGEST_EDGE, LEAST_TWICE_AREA = 2.0, 16384.0, 4.0
DETECTOR_MIN_SIDE, CARD_MAX_SIDE, PASSPORT_MAX_SIDE, DETECTOR_STEP = 64, 4000, 1600, 32
UNCLIP, BOX_SCORE, BOX_SIDE, BOX_POINTS = 1.5, 0.6, 3.0, 3
RECOGNIZER_HEIGHT, RECOGNIZER_MAX_WIDTH = 48, 2000
CROP_ERRORS = (
    "crop corners must be finite and inside the original image",
    "crop is too small",
    "crop dimensions are too large",
    "crop corners are degenerate",
)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))


def order_corners(points: Column) -> Column:
    """Top left has the least x + y, bottom right the greatest, top right the greatest x - y, bottom left the least.

    Of equal ones the first is the least and the last is the greatest. A point may take two places.
    """

    def pick(key: Callable[[Column], Column], last: bool) -> Column:
        keys = F.transform(points, key)
        best = F.array_max(keys) if last else F.array_min(keys)
        at = F.array_position(F.reverse(keys), best) * -1 if last else F.array_position(keys, best)
        return F.element_at(points, at.cast("int"))

    total, across = (lambda p: p["x"] + p["y"]), (lambda p: p["x"] - p["y"])
    return F.array(pick(total, False), pick(across, True), pick(total, True), pick(across, False))


def centroid(points: Column) -> Column:
    """Mean x and y, in 32 bits."""
    mean = lambda name: (F.aggregate(points, real(0), lambda a, p: a + p[name]) / real(4)).cast("float")
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def expand_quad(points: Column, width: Column, height: Column) -> Column:
    """Corners moved out from the centre by 2.5 % and kept inside the image."""

    def move(v: Column, c: Column, size: Column) -> Column:
        out = (c + (v - c) * (real(1) + real(EXPAND))).cast("float")
        return F.least(F.greatest(out, real(0)), size.cast("float") - real(1))

    return let(centroid(points), lambda c: F.transform(points, lambda p: point(move(p["x"], c["x"], width), move(p["y"], c["y"], height))))


def distance(a: Column, b: Column, wide: bool = False) -> Column:
    """Distance of two points as a double; the squares are in 32 bits, or in 64 if ``wide``."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    if wide:
        dx, dy = dx.cast("double"), dy.cast("double")
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def _edges(q: Column, wide: bool) -> tuple[Column, Column]:
    tl, tr, br, bl = (q[i] for i in range(4))
    return F.greatest(distance(br, bl, wide), distance(tr, tl, wide)), F.greatest(distance(tr, br, wide), distance(tl, bl, wide))


def crop_size(quad: Column, wide: bool = False) -> Column:
    """struct(width, height): the longer of opposite edges, rounded half up, 1 at least."""
    w, h = _edges(quad, wide)
    whole = lambda v: F.greatest(F.floor(v + 0.5).cast("int"), F.lit(1))
    return F.struct(whole(w).alias("width"), whole(h).alias("height"))


def straightening(quad: Column, width: Column, height: Column) -> Column:
    """The projective map, row by row as an array of nine doubles up to a factor, that takes the corners of a quad to those of a
    straight image of the given size. Null where three corners that follow each other lie on a line.

    The map of the unit square to the quad has a closed form; its adjugate is the way back.
    """
    corner = lambda q, i, name: q[i][name].cast("double")

    def forward(q: Column) -> Column:
        (x0, x1, x2, x3), (y0, y1, y2, y3) = ([corner(q, i, name) for i in range(4)] for name in "xy")
        u, v, w, z = x1 - x2, x3 - x2, y1 - y2, y3 - y2
        sx, sy, det = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3, u * z - v * w
        g, h = F.try_divide(sx * z - v * sy, det), F.try_divide(u * sy - sx * w, det)
        return let(F.struct(g.alias("g"), h.alias("h")), lambda p: F.array(x1 - x0 + p["g"] * x1, x3 - x0 + p["h"] * x3, x0, y1 - y0 + p["g"] * y1, y3 - y0 + p["h"] * y3, y0, p["g"], p["h"]))

    def back(m: Column) -> Column:
        a, b, c, d, e, f, g, h = (m[i] for i in range(8))
        across, down = (s.cast("double") - 1 for s in (width, height))
        rows = ((e - f * h) * across, (c * h - b) * across, (b * f - c * e) * across, (f * g - d) * down, (a - c * g) * down, (c * d - a * f) * down, d * h - e * g, b * g - a * h, a * e - b * d)
        whole = (m[6].isNotNull()) & ((a * e - b * d) != 0) & (((a - c * g) * (e - f * h) - (b - c * h) * (d - f * g)) != 0)
        return F.when(whole, F.array(*rows))

    return let(forward(quad), back)


def project(map_: Column, x: Column, y: Column) -> Column:
    """struct(x, y): where a projective map takes a point; null beyond the horizon."""
    x, y = x.cast("double"), y.cast("double")
    part = lambda i: map_[i] * x + map_[i + 1] * y + map_[i + 2]
    return F.struct(F.try_divide(part(0), part(6)).alias("x"), F.try_divide(part(3), part(6)).alias("y"))


def twice_area(quad: Column) -> Column:
    """Absolute shoelace sum, in 32 bits."""
    total = real(0)
    for i in range(4):
        a, b = quad[i], quad[(i + 1) % 4]
        total = total + (a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(total)


def crop_error(quad: Column, width: Column, height: Column) -> Column:
    """What is wrong with a crop, the first of four complaints in order; null if nothing is. Four corners, written out, stay in generated code."""
    outside = F.lit(False)
    for i in range(4):
        x, y = quad[i]["x"], quad[i]["y"]
        outside = outside | F.isnan(x) | F.isnan(y) | (x < 0) | (y < 0) | (x > (width - 1).cast("float")) | (y > (height - 1).cast("float"))
    w, h = _edges(quad, False)
    return (
        F.when(outside, CROP_ERRORS[0])
        .when((w < SMALLEST_EDGE) | (h < SMALLEST_EDGE), CROP_ERRORS[1])
        .when((w > LARGEST_EDGE) | (h > LARGEST_EDGE), CROP_ERRORS[2])
        .when(twice_area(quad) < real(LEAST_TWICE_AREA), CROP_ERRORS[3])
    )


def full_frame(width: Column, height: Column) -> Column:
    """The whole image as a quad."""
    right, bottom = width - 1, height - 1
    zero = F.lit(0)
    return F.array(point(zero, zero), point(right, zero), point(right, bottom), point(zero, bottom))


def detector_size(height: Column, width: Column, max_side: int = CARD_MAX_SIDE) -> Column:
    """struct(height, width) for the text detector: grown so that the shorter side has 64 pixels, shrunk so that the
    longer has ``max_side``, both cut to whole pixels, then rounded to multiples of 32, 32 at least."""
    least = F.least(height, width)
    ratio = F.when(least < DETECTOR_MIN_SIDE, F.lit(float(DETECTOR_MIN_SIDE)) / least).otherwise(F.lit(1.0))

    def capped(s: Column) -> Column:
        most = F.greatest(s["h"], s["w"])
        cap = F.lit(float(max_side)) / most
        cut = lambda v: F.when(most > max_side, (v * cap).cast("int")).otherwise(v)
        step = lambda v: F.greatest((F.floor(v / float(DETECTOR_STEP) + 0.5) * DETECTOR_STEP).cast("int"), F.lit(DETECTOR_STEP))
        return F.struct(step(cut(s["h"])).alias("height"), step(cut(s["w"])).alias("width"))

    return let(F.struct((height * ratio).cast("int").alias("h"), (width * ratio).cast("int").alias("w")), capped)


def unclip(width: Column, height: Column, ratio: float = UNCLIP) -> Column:
    """struct(width, height) of a box grown on all sides by area * ratio / perimeter, in 32 bits."""
    w, h = width.cast("float"), height.cast("float")
    around = real(2) * (w + h)
    by = F.when(around > 0, (w * h * real(ratio) / around).cast("float")).otherwise(real(0))
    return let(by, lambda d: F.struct((w + real(2) * d).cast("float").alias("width"), (h + real(2) * d).cast("float").alias("height")))


def rescale_box(quad: Column, ratio_w: Column, ratio_h: Column, width: Column, height: Column) -> Column:
    """A quad of the detector's image in pixels of the original one, kept inside it."""
    clamp = lambda v, size: F.least(F.greatest(v.cast("float"), real(0)), size.cast("float") - real(1))
    return F.transform(quad, lambda p: point(clamp(p["x"] / ratio_w.cast("float"), width), clamp(p["y"] / ratio_h.cast("float"), height)))


def box_passes(points: Column, width: Column, height: Column, score: Column) -> Column:
    """The detector's filters: points of the contour, sides before and after growing, mean score."""
    grown = unclip(width, height)
    side = F.least(width.cast("float"), height.cast("float")) >= real(BOX_SIDE)
    after = let(grown, lambda g: F.least(g["width"], g["height"]) >= real(BOX_SIDE))
    return (points >= BOX_POINTS) & side & (score.cast("float") >= real(BOX_SCORE)) & after


def recognizer_width(width: Column, height: Column) -> Column:
    """Width of a line 48 pixels high, rounded half up, from 1 to 2000."""
    wide = F.floor(width * float(RECOGNIZER_HEIGHT) / height + 0.5)
    return F.least(F.greatest(wide, F.lit(1)), F.lit(RECOGNIZER_MAX_WIDTH)).cast("int")
