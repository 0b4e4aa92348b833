"""Scanning, cropping and recognizing images, as map-only plans over decoded pixels.

Models are the caller's: a provider is any function from an image to what its model says. None is part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import crop_error, expand_quad, full_frame, order_corners
from quillframe.functions.text import LINE_CONFIDENCE
from quillframe.operators import jpeg, kernels
from quillframe.sources import sidecar

POINTS = "array<struct<x: float, y: float>>"
SCANS = f"id string, pixels binary, width int, height int, corners_detected boolean, corners {POINTS}, orig_width int, orig_height int"


def _image(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)


def detect_corners(images: DataFrame, heatmaps: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds ``corners`` and ``corners_detected`` to decoded images.

    ``heatmaps`` gives four maps for a 256 x 256 image with values 0-1 in red, green, blue. Each map's largest region gives a
    corner; without all four the corners are those of the frame. Ordering and expanding are expressions, after the kernel.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples():
                small = kernels.resize(_image(row)[:, :, ::-1], kernels.SCAN_SIDE, kernels.SCAN_SIDE).astype(np.float32) / 255
                points = [kernels.largest_blob(m, row.width, row.height) for m in heatmaps(small.transpose(2, 0, 1))]
                found.append(None if len(points) != 4 or None in points else [{"x": x, "y": y} for x, y in points])
            yield batch.assign(found=found)

    good = images.where("error_kind IS NULL").select("id", "height", "width", "data")
    out = good.mapInPandas(run, f"id string, height int, width int, data binary, found {POINTS}")
    corners = F.when(F.col("found").isNotNull(), expand_quad(order_corners(F.col("found")), F.col("width"), F.col("height")))
    return out.select("id", "height", "width", "data", F.coalesce(corners, full_frame(F.col("width"), F.col("height"))).alias("corners"), F.col("found").isNotNull().alias("corners_detected"))


def warp_images(images: DataFrame) -> DataFrame:
    """Straightened pixels of (id, height, width, data, corners, corners_detected), raw; ``as_jpeg`` makes files of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                out = kernels.warp(_image(row), np.array([[p["x"], p["y"]] for p in row.corners]))
                rows.append((row.id, out.tobytes(), out.shape[1], out.shape[0], row.corners_detected, row.corners, row.width, row.height))
            yield pd.DataFrame(rows, columns=["id", "pixels", "width", "height", "corners_detected", "corners", "orig_width", "orig_height"])

    return images.mapInPandas(run, SCANS)


def as_jpeg(scans: DataFrame, quality: int = jpeg.QUALITY) -> DataFrame:
    """Scans or crops with ``content``, a JPEG file, in place of their raw ``pixels``. Null pixels give null."""

    @F.pandas_udf("binary")
    def encoded(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else jpeg.encode(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3), quality) for p, w, h in zip(pixels, width, height)], dtype=object)

    return scans.withColumn("content", encoded("pixels", "width", "height")).drop("pixels")


def scan(images: DataFrame, heatmaps: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Detection and straightening of decoded images."""
    return warp_images(detect_corners(images, heatmaps))


def crop(requests: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crops, failures) of requests (id, corners) on the original images. Corners are taken in the order given."""
    # Pixels that nobody asked for stay where they are: ids are compared first, and only images that are asked for are joined.
    asked = images.where("error_kind IS NULL").drop("error_kind").join(requests.select("id").distinct(), "id", "left_semi")
    found = requests.join(asked, "id", "left")
    judged = found.withColumn("error_message", crop_error(F.col("corners"), F.col("width"), F.col("height"))).withColumn("error_kind", F.when(F.col("data").isNull(), "not_found").when(F.col("error_message").isNotNull(), "invalid_crop"))
    crops = judged.where("error_kind IS NULL").withColumn("corners_detected", F.lit(True)).select("id", "height", "width", "data", "corners", "corners_detected")
    return warp_images(crops), judged.where("error_kind IS NOT NULL").select("id", "error_kind", "error_message")


def recognize(images: DataFrame, provider: Callable[[np.ndarray], list[tuple[str, float, np.ndarray]]]) -> DataFrame:
    """(doc_id, det_no, text, confidence, polygon) rows for the page operators; ``provider`` gives (text, confidence, quad) for an image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row.id, i, text, confidence, [[int(x), int(y)] for x, y in quad]) for row in batch.itertuples() for i, (text, confidence, quad) in enumerate(provider(_image(row)))]
            yield pd.DataFrame(rows, columns=["doc_id", "det_no", "text", "confidence", "polygon"])

    return images.where("error_kind IS NULL").select("id", "height", "width", "data").mapInPandas(run, "doc_id string, det_no int, text string, confidence float, polygon array<array<int>>")


def recognized(backend: str = "local", images: DataFrame | None = None, provider: Callable[[np.ndarray], list[tuple[str, float, np.ndarray]]] | None = None, responses: DataFrame | None = None, min_confidence: float = LINE_CONFIDENCE) -> DataFrame:
    """Recognized lines from either backend: 'local' runs ``provider`` on ``images``, 'sidecar' reads recorded ``responses`` (doc_id, body)."""
    if backend == "local":
        return recognize(images, provider)
    if backend == "sidecar":
        return sidecar.flatten_lines(sidecar.parse_responses(responses), min_confidence)
    raise ValueError(f"{backend!r} is no backend: 'local' or 'sidecar'")


class LineReader:
    """A provider made of three models: text probability, orientation scores, and logits of a line. Built once a worker."""

    def __init__(self, detector, orientation, recognizer, symbols: list[str], max_side: int = 4000):
        self.detector, self.orientation, self.recognizer, self.symbols, self.max_side = detector, orientation, recognizer, symbols, max_side

    def size(self, height: int, width: int) -> tuple[int, int]:
        ratio = max(1.0, 64 / min(height, width))
        h, w = int(height * ratio), int(width * ratio)
        if max(h, w) > self.max_side:
            cap = self.max_side / max(h, w)
            h, w = int(h * cap), int(w * cap)
        return tuple(max(32, int(np.floor(v / 32 + 0.5)) * 32) for v in (h, w))

    def lines(self, image: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The lines of an image, upright and as high as the recognizer takes them, with their quads."""
        height, width = image.shape[:2]
        h, w = self.size(height, width)
        probability = self.detector(kernels.imagenet_planes(kernels.resize(image[:, :, ::-1], w, h)))
        for quad in kernels.text_boxes(probability, width, height):
            line = kernels.warp(image, quad)
            scores = self.orientation(line)
            if scores[1] > scores[0]:
                line = kernels.rotate_180(line)
            wide = int(np.clip(np.floor(line.shape[1] * 48 / line.shape[0] + 0.5), 1, 2000))
            yield kernels.resize(line, wide, 48), quad

    def __call__(self, image: np.ndarray) -> list[tuple[str, float, np.ndarray]]:
        return [(*decoded(np.asarray(self.recognizer(kernels.line_planes(line)), np.float32), self.symbols), quad) for line, quad in self.lines(image)]


def decoded(logits: np.ndarray, symbols: list[str]) -> tuple[str, float]:
    """Text and confidence of a line's logits (steps, symbols)."""
    best = logits.argmax(axis=1)
    kept = (best != 0) & (best != np.r_[-1, best[:-1]])
    text = "".join(symbols[i] for i in best[kept] if i < len(symbols))
    return text, float(logits.max(axis=1)[kept].mean(dtype=np.float32)) if kept.any() else 0.0


LINE_IMAGES = "doc_id string, det_no int, polygon array<array<int>>, wide int, pixels binary"


def line_images(images: DataFrame, reader: LineReader) -> DataFrame:
    """(doc_id, det_no, polygon, wide, pixels): the lines of images, upright, 48 pixels high and ``wide`` as the recognizer takes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                for i, (line, quad) in enumerate(reader.lines(_image(row))):
                    rows.append((row.id, i, [[int(x), int(y)] for x, y in quad], line.shape[1], line.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "det_no", "polygon", "wide", "pixels"])

    return images.where("error_kind IS NULL").select("id", "height", "width", "data").mapInPandas(run, LINE_IMAGES)


def read_in_batches(lines: DataFrame, recognizer: Callable[[np.ndarray], np.ndarray], symbols: list[str], steps: Callable[[int], int], size: int = 32, bucket: int = 64) -> DataFrame:
    """(doc_id, det_no, text, confidence, polygon) of ``line_images``, the lines of many images to one call of the recognizer.

    Lines of a task are sorted by width, and up to ``size`` of those whose widths round up to one multiple of ``bucket`` are padded
    to it with zeros and go together: ``recognizer`` takes (n, 3, 48, width) planes and gives (n, steps, symbols) logits, of which the first
    ``steps(wide)`` are a line's own. No line is shuffled: each comes back with its image's id and its number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(held: list) -> pd.DataFrame:
            wide = -(-held[0].wide // bucket) * bucket
            planes = np.zeros((len(held), 3, 48, wide), np.float32)
            for x, row in zip(planes, held):
                x[:, :, : row.wide] = kernels.line_planes(np.frombuffer(row.pixels, np.uint8).reshape(48, row.wide, 3))
            logits = np.asarray(recognizer(planes), np.float32)
            rows = [(row.doc_id, row.det_no, *decoded(x[: steps(row.wide)], symbols), [list(p) for p in row.polygon]) for x, row in zip(logits, held)]
            return pd.DataFrame(rows, columns=["doc_id", "det_no", "text", "confidence", "polygon"])

        held: list = []
        for batch in batches:
            for row in batch.itertuples():
                if held and (len(held) == size or -(-held[0].wide // bucket) != -(-row.wide // bucket)):
                    yield read(held)
                    held = []
                held.append(row)
        if held:
            yield read(held)

    sorted_ = lines.sortWithinPartitions("wide")
    return sorted_.mapInPandas(run, "doc_id string, det_no int, text string, confidence float, polygon array<array<int>>")
