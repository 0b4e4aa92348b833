"""Kernels, sources, providers and the stream, on images made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import errors
from quillframe.operators import documents, jpeg, kernels
from quillframe.sources import config, images, sidecar
from quillframe.streaming import pages as stream


def png(pixels: np.ndarray) -> bytes:
    """An image file of (H, W, 3) bytes in red, green, blue."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def picture(h=40, w=60):
    rng = np.random.default_rng(1)
    return rng.integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_planes():
    image = np.array([[[255, 0, 127]]], np.uint8)
    assert np.allclose(kernels.imagenet_planes(image)[:, 0, 0], [(1 - 0.485) / 0.229, -0.456 / 0.224, (127 / 255 - 0.406) / 0.225], atol=1e-6)
    assert np.allclose(kernels.line_planes(image)[:, 0, 0], [1, -1, -0.5 / 127.5], atol=1e-6)


def test_warping_the_whole_frame_changes_nothing():
    image = picture()
    assert (kernels.warp(image, np.array([[0, 0], [59, 0], [59, 39], [0, 39]])).shape) == (39, 59, 3)
    part = kernels.warp(image, np.array([[5, 5], [25, 5], [25, 15], [5, 15]]))
    assert part.shape == (10, 20, 3)
    turned = kernels.warp(image, np.array([[59, 39], [0, 39], [0, 0], [59, 0]]))
    assert np.abs(turned[0, 0].astype(int) - image[39, 59]).max() <= 1


def test_shrinking():
    assert kernels.shrink(picture(), 30).shape == (20, 30, 3) and kernels.shrink(picture(), 60).shape == (40, 60, 3)


def test_homography_maps_its_points():
    source, target = [[0, 0], [10, 1], [9, 12], [-1, 8]], [[3, 4], [50, 2], [60, 70], [1, 66]]
    h = kernels.homography(source, target)
    for (x, y), want in zip(source, target):
        u = h @ [x, y, 1]
        assert np.allclose(u[:2] / u[2], want)


def test_blobs():
    grid = np.zeros((8, 10), np.float32)
    grid[1, 1] = grid[2, 2] = 0.9
    grid[5:7, 5:9] = 0.5
    assert kernels.largest_blob(grid) == (6.5, 5.5)
    assert kernels.label_blobs(grid > 0.3).max() == 2
    assert kernels.largest_blob(grid * 0.1) is None
    assert kernels.largest_blob(np.ones((3, 5), np.float32)) == (2.0, 1.0)
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, 8] = snake[3::4, 0] = True
    assert kernels.label_blobs(snake).max() == 1


def test_text_boxes():
    grid = np.zeros((64, 128), np.float32)
    grid[10:20, 10:90] = 0.9
    grid[40:44, 10:50] = 0.4  # over the threshold, under the score
    grid[60, 3] = 0.9
    boxes = kernels.text_boxes(grid, 256, 128)
    assert len(boxes) == 1
    tl, _, br, _ = boxes[0]
    assert tl[0] < 20 and tl[1] < 20 and br[0] > 178 and br[1] > 38


def test_outlines_and_holes():
    """Regions and holes against a search cell by cell."""

    def parts(cells, steps):
        left, out = set(cells), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                y, x = todo.pop()
                seen.add((y, x))
                near = {(y + i, x + j) for i, j in steps} & left
                left -= near
                todo += near
            out.append(seen)
        return out

    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    eight = [*four, (1, 1), (1, -1), (-1, 1), (-1, -1)]
    rng = np.random.default_rng(3)
    for density in (0.3, 0.5, 0.7, 0.9, 1.0, 0.0):
        mask = rng.random((17, 23)) < density
        regions = parts(map(tuple, np.argwhere(mask).tolist()), eight)
        expected = [*regions]
        for hole in parts(map(tuple, np.argwhere(~np.pad(mask, 1)).tolist()), four):
            if (0, 0) not in hole:
                touched = {(y + i - 1, x + j - 1) for y, x in hole for i, j in four if mask[y + i - 1, x + j - 1]}
                expected.append(touched & next(r for r in regions if (min(hole)[0] - 2, min(hole)[1] - 1) in r))
        found = [{(int(y), int(x)) for x, y in points} for points in kernels.outlines(mask)]
        assert sorted(map(sorted, found)) == sorted(map(sorted, expected))

    grid = np.zeros((64, 128), np.float32)
    grid[10:30, 10:90] = 0.95
    grid[18:21, 40:43] = 0.3
    boxes = kernels.text_boxes(grid, 128, 64)
    assert len(boxes) == 2 and np.abs(boxes[1].mean(axis=0) - [41, 19]).max() < 1.5


def test_jpeg(spark, tmp_path):
    """Files that another decoder reads as nearly the same pixels, of every shape, flat and noisy."""
    y, x = np.mgrid[:75, :130]
    smooth = np.stack([x, 2 * y, 255 - x], axis=2).astype(np.uint8)
    shapes = {"smooth": smooth, "one": smooth[:1, :1], "row": smooth[:1], "column": smooth[:, :1], "even": smooth[:64, :128], "flat": np.full((40, 50, 3), 200, np.uint8), "black": np.zeros((16, 16, 3), np.uint8)}
    shapes["noise"] = np.repeat(np.random.default_rng(5).integers(0, 256, (75, 130, 1), dtype=np.uint8), 3, axis=2)
    for name, pixels in shapes.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(pixels))
    read = {r.path.rsplit("/", 1)[1][:-4]: r.id for r in images.read_uploads(spark, str(tmp_path)).collect()}
    found = {r.id: r for r in images.read_images(spark, str(tmp_path)).collect()}
    for name, pixels in shapes.items():
        row = found[read[name]]
        assert row.error_kind is None and (row.height, row.width) == pixels.shape[:2], name
        off = np.abs(np.frombuffer(row.data, np.uint8).reshape(pixels.shape).astype(int) - pixels)
        assert off.mean() < 4 and np.percentile(off, 99) <= 16, (name, off.mean())
    assert len(jpeg.encode(smooth)) < smooth.size / 8 and len(jpeg.encode(smooth, 30)) < len(jpeg.encode(smooth))

    skewed = jpeg.code_lengths({s: 3**s for s in range(24)}, 16)
    assert max(skewed.values()) == 16 and sum(2.0**-n for n in skewed.values()) == 1

    scans = documents.scan(images.read_images(spark, str(tmp_path)), lambda _: np.zeros((4, 256, 256), np.float32))
    files = documents.as_jpeg(scans.where("width > 100")).withColumn("crop_no", F.lit(1))
    images.write_crops(files, str(tmp_path / "store"))
    stored = images.read_crops(spark, str(tmp_path / "store"))
    assert "pixels" not in stored.columns and stored.count() > 2
    assert all(bytes(r.content).startswith(b"\xff\xd8") and bytes(r.content).endswith(b"\xff\xd9") for r in stored.collect())


def test_uploads_and_images(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(picture()))
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "broken.png").write_bytes(b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_uploads(spark, str(tmp_path)).collect()}
    assert rows["good.png"].error_kind is None and rows["good.png"].length == len(rows["good.png"].content)
    assert images.read_uploads(spark, str(tmp_path)).where("error_kind IS NOT NULL").count() == 0
    found = images.read_images(spark, str(tmp_path)).collect()
    assert sorted(r.error_kind or "" for r in found) in (["", "decode", "decode"], ["", "decode"])
    good = next(r for r in found if r.error_kind is None)
    assert (np.frombuffer(good.data, np.uint8).reshape(40, 60, 3)[:, :, ::-1] == picture()).all()
    assert good.id == rows["good.png"].id and len(good.id) == 36


def test_gray_images_and_alpha(spark, tmp_path):
    """All become three channels, and none is lost to scan and recognize."""

    def other(pixels, colour, depth=8):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + row.tobytes() for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 60, 40, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    colour, gray = picture(), picture()[:, :, 0]
    alpha = np.dstack([colour, gray])
    for name, data in {"colour": png(colour), "gray": other(gray, 0), "alpha": other(alpha, 6), "both": other(np.dstack([gray, gray.T.reshape(40, 60)]), 4), "deep": other(gray.astype(">u2") * 256, 0, 16)}.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    found = {r.id: r for r in images.read_images(spark, str(tmp_path)).collect()}
    ids = {r.path.rsplit("/", 1)[1][:-4]: r.id for r in images.read_uploads(spark, str(tmp_path)).collect()}
    assert len(found) == 5 and found[ids["deep"]].error_kind == "decode" and found[ids["deep"]].data is None
    for name, expected in {"colour": colour, "alpha": colour, "gray": np.dstack([gray] * 3), "both": np.dstack([gray] * 3)}.items():
        row = found[ids[name]]
        assert row.error_kind is None and (np.frombuffer(row.data, np.uint8).reshape(40, 60, 3)[:, :, ::-1] == expected).all(), name
    decoded = images.read_images(spark, str(tmp_path))
    assert documents.scan(decoded, lambda _: np.zeros((4, 256, 256), np.float32)).count() == 4
    lines = documents.recognize(decoded, lambda image: [("A", 0.9, np.zeros((4, 2)))] if image.shape == (40, 60, 3) else [])
    assert lines.count() == 4


def test_first_upload(spark):
    parts = [(1, 0, "a", b"x"), (1, 1, "image", b"y"), (1, 2, "b", b"z"), (2, 0, "a", b"x"), (2, 1, "b", b"q"), (3, 0, "a", b"")]
    frame = images.first_upload(spark.createDataFrame(parts, "request_id int, part_no int, name string, content binary"))
    found = {r.request_id: (r.content and bytes(r.content), r.error_kind) for r in frame.collect()}
    assert found == {1: (b"y", None), 2: (b"x", None), 3: (b"", "empty_image")}


def test_the_last_crop_wins_and_missing_ids_are_told(spark):
    crops = images.latest_crops(spark.createDataFrame([("a", 1, b"1"), ("a", 2, b"2"), ("b", 1, b"3")], "id string, crop_no int, pixels binary"))
    assert {r.id: bytes(r.pixels) for r in crops.collect()} == {"a": b"2", "b": b"3"}
    asked = images.look_up(spark.createDataFrame([("a",), ("x",)], "id string"), crops)
    assert {r.id: r.error_kind for r in asked.collect()} == {"a": None, "x": "not_found"}


def test_scan_crop_and_recognize(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(picture()))
    decoded = images.read_images(spark, str(tmp_path))

    def four_corners(_):
        out = np.zeros((4, 256, 256), np.float32)
        for k, (x, y) in enumerate([(40, 40), (210, 40), (210, 200), (40, 200)]):
            out[k, y - 5 : y + 6, x - 5 : x + 6] = 0.9
        return out

    row = documents.scan(decoded, four_corners).first()
    assert row.corners_detected and row.orig_width == 60 and len(row.pixels) == row.width * row.height * 3
    none = documents.scan(decoded, lambda _: np.zeros((4, 256, 256), np.float32)).first()
    assert not none.corners_detected and [(p.x, p.y) for p in none.corners] == [(0, 0), (59, 0), (59, 39), (0, 39)]

    id_ = decoded.first().id
    square = [(5.0, 5.0), (45.0, 5.0), (45.0, 35.0), (5.0, 35.0)]
    asked = spark.createDataFrame([(id_, square), ("none", square), (id_, [(5.0, 5.0), (99.0, 5.0), (45.0, 35.0), (5.0, 35.0)])], f"id string, corners {documents.POINTS}")
    crops, failures = documents.crop(asked, decoded)
    assert [(r.width, r.height) for r in crops.collect()] == [(40, 30)]
    assert sorted(r.error_kind for r in failures.collect()) == ["invalid_crop", "not_found"]

    lines = documents.recognize(decoded, lambda image: [("NAME", 0.9, np.array([[1, 2], [30, 2], [30, 9], [1, 9]]))] if image.shape == (40, 60, 3) else [])
    assert [(r.text, r.polygon[2]) for r in lines.collect()] == [("NAME", [30, 9])]


def test_line_reader():
    def detector(planes):
        out = np.zeros(planes.shape[1:], np.float32)
        out[20:40, 10:50] = 0.9
        return out

    logits = np.array([[0, 5, 0], [0, 5, 0], [6, 0, 0], [0, 0, 7]], np.float32)
    reader = documents.LineReader(detector, lambda line: (0.2, 0.8), lambda planes: logits, ["", "a", "b"])
    ((text, confidence, quad),) = reader(picture(64, 64))
    assert (text, confidence) == ("ab", 6.0) and quad.shape == (4, 2)


def test_sidecar(spark):
    good = {"errorCode": 0, "result": {"ocrResults": [{"prunedResult": {"rec_texts": [" a ", "b", " "], "rec_scores": [0.9, 0.44, 0.9], "rec_polys": [[[0, 0], [1, 0], [1, 1], [0, 1]]] * 3}}]}}
    uneven = {"errorCode": 0, "result": {"ocrResults": [{"prunedResult": {"rec_texts": ["a"], "rec_scores": [], "rec_polys": []}}]}}
    bodies = [(1, json.dumps(good), 200), (2, json.dumps(uneven), 200), (3, '{"errorCode": 7}', 200), (4, '{"errorCode": 0}', 200), (5, json.dumps(good), 500), (6, "{", 200), (7, None, 200)]
    parsed = sidecar.parse_responses(spark.createDataFrame(bodies, "doc_id long, body string, status int"), status="status")
    assert {r.doc_id: r.error_kind for r in parsed.collect()} == {1: None, 2: "protocol", 3: "rejected", 4: "protocol", 5: "rejected", 6: "protocol", 7: "protocol"}
    assert [(r.doc_id, r.text) for r in sidecar.flatten_lines(parsed).collect()] == [(1, "a")]
    body = spark.createDataFrame([(bytes(300),)], "c binary").select(sidecar.request_body(F.col("c")).alias("b")).first().b
    assert len(json.loads(body)["file"]) == 400


def test_errors(spark):
    frame = spark.createDataFrame([("not_found", None), ("invalid_crop", "crop is too small"), ("io", "secret path"), (None, None)], "k string, d string")
    found = [tuple(r.r) for r in frame.select(errors.error_response(F.col("k"), F.col("d")).alias("r")).collect()]
    assert found == [(404, "scan id not found"), (400, "crop is too small"), (500, "internal server error"), (200, None)]


def test_settings():
    assert config.number({"A": " 0.5 "}, "A", 1.0) == 0.5 and config.number({}, "A", 1.0) == 1.0
    assert config.number({"A": "x"}, "A", 1.0, strict=False) == 1.0
    with pytest.raises(ValueError, match="A"):
        config.number({"A": "x"}, "A", 1)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from quillframe.operators import layout

    lines = [(d, 0, "NAME", 0.99, [[10, 10], [110, 10], [110, 30], [10, 30]]) for d in range(5)] + [(d, 1, f"Asha {d}", 0.98, [[12, 40], [112, 40], [112, 60], [12, 60]]) for d in range(5)]
    frame = spark.createDataFrame(lines, "doc_id long, det_no int, text string, confidence float, polygon array<array<int>>").coalesce(1)
    frame.write.parquet(str(tmp_path / "in"))

    def operator(batch):
        return layout.explode_fields(layout.pages(batch).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields")))

    query = stream.process_available(stream.stream_lines(spark, str(tmp_path / "in")), operator, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/*")).collect())) == sorted(map(tuple, operator(frame).collect()))

    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.png").write_bytes(png(picture()))
    uploads = stream.process_available(stream.stream_uploads(spark, str(tmp_path / "files")), lambda b: b.select(images.scan_id(F.col("path")).alias("id"), "length"), str(tmp_path / "ids"), str(tmp_path / "check2"))
    uploads.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ids/*")).count() == 1
