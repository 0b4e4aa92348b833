"""Image kernels in numpy, for what column expressions cannot do. Each works on one image; Spark deals images to tasks."""

from __future__ import annotations

import numpy as np

# Channel means and deviations (red, green, blue) of the detector's input; thresholds.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
TEXT, SCAN_SIDE, BLOB = 0.3, 256, 0.3


def imagenet_planes(rgb: np.ndarray) -> np.ndarray:
    """(H, W, 3) bytes to (3, H, W): scaled to 0-1, less the mean, over the deviation."""
    scaled = rgb.astype(np.float32) / np.float32(255)
    return ((scaled - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1)


def line_planes(image: np.ndarray) -> np.ndarray:
    """(H, W, 3) bytes to (3, H, W) from -1 to 1."""
    return ((image.astype(np.float32) - np.float32(127.5)) / np.float32(127.5)).transpose(2, 0, 1)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 projective map that takes four points to four points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(np.asarray(source, float), np.asarray(target, float)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.r_[np.linalg.solve(np.array(rows), np.array(values)), 1].reshape(3, 3)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples with zeros beyond the border."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0

    def at(i, j):
        inside = (i >= 0) & (i < w) & (j >= 0) & (j < h)
        values = image[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)].astype(float)
        return values * (inside if image.ndim == 2 else inside[..., None])

    mix = lambda a, b, f: a + (b - a) * (f if image.ndim == 2 else f[..., None])
    return mix(mix(at(x0, y0), at(x0 + 1, y0), fx), mix(at(x0, y0 + 1), at(x0 + 1, y0 + 1), fx), fy)


def crop_size(quad: np.ndarray) -> tuple[int, int]:
    tl, tr, br, bl = np.asarray(quad, np.float32).astype(float)
    longer = lambda a, b, c, d: max(1, int(np.floor(max(np.hypot(*(a - b)), np.hypot(*(c - d))) + 0.5)))
    return longer(br, bl, tr, tl), longer(tr, br, tl, bl)


def warp(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quad of an image, straightened; bytes are rounded."""
    width, height = crop_size(quad)
    back = homography([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], quad) if min(width, height) > 1 else None
    if back is None:  # a row or column of pixels has no projective map: sample along the edges
        tl, tr, br, bl = np.asarray(quad, float)
        u, v = np.meshgrid(np.linspace(0, 1, width), np.linspace(0, 1, height))
        points = (tl * ((1 - u) * (1 - v))[..., None]) + (tr * (u * (1 - v))[..., None]) + (br * (u * v)[..., None]) + (bl * ((1 - u) * v)[..., None])
        return np.rint(bilinear(image, points[..., 0], points[..., 1])).clip(0, 255).astype(np.uint8)
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    mapped = back @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = (mapped[:2] / mapped[2]).reshape(2, height, width)
    return np.rint(bilinear(image, x, y)).clip(0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres matched and the border repeated."""
    h, w = image.shape[:2]
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    out = bilinear(image, *np.meshgrid(x, y))
    return np.rint(out).clip(0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)


def shrink(image: np.ndarray, longest: int = 2200) -> np.ndarray:
    """An image whose longest side has no more pixels than given, as uploads are made smaller before they are sent."""
    h, w = image.shape[:2]
    scale = min(1.0, longest / max(h, w))
    return image if scale == 1 else resize(image, max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5))))


def rotate_180(image: np.ndarray) -> np.ndarray:
    return image[::-1, ::-1]


def label_blobs(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Numbers of the 8-connected regions of a mask from 1, by spreading the least number until nothing changes; of the 4-connected ones without ``corners``."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        around = [padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3) if corners or 1 in (i, j)]
        stacked = np.stack(around)
        least = np.where(stacked > 0, stacked, mask.size + 1).min(axis=0)
        new = np.where(mask, np.minimum(labels, least), 0)
        # A label is a cell: jumping to that cell's own label halves the remaining distance.
        flat = np.r_[0, new.ravel()]
        new = np.where(mask, np.minimum(new, flat[new]), 0)
        if (new == labels).all():
            return np.unique(np.r_[0, new.ravel()], return_inverse=True)[1][1:].reshape(mask.shape)  # 0 is the rest, even of a mask without any
        labels = new


def largest_blob(heatmap: np.ndarray, width: int | None = None, height: int | None = None, threshold: float = BLOB) -> tuple[float, float] | None:
    """Centroid of the largest region over the threshold, after enlarging to the size of the image if one is given; None without any."""
    if width and height:
        heatmap = resize(heatmap.astype(np.float32), width, height)
    labels = label_blobs(heatmap > np.float32(threshold))
    sizes = np.bincount(labels.ravel())[1:]
    if not len(sizes):
        return None
    y, x = np.nonzero(labels == sizes.argmax() + 1)
    return float(x.mean()), float(y.mean())


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of each region of a mask, and of the border of each hole: those cells of the region around it that touch it.

    A hole is a 4-connected part of the rest that does not reach the frame. Regions within a hole are no part of its border.
    """
    labels = np.pad(label_blobs(mask), 1)
    rest = label_blobs(labels == 0, corners=False)
    out = []
    for numbers, first in ((labels, 1), (rest, 2)):  # the rest's number 1 is what reaches the frame
        cells = np.argsort(numbers, axis=None, kind="stable")
        ends = np.cumsum(np.bincount(numbers.ravel()))
        for k in range(first, len(ends)):
            y, x = np.unravel_index(cells[ends[k - 1] : ends[k]], numbers.shape)
            if numbers is rest:
                around = labels[y[0] - 1, x[0]]  # what is above the topmost cell surrounds the hole
                y, x = (np.concatenate([v + d for d in steps]) for v, steps in ((y, (-1, 1, 0, 0)), (x, (0, 0, -1, 1))))
                touching = labels[y, x] == around
                y, x = np.unique(np.stack([y[touching], x[touching]]), axis=1)
            out.append(np.stack([x, y], axis=1) - 1)
    return out


def min_area_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(centre x, centre y, width, height, angle in radians) of the smallest rectangle around points: one side lies on the hull."""
    p = np.unique(points.astype(float), axis=0)
    if len(p) == 1:
        return (*p[0], 0.0, 0.0, 0.0)

    def chain(order):
        out: list = []
        for q in order:
            while len(out) > 1 and np.cross(np.r_[out[-1] - out[-2], 0], np.r_[q - out[-1], 0])[2] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(p) + chain(p[::-1]))
    edges = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2)):
        c, s = np.cos(angle), np.sin(angle)
        turned = hull @ np.array([[c, -s], [s, c]])
        low, high = turned.min(axis=0), turned.max(axis=0)
        size = high - low
        if best is None or size.prod() < best[0]:
            centre = np.array([[c, -s], [s, c]]) @ ((low + high) / 2)
            best = (size.prod(), *centre, *size, angle)
    return tuple(map(float, best[1:]))


def box_points(box: tuple[float, float, float, float, float]) -> np.ndarray:
    x, y, w, h, angle = box
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[x, y]]) + np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2 @ np.array([[c, s], [-s, c]])


def masked_mean(grid: np.ndarray, quad: np.ndarray) -> float:
    """Mean of the cells inside a convex quad, its border included, within the grid; 0 without any."""
    low, high = np.floor(quad.min(axis=0)).astype(int), np.ceil(quad.max(axis=0)).astype(int)
    x0, y0 = np.maximum(low, 0)
    x1, y1 = np.minimum(high + 1, grid.shape[::-1])
    if x1 <= x0 or y1 <= y0:
        return 0.0
    x, y = np.meshgrid(np.arange(x0, x1), np.arange(y0, y1))
    corners = np.rint(quad)
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(corners, np.roll(corners, -1, axis=0))]
    inside = np.all(np.stack(sides) >= 0, axis=0) | np.all(np.stack(sides) <= 0, axis=0)
    return float(grid[y0:y1, x0:x1][inside].mean()) if inside.any() else 0.0


def text_boxes(probability: np.ndarray, width: int, height: int, threshold: float = TEXT, score: float = 0.6, ratio: float = 1.5, side: float = 3.0) -> list[np.ndarray]:
    """Quads of text lines in pixels of an image of the given size, by top then left.

    Regions over the threshold and their holes, the smallest rectangles of their outlines, filtered by side and by mean
    probability, grown and scaled.
    """
    scale = np.array([probability.shape[1] / width, probability.shape[0] / height])
    out = []
    for points in outlines(probability > np.float32(threshold)):
        if len(points) < 3:
            continue
        box = min_area_box(points)
        if min(box[2:4]) < side or masked_mean(probability, box_points(box)) < score:
            continue
        w, h = box[2:4]
        by = w * h * ratio / (2 * (w + h))
        box = (*box[:2], w + 2 * by, h + 2 * by, box[4])
        if min(box[2:4]) < side:
            continue
        p = box_points(box)
        total, across = p.sum(axis=1), p[:, 0] - p[:, 1]
        last = lambda v: len(v) - 1 - int(np.argmax(v[::-1]))
        quad = p[[int(np.argmin(total)), last(across), last(total), int(np.argmin(across))]]
        out.append(np.clip(quad / scale, 0, [width - 1, height - 1]).astype(np.float32))
    return sorted(out, key=lambda q: (q[:, 1].min(), q[:, 0].min()))
