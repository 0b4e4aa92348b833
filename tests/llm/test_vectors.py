"""Hard negatives and whitening against brute force."""

import math
import random

import numpy as np
import pytest

from quillframe.llm import negatives, whitening
from quillframe.llm.negatives import Wanted, hard_negatives, window
from quillframe.llm.whitening import whiten
from tests.llm.helpers import plain

SHAPE = "vec_id long, embedding array<float>, label int, dim int, home int, n long, rank int, block string, white double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, 1, 2, 3, 4, "b", 0.5) for i, x, label in rows], SHAPE)


def odd_rows():
    return [(None, [0.5] * 8, 1), (2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] * 8, 2), (2004, [0.1] * 8, None), (2005, [], 3), (2050, [], 3), (2006, [1.0, 2.0], 1), (2100, [3.0, 4.0], 1), (2007, [2.0, 2.0], 2)]


def clustered(seed, n=700, dim=8):
    """Clusters of several sizes, copies of one vector, equal scores, repeated rows, and anchors that repeat."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)] if i % 3 else [0.25] * dim, rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    return rows + [rows[100], rows[101], rows[101], (100, [0.3] * dim, 1)] + odd_rows()


def brute(rows, positives=5, negatives_=3, every=50):
    valid = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        valid.append((i, label, tuple(math.floor(256 * float(v)) for v in np.float32(x))))
    out = []
    for a, label, x in {v for v in valid if v[0] % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, other, y in valid if i != a and len(y) == len(x))
        for minus, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [(-s, i) for s, i, same in scored if not same and 50 * -minus <= 100 * -s <= 95 * -minus][:negatives_]
            out += [(a, p, r, i, -minus, s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(4096, 256), (16, 3)])
def test_hard_negatives(spark, sizes):
    rows = clustered(3)
    found = hard_negatives(vectors(spark, rows).repartition(3), candidates=sizes[0], anchors=sizes[1])
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert plain(found) == brute(rows) and found.count() > 20


def test_few_rows(spark):
    assert hard_negatives(vectors(spark, [])).count() == 0
    assert hard_negatives(vectors(spark, [(50, [1.0], 1)])).count() == 0
    assert hard_negatives(vectors(spark, [(50, [1.0], 1), (51, [1.0], 2)])).count() == 0
    assert plain(hard_negatives(vectors(spark, [(50, [1.0], 1), (51, [2.0], 1), (52, [1.0], 2)]))) == [(50, 51, 1, 52, 131072, 65536)]


def test_windows_of_scores():
    scores = np.array([0, 1, -1, 99, 100, 2**62, -(2**62), 12345], np.int64)
    low, high = window(scores, 50, 95)
    assert [(int(a), int(b)) for a, b in zip(low, high)] == [(-((-50 * int(s)) // 100), 95 * int(s) // 100) for s in scores]


def test_brackets_skip_blocks_without_losing_any(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 200
    points = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(300, 16)) * 4).astype(np.int64)
    square = float((points**2).sum(axis=1).max())
    pivots = negatives.choose_pivots(points[::7].tolist(), square, 8)[16]
    anchors = points[::25]
    seek = {"dim": 16, "n": len(anchors), "ids": np.arange(len(anchors)) - 100, "labels": np.zeros(len(anchors), np.int32), "vectors": anchors, "most": 1e3, "far": negatives.distances(np.c_[anchors, np.zeros(len(anchors))], pivots)}
    wanted = Wanted(seek, np.full((len(anchors), 1), -(2**63)), np.full((len(anchors), 1), 2**63 - 1), 5, True, square)
    scored = []
    plain_scores = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda q, c, most: scored.append(len(q) * len(c)) or plain_scores(q, c, most))
    for part in range(6):
        mine = points[part * 50 : part * 50 + 50]
        away = negatives.distances(negatives._lift(mine.astype(float), square), pivots)
        home = int(away.min(axis=0).argmin())
        order = np.argsort(away[:, home])
        wanted.meet({"dim": 16, "n": 50, "ids": part * 50 + order, "labels": np.zeros(50, np.int32), "vectors": mine[order], "most": 1e3, "home": home, "far": away[order, home], "low": away.min(axis=0), "high": away.max(axis=0)})
    best = {q: sorted((-int(a @ p), i) for i, p in enumerate(points))[:5] for q, a in enumerate(anchors)}
    q, _, ids, scores = wanted.rows()
    assert {k: sorted((-int(s), int(i)) for x, i, s in zip(q, ids, scores) if x == k) for k in best} == best
    assert sum(scored) < 0.7 * len(anchors) * len(points)


def whitened(rows, components=8):
    """By length of vectors: ids, exact deviations, explained shares and whitened rows."""
    lists = {}
    for i, x, _ in rows:
        if x and all(v is not None and math.isfinite(v) for v in x):
            lists.setdefault(len(x), []).append((i, [math.floor(1024 * float(v)) + 100_000 for v in np.float32(x)]))
    out = {}
    for dim, held in lists.items():
        n, sums = len(held), [sum(c) for c in zip(*(x for _, x in held))]
        far = [[n * v - s for v, s in zip(x, sums)] for _, x in held]
        centred = np.array(far, float) / n
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        out[dim] = [i for i, _ in held], [sum(v * v for v in r) for r in far], values / max(1e-300, (centred**2).sum() / n), centred @ axes / np.sqrt(np.maximum(values, 1e-300))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "STACK_BYTES", 1)  # a binary tree of triangles
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + 3 * d) for d in range(10)], 1) for i in range(120)]
    rows += [rows[3], rows[3], (None, [0.5] * 10, 1), (200, None, 1), (201, [None] * 10, 1), (202, [float("nan")] * 10, 1), (203, [1.0] * 9 + [float("inf")], 1)] + [(i, [rng.random(), rng.random()], 2) for i in range(300, 320)]
    found = whiten(vectors(spark, rows).repartition(parts)).collect()
    assert len(found) == 8 * 123 + 2 * 20
    for dim, (ids, deviations, explained, white) in whitened(rows).items():
        kept = min(8, dim)
        mine = [r for r in found if (r.vec_id is not None and r.vec_id >= 300) == (dim == 2)]
        assert {r.n for r in mine} == {len(ids)}
        assert sorted(r.deviation for r in mine) == sorted(d for d in deviations for _ in range(kept))
        assert all(r.deviation == r.deviation_exact for r in mine)
        assert len({r.identity_error for r in mine}) == 1 and mine[0].identity_error < 1e-9
        for k in range(kept):
            got = sorted(((-1 if r.vec_id is None else r.vec_id), r.whitened) for r in mine if r.component == k + 1)
            want = sorted(((-1 if i is None else i), w) for i, w in zip(ids, white[:, k]))
            sign = np.sign(sum(a[1] * b[1] for a, b in zip(got, want)))
            assert [g[0] for g in got] == [w[0] for w in want]
            assert max(abs(sign * g[1] - w[1]) for g, w in zip(got, want)) < 1e-7
            assert {round(r.explained / explained[k], 9) for r in mine if r.component == k + 1} == {1.0}


def test_whitening_without_variance(spark):
    assert whiten(vectors(spark, [])).count() == 0
    lone = whiten(vectors(spark, [(1, [0.5, 0.25], 1)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0], 1) for i in range(20)])).collect()  # one direction only
    assert {(r.component, r.whitened is None, round(r.explained, 12)) for r in flat} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert flat[0].identity_error < 1e-9


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [x, -x], 1) for i, x in enumerate([1e11, -1e11, 3e10])]
    found = {r.vec_id: r for r in whiten(vectors(spark, rows)).collect() if r.component == 1}
    (ids, deviations, _, _) = whitened(rows)[2]
    assert {i: int(r.deviation_exact) for i, r in found.items()} == dict(zip(ids, deviations)) and all(r.deviation is None for r in found.values())


def test_small_eigenvalues_keep_their_digits(spark):
    """Directions a millionth as wide as the first: a covariance matrix would hold them in its rounding alone."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in np.float32([a * 1e6, a * 1e6 + b])], 1) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    found = whiten(vectors(spark, rows)).collect()
    assert found[0].identity_error < 1e-6
