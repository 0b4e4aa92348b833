"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillframe.llm import substrings
from quillframe.llm.common import word_spans
from quillframe.llm.components import connected_components
from quillframe.llm.exact_dedup import drop_copies, exact_groups, heavy_hitters
from quillframe.llm.fm_index import FMIndex, WaveletMatrix
from quillframe.llm.near_dedup import choose_bands, drop_near_copies, near_duplicates
from quillframe.llm.substrings import remove_repeats, runs_of
from tests.llm.helpers import DOCS, corpus, documents, plain

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((i, t or ""))
    out = []
    for text, members in groups.items():
        best = max(members, key=lambda m: (len(m[1]), -m[0] if m[0] is not None else -(2**70)))
        out += [(i, best[0], len(members), hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 8192])
def test_exact_groups(spark, counters):
    rows = corpus()
    found = exact_groups(documents(spark, rows), counters=counters)
    assert plain(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact(rows)
    kept = Counter(r.text_sha256 for r in found.collect() if r.kept)
    assert set(kept) == {x[3] for x in exact(rows)} and set(kept.values()) == {1}


def test_heavy_hitters_are_found_and_bounded(spark):
    rows = [(bytes([1]),)] * 400 + [(bytes([2]),)] * 300 + [(i.to_bytes(4, "big"),) for i in range(1000)]
    found = {bytes(r.digest) for r in heavy_hitters(spark.createDataFrame(rows, "digest binary").repartition(3), counters=16).collect()}
    assert {bytes([1]), bytes([2])} <= found and len(found) <= 16


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    rows = corpus()
    left = drop_copies(documents(spark, rows))
    assert left.dtypes == documents(spark, []).dtypes
    texts = [SPACE.sub("", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t or "") for _, t in rows})


def shingles(text, size=5):
    words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(rows, num, den=100):
    """(id, shingles, component, kept) with rows of one id joined; of a component without an id, one row is kept."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] and sets[j] and (den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) or (rows[i][0] is not None and rows[i][0] == rows[j][0]))
            if same:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    kept = {find(i): i for i in reversed(range(len(rows)))}
    return sorted(((d, len(sets[i]), least[find(i)], kept[find(i)] == i if least[find(i)] is None else d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("num", [85, 80, 50])
def test_near_duplicates(spark, num):
    rows = corpus()
    assert plain(near_duplicates(documents(spark, rows), num)) == near(rows, num)


def test_many_near_copies_take_several_cells(spark):
    import random

    rng = random.Random(2)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = base[:]
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    assert plain(near_duplicates(documents(spark, rows), 85)) == near(rows, 85)
    assert {r.doc_id for r in drop_near_copies(documents(spark, rows), 85).collect()} == {d for d, _, c, k in near(rows, 85) if k}


def test_rows_without_ids_and_hashes_that_a_polynomial_confuses(spark):
    import random

    rng = random.Random(4)
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    copies = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in (3, 50, 90)]
    rows = [(None, t) for t in copies] + [(None, copies[0]), (None, "alone without an id, but long enough for shingles"), (None, None), (None, "")]
    # Words of the Thue-Morse sequence and its complement have equal polynomials modulo 2**64, whatever the multiplier.
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    rows += [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, " ".join("ab"[b] for b in bits)), (4, " ".join("ba"[b] for b in bits[:3000]))]
    rows += [(5, "one two three four"), (6, "four three two one"), (7, "one two three four "), (8, "a a a a a a"), (9, "a a a a a a a a")]
    docs = documents(spark, rows)
    assert plain(near_duplicates(docs, 85)) == near(rows, 85)
    stay = Counter(r.text for r in drop_near_copies(docs, 85).collect() if r.doc_id is None)
    assert sum(n for t, n in stay.items() if t in copies) == 1 and stay[None] == stay[""] == stay[rows[4][1]] == 1
    assert {r.doc_id for r in drop_near_copies(docs, 85).collect()} == {d for d, _, _, k in near(rows, 85) if k}
    named = [(17 if i == 1 else d, t) for i, (d, t) in enumerate(rows)]
    assert plain(near_duplicates(documents(spark, named), 85)) == near(named, 85)
    assert [r.doc_id for r in drop_near_copies(documents(spark, named), 85).collect() if r.text in copies] == [17]


def test_work_on_a_large_cluster_follows_its_documents(spark, monkeypatch):
    """5,000 near copies of one text: texts are sent to comparisons a few times each, not once for every cell of pairs."""
    import random

    from quillframe.llm import near_dedup

    rng = random.Random(6)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(5000):
        copy = base[:]
        copy[rng.randrange(len(copy))] = f"u{i}"
        rows.append((i, " ".join(copy)))
    sent, was = [], near_dedup.durable

    def counted(df, name="step", **more):
        out = was(df, name, **more)
        if name == "pairs":
            sent.append(out.count())
        if name == "grid":
            sent.append(out.selectExpr("coalesce(sum(ni * nj), 0) * 1024").first()[0])
        return out

    monkeypatch.setattr(near_dedup, "durable", counted)
    found = near_duplicates(documents(spark, rows), 85).collect()
    assert {r.component_id for r in found} == {0} and sum(sent) < 6 * 5000


def test_chains_take_every_way_of_comparing(spark):
    """Neighbours of a chain are linked, its ends are not: stars settle a part, and cells the rest."""
    import random

    rng = random.Random(12)
    base, rows = [f"v{rng.randrange(5000)}" for _ in range(400)], []
    for i in range(160):
        rows.append((i, " ".join(base)))
        for _ in range(rng.choice((2, 5, 9))):
            base[rng.randrange(400)] = f"u{rng.randrange(99999)}"
    rng.shuffle(rows)
    assert plain(near_duplicates(documents(spark, rows), 80)) == near(rows, 80)


def test_bands_seldom_miss():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        bands, rows = choose_bands(threshold)
        assert (1 - threshold**rows) ** bands <= 2e-6 and bands * rows <= 480


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201), (201, 200), (7, 7)]
    found = dict(plain(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    import random

    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(plain(connected_components(spark.createDataFrame(edges, "a long, b long")))) == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def repeats(rows, width):
    words = [SPACE.split(t.strip(" \t\n\r\x0b\x0c")) if (t or "").strip(" \t\n\r\x0b\x0c") else [] for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "crowd"), [(35, 512), (35, 2), (12, 3)])
def test_repeats(spark, width, crowd):
    rows = corpus()
    assert plain(remove_repeats(documents(spark, rows), width, crowd=crowd)) == repeats(rows, width)


def test_repeated_rows_take_linear_time(spark):
    """10,000 equal rows without an id, and a crowd of texts around one passage: one search of each different text."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(45)]
    rows = [(None, " ".join(passage + words[:40]))] * 10_000 + [(i, " ".join([*rng.sample(words, 40), *passage, *rng.sample(words, 40)])) for i in range(300)]
    assert plain(remove_repeats(documents(spark, rows), crowd=16)) == repeats(rows, 35)


def test_weights_count_as_occurrences():
    index = FMIndex([np.array([1, 2, 3, 4], np.uint64), np.array([9, 2, 3], np.uint64)], np.array([1, 2]))
    assert index.repeated_windows(np.arange(2), np.array([3, 2]), 2).tolist() == [0b010, 0b11]


def test_repeats_of_other_widths_are_refused(spark):
    with pytest.raises(ValueError, match="width"):
        remove_repeats(documents(spark, []), 8)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 4, n).astype(np.uint64) for n in (30, 7, 50, 1, 12)]
    index = FMIndex(texts)
    for width in (3, 5, 7):
        which = np.array([i for i, t in enumerate(texts) if len(t) >= width])
        windows = np.array([len(texts[i]) - width + 1 for i in which])
        seen = Counter(tuple(t[k : k + width]) for t in texts for k in range(len(t) - width + 1))
        want = [sum(1 << k for k in range(n) if seen[tuple(texts[i][k : k + width])] > 1) for i, n in zip(which, windows)]
        assert index.repeated_windows(which, windows, width).tolist() == want


def test_scan_hashes_runs_and_not_words(monkeypatch):
    """Only runs are hashed one by one; minimisers cost the same however many words they have."""
    rng = np.random.default_rng(5)
    joined, starts, ends = word_spans(b" ".join(b"w%d" % x for x in rng.integers(0, 10**6, 5000)))
    calls, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda *x: calls.append(x) or digest(*x))
    key, first, count, _ = runs_of(joined, starts, ends, 35)
    assert count.sum() == 5000 - 34 and len(calls) == len(key) == len(first) < 1000


def test_stretches_of_equal_bytes_hash_alike():
    """Wherever they stand: at the start, across the stretches that are summed at once, at the end."""
    rng = np.random.default_rng(6)
    word = lambda: bytes(rng.integers(97, 123, rng.integers(1, 12)).astype(np.uint8))
    passage = [word() for _ in range(3000)] + [b"x" * 3 * substrings.STRETCH] + [word() for _ in range(50)]
    found = []
    for before in (0, 1, 700, 5000):
        joined, starts, ends = word_spans(b" ".join([*(word() for _ in range(before)), *passage]))
        found.append(substrings.stretch_hashes(joined, starts[:-7], ends[7:])[before:])
        assert len(found[0]) == len(passage) - 7 and len(np.unique(found[0])) == len(found[0]) and (found[-1] == found[0]).all()
    assert len(joined) > 4 * substrings.STRETCH


def test_index_levels_tell_four_bits_apart():
    symbols = np.random.default_rng(7).integers(0, 5000, 3000)
    matrix = WaveletMatrix(symbols, 13)
    asked, at = symbols[::7], np.arange(0, 3000, 7) * 13 % 3001
    assert len(matrix.levels) == 4
    assert matrix.rank(asked, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(asked, at)]


@pytest.mark.parametrize("operator", [exact_groups, near_duplicates, remove_repeats, drop_copies, drop_near_copies])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0
    assert operator(documents(spark, [(1, None)])).count() == 1
