"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded on its own, by hashed profiles of its words, word pairs and byte
pairs and by shares of its bytes, words and lines; a learned layer turns these into a representation; gated attention,
learned from labels of whole documents alone, weights the passages; and a logistic unit scores the weighted
representation. Training takes all passages of a bounded sample of labelled rows on the driver; scoring is map-only over
every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillframe.llm.common import distinct, durable, mix64, small_batches, utf8, word_hashes

#: Bytes of a passage; buckets of the profiles of byte pairs, words and word pairs; sizes of the learned layers.
PASSAGE, BUCKETS, WORDS, PAIRS, HIDDEN, ATTENTION = 600, 64, 128, 128, 24, 12
#: Items that every profile is taken to have besides its own.
PRIOR = 20
#: Most labelled rows that the classifier is fitted on, and most bytes of their features (1,360 for each 600 characters).
SAMPLE, SAMPLE_BYTES = 6000, 256 << 20
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"\n", b" \t\r", b"'\"()-", b"*#$%&|@^~=+<>{}[]\\/_`"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 11
N_CLASSES = 12
#: Class shares, and shares of words and lines; then the profiles.
DENSE = N_CLASSES + 8
FEATURES = DENSE + BUCKETS + WORDS + PAIRS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = (mix64(np.arange(65536, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _profile(which: np.ndarray, buckets: np.ndarray, n: int, size: int, total: np.ndarray) -> np.ndarray:
    """Square roots of the shares of ``size`` buckets in each of ``n`` passages; ``which`` names the passage of each item.
    Shares of a few items are taken for less, as they say less."""
    return np.sqrt(np.bincount(which * size + buckets, minlength=n * size).reshape(n, size) / (total[:, None] + PRIOR))


def _different(which: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each passage has."""
    pairs = distinct(mix64(hashes ^ mix64(which.astype(np.uint64))) >> np.uint64(20) | which.astype(np.uint64) << np.uint64(44))
    return np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=n)


def passages(text: str | None) -> np.ndarray:
    """Feature rows of all passages, each of itself alone; a text without words is one passage of zeros."""
    data = utf8(text)
    raw = np.frombuffer(data, np.uint8)
    if not data.strip():
        out = np.zeros((1, FEATURES), np.float32)
        out[0, 0] = 1
        return out
    kinds = _CLASSES[raw]
    white = (kinds == 7) | (kinds == 8)
    begins = np.flatnonzero(~white & np.r_[True, white[:-1]])
    ends = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    number = begins // PASSAGE  # of the passage that a word begins in
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    n = len(first)
    edges = np.r_[0, begins[first[1:]], len(raw)]
    upto = np.r_[first, len(begins)]
    hashes = word_hashes(data)
    out = np.zeros((n, FEATURES), np.float32)
    for at in range(0, n, 512):  # in parts, as the counts take several times their bytes
        to = min(n, at + 512)
        m, part, own = to - at, slice(edges[at], edges[to]), slice(upto[at], upto[to])
        which = np.repeat(np.arange(m), np.diff(edges[at : to + 1]))
        size = np.maximum(np.diff(edges[at : to + 1]), 1).astype(np.float32)
        rows = out[at:to]
        rows[:, :N_CLASSES] = np.bincount(which * N_CLASSES + kinds[part], minlength=m * N_CLASSES).reshape(m, N_CLASSES) / size[:, None]
        pair = raw[part].astype(np.int64)
        inside = which[1:] == which[:-1]
        rows[:, DENSE : DENSE + BUCKETS] = _profile(which[1:][inside], _PAIR[pair[:-1] << 8 | pair[1:]][inside], m, BUCKETS, size)
        count = np.diff(upto[at : to + 1])
        words, word_of, seen = count.astype(np.float32), np.repeat(np.arange(m), count), hashes[own]
        length = (ends[own] - begins[own]).astype(np.float32)
        mean = np.bincount(word_of, length, m) / words
        last, start = kinds[ends[own] - 1], kinds[begins[own]]
        after = word_of[1:] == word_of[:-1]
        pairs = (seen[:-1] * _ODD ^ seen[1:])[after]
        rows[:, DENSE + BUCKETS : DENSE + BUCKETS + WORDS] = _profile(word_of, (mix64(seen) % np.uint64(WORDS)).astype(np.int64), m, WORDS, words)
        rows[:, DENSE + BUCKETS + WORDS :] = _profile(word_of[1:][after], (mix64(pairs) % np.uint64(PAIRS)).astype(np.int64), m, PAIRS, words)
        # A line is known by the sum of its words' hashes; one that goes on in the next passage counts in both.
        line = np.cumsum(raw[part] == 10)[begins[own] - edges[at]]
        opens = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | ~after])
        line_of, line_hashes = word_of[opens], np.add.reduceat(mix64(seen), opens)
        lines = np.bincount(line_of, minlength=m)
        rows[:, N_CLASSES:DENSE] = np.stack([
            mean / 16,
            np.sqrt(np.maximum(0, np.bincount(word_of, length**2, m) / words - mean**2)) / 16,
            np.bincount(word_of, last == 10, m) / words,  # words that end in a symbol
            np.bincount(word_of, (length == 1) & (start == 10), m) / words,  # words that are one
            1 - _different(word_of, seen, m) / words,
            1 - _different(word_of[1:][after], pairs, m) / words,
            1 - _different(line_of, line_hashes, m) / lines,
            np.log1p(words) / 6,
        ], axis=1)
    return out


@dataclass
class Model:
    """Parameters of the encoder (w, c), the gated attention (v, u, a), the scorer (o, b), and the feature scale."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """``x``: passages of all bags, one after the other; ``bag``: the number of each passage's bag."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["c"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        top = np.full(bags, -np.inf, e.dtype)
        np.maximum.at(top, bag, e)
        w = np.exp(e - top[bag])
        w = w / np.bincount(bag, w, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, w[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -30, 30)))
        return {"h": h, "t": t, "g": g, "w": w, "z": z, "y": y}

    def scaled(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All passages, in 64-bit floats, and the number of each one's bag."""
        return (np.concatenate(bags) - self.mean) * self.scale, np.repeat(np.arange(len(bags)), [len(b) for b in bags])

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(*self.scaled(bags), len(bags))["y"] if bags else np.zeros(0)

    def loss(self, bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean weighted logistic loss, and its derivatives by all parameters."""
        p, n = self.p, len(bags)
        x, bag = self.scaled(bags)
        f = self.forward(x, bag, n)
        loss = -(weight * np.log(np.where(labels > 0, f["y"], 1 - f["y"]))).mean()
        dy = (f["y"] - labels) * weight / n
        dz = dy[:, None] * p["o"]
        dw = (dz[bag] * f["h"]).sum(axis=1)
        de = f["w"] * (dw - np.bincount(bag, f["w"] * dw, n)[bag])
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["w"][:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return loss, {"w": x.T @ dh, "c": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ dy, "b": dy.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = 2000, rate: float = 0.01, batch: int = 128, decay: float = 1e-3, seed: int = 3) -> Model:
    """Trains by so many steps of Adam on the logistic loss with classes weighted equally. One class alone, or no rows, gives its share as the score."""
    rng = np.random.default_rng(seed)
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if bags:
        rows = sum(map(len, bags))
        mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / rows
        scale = 1 / np.maximum(np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / rows), 0.02)
    shape = {"w": (FEATURES, HIDDEN), "c": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "b": ()}
    p = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k in "wvuao" else np.zeros(s) for k, s in shape.items()}
    model = Model(mean, scale, p)
    good = labels.mean() if len(labels) else 0.5
    if good in (0, 1) or not len(labels):
        p["o"] = np.zeros(HIDDEN)
        p["b"] = np.array(np.log((good + 1e-3) / (1 - good + 1e-3)))
        return model
    weight = np.where(labels > 0, 0.5 / good, 0.5 / (1 - good))
    m, s = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(bags))
        part, order = order[:batch], order[batch:]
        now = rate * (1 - step / steps) + 1e-4
        _, grads = model.loss([bags[i] for i in part], labels[part], weight[part])
        for k, g in grads.items():
            g = g + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def within(rows: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of rows (id, bytes), in order, that together stay within ``most`` bytes; a row of over a hundredth of that is passed over."""
    out, held = [], 0
    for i, size in rows:
        if size * 100 <= most and held + size <= most:
            out.append(i)
            held += size
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``sample`` labelled rows that are not held out, those with the least hashes of their ids.

    Null labels and ids are left out; of several labels of an id the greatest counts, and of several rows of an id the one
    with the least hash of its text. Labels whose document is missing do not count. Only features of the sample come to
    the driver, all passages of each of its rows, ``sample_bytes`` in all: rows that go beyond, or have over a hundredth of that (texts of
    about a megabyte), are not trained on. They are scored like others, by all their passages.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)  # the bound of what is broadcast next

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(text) for text in batch.column("text").to_pylist()]
            out = batch.select(["id", "label"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())], ["id", "label", "bag"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # One row of each id, however often it repeats; copies go within their tasks, so that only the sample's texts are shuffled.
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("id", "label", "one.text")
    # Written by all tasks at once; what comes to the driver, part by part, is read from the few files that hold the sample.
    encoded = durable(rows.mapInArrow(encode, "id long, label int, bag binary"), "sample")
    # The bytes of the sample are bounded too, by two facts of each of its rows.
    sizes = sorted((tuple(r) for r in encoded.select(F.xxhash64("id"), "id", F.length("bag")).collect()))
    fitting = within([(i, n) for _, i, n in sizes], sample_bytes)
    found = sorted((r["id"], r["label"], bytes(r["bag"])) for r in encoded.where(F.col("id").isin(fitting) if len(fitting) < len(sizes) else F.lit(True)).toLocalIterator())
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for _, _, b in found]
    return fit(bags, np.array([float(label > 0) for _, label, _ in found]))


def scorer(docs: DataFrame, model: Model):
    """A column function from a text to its score. The model is some 50 kB, whatever the corpus."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 256):
            out.append(shared.value.scores([passages(x) for x in texts.iloc[at : at + 256]]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out boolean, score double (0 to 1), predicted int (1 if score >= ``threshold``), a row per input row.

    Null and empty texts are scored as texts without words; a null id is not held out. Repeated rows get equal scores.
    Other columns are never read. Without labels all scores are 0.5.
    """
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.where(score(F.col(text_col).cast("string")) >= threshold)
