"""Pages of rows against pages of arrays, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import layout, wide
from quillframe.operators.connect import components
from tests.test_layout import SCHEMA

LABELS, VALUES = ["DATE", "OF BIRTH", "SEX", "NAME", "TYPE NO"], ["Asha", "x 1", "1990-01-01", "NAME: Ram", "SEX: ", "note"]


def scattered(seed, n, size, doc=1):
    """Lines of many heights and widths, some flat, some in the same place, some of one top."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(size), rng.randrange(size) // rng.choice([1, 1, 10]) * rng.choice([1, 1, 10])
        w, h = rng.choice([0, 5, 40, 40, 300]), rng.choice([0, 1, 8, 20, 20, 33, 150])
        if i % 9 == 0 and out:
            (x, y), _, (right, bottom), _ = out[rng.randrange(len(out))][4]
            w, h = right - x, bottom - y
        label = rng.random() < 0.5
        out.append((doc, i, rng.choice(LABELS if label else VALUES), rng.choice([0.5, 0.8, 0.95, 0.95]), [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]))
    return out


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def both(spark):
    made = [line for d in range(6) for line in scattered(d, 60, [200, 400, 800, 1500, 100, 3000][d], d)] + [(9, 0, "faint", 0.1, [[0, 0], [1, 0], [1, 1], [0, 1]])]
    frame = spark.createDataFrame(made, SCHEMA).repartition(3)
    return layout.pages(frame).cache(), wide.ordered_lines(frame)


def test_order(both):
    pages, lines = both
    flat = pages.select("doc_id", F.explode("lines").alias("x"))
    assert rows(lines, "doc_id", "line_no", "left", "top", "text") == rows(flat, "doc_id", F.col("x.line_no").cast("long"), "x.left", "x.top", "x.text")


def test_label_groups(both):
    pages, lines = both
    groups = pages.select("doc_id", F.explode(layout.label_groups(F.col("lines"))).alias("g"))
    first = F.array_min(F.transform("g", lambda x: x["line_no"])).cast("long")
    want = rows(groups.select("doc_id", F.explode("g").alias("x"), first.alias("first")), "doc_id", F.col("x.line_no").cast("long"), "first")
    assert rows(wide.label_groups(lines), "doc_id", "line_no", "group_no") == want and len({w[2] for w in want}) < len(want)


def test_nearest_below(both):
    pages, lines = both
    boxes = pages.select("doc_id", "lines", F.explode(layout.label_groups(F.col("lines"))).alias("g")).withColumn("box", layout.group_bounds(F.col("g")))
    found = boxes.withColumn("v", layout.nearest_below(F.col("lines"), F.col("box"))).where("v IS NOT NULL")
    want = rows(found, "doc_id", F.col("box.line_no").cast("long"), F.col("v.line_no").cast("long"), layout.vertical_gap(F.col("box"), F.col("v")).cast("long"))
    mine = wide.nearest_below(lines, wide.group_boxes(lines, wide.label_groups(lines)))
    assert rows(mine, "doc_id", "group_no", "anchor", F.col("gap").cast("long")) == want and want


def test_value_rows(both):
    pages, lines = both
    anchors = pages.select("doc_id", "lines", F.explode(F.filter("lines", lambda x: x["is_value"])).alias("a"))
    want = rows(anchors, "doc_id", F.col("a.line_no").cast("long"), layout.by_left(layout.value_row(F.col("lines"), F.col("a"))))
    assert rows(wide.value_rows(lines, lines.where("is_value").select("doc_id", F.col("line_no").alias("anchor"))), "doc_id", "anchor", "value") == want


def test_fields(both):
    pages, lines = both
    want = layout.explode_fields(pages.select("doc_id", layout.generic_fields(F.col("lines")).alias("fields")))
    assert rows(wide.generic_fields(lines), "doc_id", "field_no", "label", "value") == rows(want, "doc_id", "field_no", "label", "value")


def test_no_lines(spark):
    lines = wide.ordered_lines(spark.createDataFrame([], SCHEMA))
    assert wide.generic_fields(lines).count() == 0


def test_one_page_of_fifty_thousand_lines(spark, monkeypatch):
    """A table of labels with a value below each: every task has a part of the page, and pairs grow with the lines."""
    n, tasks, kept = 25_000, [], wide.kept
    grid = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("int").alias("i"), (F.col("id") % 50 * 400).cast("int").alias("x"), F.floor(F.col("id") / 50).cast("int").alias("r"))
    box = lambda y: F.array(*(F.array(a, b) for a, b in ((F.col("x"), y), (F.col("x") + 90, y), (F.col("x") + 90, y + 20), (F.col("x"), y + 20))))
    line = lambda no, text, y: grid.select("doc_id", no.alias("det_no"), text.alias("text"), F.lit(0.95).cast("float").alias("confidence"), box(y).alias("polygon"))
    frame = line(F.col("i") * 2, F.lit("NAME"), F.col("r") * 60).unionByName(line(F.col("i") * 2 + 1, F.concat(F.lit("v"), "i"), F.col("r") * 60 + 24))
    monkeypatch.setattr(wide, "kept", lambda df, name: tasks.append(df.groupBy(F.spark_partition_id()).count().collect()) or kept(df, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a page would be put together again
    try:
        lines = wide.ordered_lines(frame.repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lines.count() == 2 * n and all(max(r["count"] for r in task) < n for task in tasks if sum(r["count"] for r in task) == 2 * n)
    found = wide.generic_fields(lines)
    assert {r.value: r.field_no for r in found.where("label = 'NAME'").collect()} == {f"v{i}": i for i in range(n)}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_and_written_once(spark, monkeypatch):
    """Numbering deals lines by range; the rest of it moves sizes of groups and parts."""
    written, kept = [], wide.kept
    monkeypatch.setattr(wide, "kept", lambda df, name: written.append((name, df.columns, plan(df))) or kept(df, name))
    lines = wide.ordered_lines(spark.createDataFrame(scattered(1, 60, 400), SCHEMA))
    assert [(name, p.count("Exchange ")) for name, columns, p in written if "text" in columns] == [("wide-lines", 1)]
    assert "Exchange hashpartitioning" not in plan(lines) and lines.count() > 0


def test_values_of_one_height_wait_for_no_anchor(spark):
    """Only values that are taller than some anchor by a level are dealt to cells in which anchors look for them."""
    same = [(1, i, "x 1", 0.95, [[i * 50, 0], [i * 50 + 40, 0], [i * 50 + 40, h], [i * 50, h]]) for i, h in enumerate([20] * 4 + [100])]
    for rows_, unions in ((same[:4], 0), (same, 1)):
        lines = wide.ordered_lines(spark.createDataFrame(rows_, SCHEMA))
        assert plan(wide.value_rows(lines, lines.select("doc_id", F.col("line_no").alias("anchor")))).count("Union") == unions


def test_order_with_null_groups_over_several_batches(spark):
    """Groups go on from batch to batch and from task to task; null is a group like others."""
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (-F.col("id")).alias("k"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        found = wide.in_order(frame, "g", ["k"], "number").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 3000 and all(r.number == (2999 + r.k) // 3 for r in found)


def test_components(spark):
    rng = random.Random(4)
    edges, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g in range(3):
        for _ in range(120):
            a, b = rng.randrange(150), rng.randrange(150)
            edges.append((g, a, b))
        edges += [(g, i, i + 1) for i in range(200, 300)]  # a long chain
    for g, a, b in edges:
        a, b = sorted((find((g, a)), find((g, b))))
        parent[b] = a
    want = sorted((g, a, find((g, a))[1]) for g, a in parent if find((g, a)) != (g, a))
    assert sorted(tuple(r) for r in components(spark.createDataFrame(edges, "g long, a long, b long"), "g").collect()) == want
