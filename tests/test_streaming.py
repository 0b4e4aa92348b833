"""Pages assembled over batches, against the same lines in one batch."""

import datetime
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import layout
from quillframe.streaming import assembly
from quillframe.streaming.assembly import LateLines, assemble_pages
from quillframe.streaming.pages import process_available
from tests.test_layout import SCHEMA, page

START = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)
LINES = f"{SCHEMA}, seen timestamp, total int"


class Feed:
    """A folder of files that a stream reads one to a batch, and the rows that come out."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.files = spark, folder, options, 0

    def add(self, *rows):
        """Rows of (a line of ``page``, minutes after the start, number of lines or None)."""
        made = [(*line, None if at is None else START + datetime.timedelta(minutes=at), total) for line, at, total in rows]
        self.spark.createDataFrame(made, LINES).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        time.sleep(0.05)  # files are taken in order of their times

    def run(self):
        stream = self.spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        pages = assemble_pages(stream, expected="total", **self.options)
        process_available(pages, lambda batch: batch, f"{self.folder}/out", f"{self.folder}/checkpoint").awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/out/*")


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Feed(spark, str(tmp_path), delay="10 minutes", idle="5 minutes", keep="60 minutes")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


TEXTS = [("DATE", 0.99, 10, 10, 40), ("OF", 0.99, 55, 10, 20), ("ISSUE", 0.99, 80, 10, 60), ("2020-01-02", 0.98, 12, 40), ("SEX", 0.99, 10, 80), ("F", 0.98, 12, 110), ("SHORT: one", 0.95, 10, 200)]


def fields(pages):
    found = layout.whole_pages(pages.where("lines IS NOT NULL")).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields"))
    return sorted(tuple(r) for r in layout.explode_fields(found).collect())


def test_lines_over_three_batches_make_the_page_of_one_batch(spark, feed):
    lines = page(*TEXTS, doc=1) + page(*TEXTS[3:], *TEXTS[:3], doc=2)
    for part in range(3):
        feed.add(*((line, part, 7) for i, line in enumerate(lines) if i % 3 == part))
    whole = layout.pages(spark.createDataFrame(lines, SCHEMA)).select("doc_id", layout.generic_fields(F.col("lines")).alias("fields"))
    found = feed.run()
    assert fields(found) == sorted(tuple(r) for r in layout.explode_fields(whole).collect())
    assert {(r.doc_id, r.closed, r.repeated, r.late) for r in found.collect()} == {(1, "complete", 0, 0), (2, "complete", 0, 0)}


def test_repeated_and_late_lines_and_pages_that_never_end(spark, feed):
    one, two, three, none = (page(*TEXTS[:3], doc=d) for d in (1, 2, 3, None))
    feed.add((one[0], 0, 3), (one[1], 0, 3), (two[0], 0, None), (three[0], 1, 9), (none[0], 1, None))
    feed.add((one[1], 2, 3), (one[2], 2, 3), (two[1], 3, None), (two[1], 3, None))
    feed.add((one[0], 4, 3), (one[2], 4, 3), (one[2], None, 3))  # late for page 1; a line without a time is none
    feed.add((page(*TEXTS, doc=9)[0], 200, None))  # time goes on
    feed.add((page(*TEXTS, doc=9)[1], 400, None))
    listener = LateLines()
    spark.streams.addListener(listener)
    try:
        feed.add((two[2], 1, None))  # far behind the watermark
        found = {(r.doc_id, r.closed, r.repeated, r.late, None if r.lines is None else len(r.lines)) for r in feed.run().collect()}
        for _ in range(50):
            if sum(listener.dropped.values()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert found >= {(1, "complete", 1, 0, 3), (1, "late", 0, 2, None), (2, "idle", 1, 0, 2), (3, "idle", 0, 0, 1), (None, "idle", 0, 0, 1)}
    assert {f for f in found if f[0] != 9} == {(1, "complete", 1, 0, 3), (1, "late", 0, 2, None), (2, "idle", 1, 0, 2), (3, "idle", 0, 0, 1), (None, "idle", 0, 0, 1)}
    assert sum(listener.dropped.values()) == 1


def test_state_goes_on_after_a_restart(spark, feed):
    lines = page(*TEXTS, doc=5)
    feed.add(*((line, 0, 7) for line in lines[:4]))
    assert not feed.run().count()
    feed.add(*((line, 1, 7) for line in lines[4:]))
    assert [(r.doc_id, r.closed, len(r.lines)) for r in feed.run().collect()] == [(5, "complete", 7)]


def test_whole_pages_are_those_of_lines(spark):
    lines = page(*TEXTS, ("faint", 0.2, 0, 0), ("  ", 0.9, 0, 0), doc=1) + page(("x", 0.1, 0, 0), doc=2)
    frame = spark.createDataFrame(lines, SCHEMA)
    arrays = frame.groupBy("doc_id").agg(F.collect_list(F.struct("det_no", "text", "confidence", "polygon")).alias("lines"))
    assert layout.whole_pages(arrays).select("doc_id", "lines").orderBy("doc_id").collect() == layout.pages(frame).orderBy("doc_id").collect()


def test_pages_share_calls_of_the_keyed_step(spark, feed, monkeypatch):
    """A call for each page, with a frame in and out, took most of the time. Here two buckets hold 300 pages, one of them without a number."""
    monkeypatch.setattr(assembly, "BUCKETS", 2)
    lines = [line for d in [*range(1, 300), None, 2**53 + 1] for line in page(("A: b", 0.97, 10, 10), ("x", 0.45, -3, 40), doc=d)]
    odd = (7, None, float("nan"), None)
    feed.add(*((line, 0, 2) for line in lines[::2]), ((500, *odd), 0, 1))
    feed.add(*((line, 1, None) for line in lines[1::2]))
    found = {r.doc_id: r for r in feed.run().collect()}
    assert set(found) == {*range(1, 300), None, 2**53 + 1, 500} and {(r.closed, r.repeated, r.late) for r in found.values()} == {("complete", 0, 0)}
    sent = {r.doc_id: r for r in spark.createDataFrame(lines, SCHEMA).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("det_no", "text", "confidence", "polygon"))).alias("lines")).collect()}
    assert all(sorted(found[d].lines) == sent[d].lines for d in sent)
    (line,) = found[500].lines
    assert (line.det_no, line.text, line.polygon) == (7, None, None) and line.confidence != line.confidence


def test_step_is_called_once_for_a_bucket():
    frame = pd.DataFrame({"doc": ["1", "2", "2", None], "at": [5, 6, 7, 8], "of": [1.0, float("nan"), 2.0, float("nan")], "number": [0.0, 0.0, 1.0, float("nan")], "line": ["{}", "{}", "{}", "{}"]})
    state = SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: 0, update=lambda v: None, setTimeoutTimestamp=lambda t: None)
    (rows,) = assembly.Assembly(10, 20)((0,), iter([frame]), state)
    assert sorted(rows["doc_id"]) == ["1", "2"] and set(rows["closed"]) == {"complete"}
