"""Pages whose lines arrive over several batches: keyed state until a page is whole or its time is over.

A source that delivers a page line by line needs memory between batches, which the page operators do not have. Here the
state of a page holds the lines so far; it is closed when the stated number of lines has come, or once the watermark has
passed its last line by a while. A closed page leaves a marker for some time, which counts what still comes.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LINE = "struct<det_no: int, text: string, confidence: float, polygon: array<array<int>>>"
#: Pages share their state with others of their bucket, as a call of the keyed step costs as much as hundreds of lines. Stays the same while a checkpoint is in use.
BUCKETS = 4096
#: The pages of a bucket as ``Assembly`` has them, packed.
STATE = "pages binary"
PAGE = "doc_id string, lines string, closed string, repeated int, late int"


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(float(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


class Page:
    """What is known of a page between batches; ``last`` is its latest event time and ``wake`` when it is looked at again, in milliseconds. Lines are JSON by number."""

    __slots__ = ("expected", "last", "closed", "repeated", "late", "lines", "wake")

    def __init__(self, *values):
        self.expected, self.last, self.closed, self.repeated, self.late, self.lines, self.wake = values or (None, 0, False, 0, 0, {}, 0)

    def __reduce__(self):
        return tuple, (tuple(getattr(self, name) for name in self.__slots__),)


class Assembly:
    """The keyed step of ``assemble_pages``: the pages of one bucket, each for itself."""

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        pages = {doc: Page(*values) for doc, values in pickle.loads(zlib.decompress(state.get[0])).items()} if state.exists else {}
        rows: list[tuple] = []
        touched = set() if state.hasTimedOut else self.read(pages, batches)
        for doc in touched:
            page = pages[doc]
            if not page.closed and page.expected is not None and len(page.lines) >= page.expected:
                rows.append(self.row(doc, page, "complete"))
                self.close(page)
            page.wake = max(page.last + (self.keep if page.closed else self.idle), now + 1)
        for doc in [d for d, page in pages.items() if page.wake < now and d not in touched]:
            page = pages[doc]
            if page.closed:
                if page.late:
                    rows.append((doc, None, "late", 0, page.late))
                del pages[doc]
            else:
                rows.append(self.row(doc, page, "idle"))
                self.close(page)
                page.wake = max(page.last + self.keep, now + 1)
        if pages:
            state.update((zlib.compress(pickle.dumps(pages, pickle.HIGHEST_PROTOCOL), 1),))
            state.setTimeoutTimestamp(max(min(page.wake for page in pages.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "lines", "closed", "repeated", "late"])

    def read(self, pages: dict[str | None, Page], batches: Iterator[pd.DataFrame]) -> set:
        """Adds the lines of a batch to their pages, and tells which these are."""
        touched = set()
        for batch in batches:
            for doc, at, of, number, line in zip(*(batch[c].tolist() for c in ("doc", "at", "of", "number", "line"))):
                page = pages.get(doc)
                if page is None:
                    page = pages[doc] = Page()
                touched.add(doc)
                page.last = max(page.last, at)
                if of == of and of is not None:  # not a number stands for null
                    page.expected = int(of)
                number = int(number) if number == number and number is not None else None
                if page.closed:
                    page.late += 1
                elif number in page.lines:
                    page.repeated += 1
                else:
                    page.lines[number] = line
        return touched

    def close(self, page: Page) -> None:
        page.closed, page.late, page.lines = True, 0, {}

    def row(self, doc: str | None, page: Page, closed: str) -> tuple:
        return doc, f"[{','.join(page.lines.values())}]", closed, page.repeated, 0


def assemble_pages(lines: DataFrame, time: str = "seen", expected: str | None = None, delay: str = "10 minutes", idle: str = "5 minutes", keep: str = "1 hour") -> DataFrame:
    """A stream of (doc_id, lines, closed, repeated, late) of a stream of lines (doc_id, det_no, text, confidence, polygon, and a time).

    A page is given once, ``closed`` as ``complete`` when as many different lines have come as its lines say (column ``expected``, null where
    they don't know), or as ``idle`` when the watermark (``delay`` behind the latest time) has passed its last line by ``idle``.
    Of lines with one number (nulls are a number here) the first counts, the others are ``repeated``. Lines that come for a page
    already closed are not part of it; ``keep`` after the last of them a row ``late`` without lines tells their number, and the page is
    forgotten. Lines without a time, or older than the watermark when they come, are dropped by Spark ahead of the state; ``LateLines``
    counts these. The state is of the size of the open pages, which are dealt to ``BUCKETS`` keys by their number, and the result goes to ``layout.whole_pages`` without a shuffle.
    """
    from pyspark.sql import functions as F

    of = F.lit(None).cast("int") if expected is None else F.col(expected).cast("int")
    # Lines pass the state as JSON. Confidences are doubles there, as text of 32-bit ones may be read as another number.
    line = F.to_json(F.struct(F.col("det_no").cast("int").alias("det_no"), "text", F.col("confidence").cast("float").cast("double").alias("confidence"), "polygon"))
    doc, seen = F.col("doc_id").cast("long"), F.col(time).cast("timestamp")
    known = lines.select(seen.alias("seen"), F.unix_millis(seen).alias("at"), doc.cast("string").alias("doc"), of.cast("double").alias("of"), F.col("det_no").cast("int").cast("double").alias("number"), line.alias("line"))
    step = Assembly(_milliseconds(idle), _milliseconds(keep))
    dealt = known.where("seen IS NOT NULL").withColumn("bucket", F.pmod(F.hash("doc"), F.lit(BUCKETS)))
    found = dealt.withWatermark("seen", delay).groupBy("bucket").applyInPandasWithState(step, PAGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    read = F.from_json("lines", f"array<{LINE.replace('float', 'double')}>").cast(f"array<{LINE}>")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), read.alias("lines"), "closed", "repeated", "late")


class LateLines(StreamingQueryListener):
    """Counts the lines that came behind the watermark: ``spark.streams.addListener(LateLines())``. ``dropped`` has a number for each query id."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        rows = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
