"""Running headers and footers of documents whose pages come in several micro-batches.

The state of a document is its number of pages and, by side and line, the pages that have the line at
that margin; no text is kept.  A document ends `patience` after the watermark passed its last page,
or at once with a page that says so; then its running lines are put out, once, and its state goes.
A page that comes after its document has ended is late: it opens a new document of the same key, which
has running lines of its own if it gets as many pages as that takes.  A page that is behind the
watermark counts as long as its document is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.compress import LEAST_PAGES, margins

OUT = "doc_id string, line string, pages long"


class _Counts(StatefulProcessor):
    def __init__(self, patience_ms: int) -> None:
        self._patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pages = handle.getValueState("pages", "n long, until long")
        self._lines = handle.getMapState("lines", "side int, line string", "n long")

    def _ended(self, doc: str) -> Iterator[pd.DataFrame]:
        n, _ = self._pages.get()
        found = {key[1] for key, value in self._lines.iterator() if n >= LEAST_PAGES and 2 * value[0] >= n}
        self._pages.clear()
        self._lines.clear()
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        yield pd.DataFrame([(doc, line, n) for line in sorted(found)], columns=["doc_id", "line", "pages"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, until = self._pages.get() if self._pages.exists() else (0, 0)
        last = False
        for frame in rows:
            n += len(frame)
            last = last or bool(frame["last"].fillna(False).any())
            until = max(until, int(frame["ts"].max().timestamp() * 1000) + self._patience)
            for side in ("head", "foot"):
                counts = frame[side].explode().dropna().value_counts()
                for line, k in counts.items():
                    at = (("head", "foot").index(side), line)
                    before = self._lines.getValue(at)[0] if self._lines.containsKey(at) else 0
                    self._lines.updateValue(at, (before + int(k),))
        self._pages.update((n, until))
        if last:
            yield from self._ended(key[0])
            return
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._pages.exists():
            yield from self._ended(key[0])

    def close(self) -> None:
        pass


def running_lines_stream(pages: DataFrame, ts: str = "ts", late: str = "10 minutes", patience_ms: int = 60_000) -> DataFrame:
    """(doc_id, line, pages) of every document that has ended, of a stream of pages: doc_id,
    text_content, the time column and, if there is one, `last`, true for a document's last page.

    The margins of a page are found by column expressions; only they come to the state.  The
    session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    last = F.coalesce(F.col("last"), F.lit(False)) if "last" in pages.columns else F.lit(False)
    sides = [margins(F.col("text_content"), foot).alias(name) for name, foot in (("head", False), ("foot", True))]
    rows = pages.withWatermark(ts, late).select(F.col("doc_id").cast("string").alias("doc_id"), F.col(ts).alias("ts"), last.alias("last"), *sides)
    return rows.groupBy("doc_id").transformWithStateInPandas(_Counts(patience_ms), OUT, "append", "EventTime")
