"""Request events of pages as a stream: when each page has come to rest, and what addresses it asked for.

The state of a page is keyed sets: events that wait for the watermark, requests in flight, long-lived requests, and
addresses found, the last three bounded by the caps that a single page has. Events are folded in the order of time and
number once the watermark has passed them, so neither batches nor their order change a result. A page is at rest when
nothing is in flight and nothing has happened for idle_ms, not before it is loaded or patience_ms have passed since its
first event; a timer asks for that, so that it needs no further event. Its row goes out once; what is left of it then
only tells later events apart, and expires after keep_ms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webweft.operators.events import DISCOVERED_MOST, LONG_LIVED, TRACKED_MOST

EVENT = "page string, ts timestamp, seq long, request_id string, method string, url string, type string, mime string"
RESTED = "page string, rest_at timestamp, requests long, urls array<string>"
_TOLD = "page string, rest_ms long, requests long, urls array<string>"


class PageRest(StatefulProcessor):
    """Methods of events: requested, response, finished, failed, loaded; others only show that something happens."""

    def __init__(self, idle_ms: int = 700, patience_ms: int = 1200, keep_ms: int = 600_000, discovered_most: int = DISCOVERED_MOST, tracked_most: int = TRACKED_MOST):
        self.idle, self.patience, self.keep, self.found_most, self.tracked_most = idle_ms, patience_ms, keep_ms, discovered_most, tracked_most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, seq long", "request_id string, method string, url string, type string, mime string")
        self.flying = handle.getMapState("flying", "request_id string", "since long")
        self.long_lived = handle.getMapState("long_lived", "request_id string", "since long")
        self.found = handle.getMapState("found", "url string", "since long")
        #: Of the page: first and last event, loaded, requests and sizes of the sets, and when its rest was told (else -1).
        self.page = handle.getValueState("page", "first long, last long, loaded boolean, requests long, flying long, long_lived long, found long, told long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = self.page.exists() and self.page.get()[7] >= 0
        for frame in rows:
            if told:
                continue
            for r in frame.itertuples(index=False):
                text = lambda x: "" if x is None or x != x else str(x)
                self.waiting.updateValue((int(r.ms), int(r.seq)), (text(r.request_id), text(r.method), text(r.url), text(r.type), text(r.mime)))
        if not told:
            yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.page.exists() and self.page.get()[7] >= 0:
            if now >= self.page.get()[7] + self.keep:
                self.page.clear()
            return
        yield from self._advance(key, now)

    def close(self) -> None:
        pass

    def _rest(self, p: list) -> int | None:
        """When the page is at rest if nothing more happens."""
        if p[4] > 0:
            return None
        return p[1] + self.idle if p[2] else max(p[1] + self.idle, p[0] + self.patience)

    def _advance(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed; tell the page's rest once it is certain; set the next timer."""
        p = list(self.page.get()) if self.page.exists() else None
        keys = sorted(self.waiting.keys()) if self.waiting.exists() else []
        for at in keys:
            if at[0] > now or p is not None and self._rest(p) is not None and self._rest(p) <= at[0]:
                break
            p = self._fold(p or [at[0], at[0], False, 0, 0, 0, 0, -1], at[0], self.waiting.getValue(at))
            self.waiting.removeKey(at)
        if p is None:
            self.handle.registerTimer(keys[0][0])
            return
        rest = self._rest(p)
        if rest is not None and rest <= now:
            urls = sorted(u for (u,) in self.found.keys()) if self.found.exists() else []
            for some in (self.waiting, self.flying, self.long_lived, self.found):
                some.clear()
            p[7] = now
            self.page.update(tuple(p))
            self.handle.registerTimer(now + self.keep)
            yield pd.DataFrame({"page": [key[0]], "rest_ms": [rest], "requests": [p[3]], "urls": [urls]})
            return
        self.page.update(tuple(p))
        left = [at[0] for at in keys if at[0] > now][:1]
        for at in {*left, *([rest] if rest is not None else [])}:
            self.handle.registerTimer(at)

    def _fold(self, p: list, at: int, event: tuple) -> list:
        request, method, url, kind, mime = event
        p[1] = at
        if method == "loaded":
            p[2] = True
        elif method == "requested":
            p[3] += 1
            if request and not self.long_lived.containsKey((request,)):
                self._put(self.flying, (request,), at, p, 4, self.tracked_most)
            self._put(self.found, (url,), at, p, 6, self.found_most)
        elif method == "response":
            self._put(self.found, (url,), at, p, 6, self.found_most)
            if request and (kind.lower() in LONG_LIVED or "event-stream" in mime.lower()):
                self._put(self.long_lived, (request,), at, p, 5, self.tracked_most)
                self._drop(self.flying, (request,), p, 4)
        elif method in ("finished", "failed"):
            self._drop(self.flying, (request,), p, 4)
            self._drop(self.long_lived, (request,), p, 5)
        return p

    @staticmethod
    def _put(some, key: tuple, at: int, p: list, size: int, most: int) -> None:
        if key[0] and p[size] < most and not some.containsKey(key):
            some.updateValue(key, (at,))
            p[size] += 1

    @staticmethod
    def _drop(some, key: tuple, p: list, size: int) -> None:
        if key[0] and some.containsKey(key):
            some.removeKey(key)
            p[size] -= 1


def rested(events: DataFrame, delay: str = "2 seconds", **settings) -> DataFrame:
    """One row for each page that has come to rest. events: a stream as EVENT has it; settings: of PageRest.

    The session's state store must be RocksDB's.
    """
    timely = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    told = timely.groupBy("page").transformWithStateInPandas(statefulProcessor=PageRest(**settings), outputStructType=_TOLD, outputMode="Append", timeMode="EventTime")
    return told.select("page", F.timestamp_millis("rest_ms").alias("rest_at"), "requests", "urls")
