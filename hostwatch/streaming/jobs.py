"""Structured Streaming forms of the keyed operators; the ingest job is in ``ingest``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hostwatch.operators.feeds import union_feeds
from hostwatch.operators.filters import flagged_names
from hostwatch.operators.records import NAMES


def stream_recent_dedup(names: DataFrame, window: str = "10 minutes") -> DataFrame:
    """A host again within the window is dropped; seen_at is a timestamp."""
    return names.withWatermark("seen_at", window).dropDuplicatesWithinWatermark(["host"])


class _Cap(StatefulProcessor):
    """Per parent: the window's start and count, and the hosts accepted in it.  A timer empties
    both when the watermark has passed the window, so that a parent costs nothing after it."""

    def __init__(self, limit: int, seconds: int, columns: list[str]):
        self.limit, self.span, self.columns = limit, seconds * 1_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int")
        self.accepted = handle.getMapState("accepted", "host string", "at long")

    def _end(self, start: int) -> int:
        return -(-(start + self.span) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.window.get() if self.window.exists() else (None, 0)
        b = pd.concat(list(rows)).sort_values(["event_us", "host"], kind="stable")
        keep = []
        for host, t in zip(b["host"], b["event_us"].tolist()):
            if self.accepted.containsKey((host,)):
                keep.append(True)
                continue
            if start is None or t - start >= self.span:
                if start is not None:
                    self.handle.deleteTimer(self._end(start))
                    self.accepted.clear()
                start, n = t, 0
                self.handle.registerTimer(self._end(start))
            keep.append(n < self.limit)
            if keep[-1]:
                n += 1
                self.accepted.updateValue((host,), (t,))
        self.window.update((start, n))
        yield b[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self._end(self.window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
            self.accepted.clear()
        return iter(())

    def close(self) -> None: ...


def stream_parent_cap(names: DataFrame, limit: int = 20, window_seconds: int = 600, known: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """``names(parent, host, seen_at)``, seen_at a timestamp, with at most ``limit`` new hosts a
    parent and window; the window starts with the first charged name after the last one's end.

    The parent itself, hosts without parent and ``known`` hosts are free and never reach the
    state.  A host accepted in an earlier window is free only as long as ``known`` (read anew
    each batch) has it: give the records that the stream feeds.  The state of a parent goes
    when the watermark passes its window, and outlives a restart until then.
    """
    rows = names.withWatermark("seen_at", delay)
    free = F.coalesce(F.col("host") == F.col("parent"), F.lit(True))
    if known is not None:
        rows = rows.join(known.select(F.col("host").alias("__k")).distinct(), F.col("host") == F.col("__k"), "left")
        free = free | F.col("__k").isNotNull()
    charged = rows.where(~free).select(*names.columns, F.unix_micros("seen_at").alias("event_us"))
    kept = charged.groupBy("parent").transformWithStateInPandas(_Cap(limit, window_seconds, names.columns), names.schema, "append", "eventTime")
    return rows.where(free).select(*names.columns).unionByName(kept) if limit > 0 else names


class _Quiet(StatefulProcessor):
    """Per feed: the last check with a delivery, all deliveries, and whether this silence was
    told.  A timer stands where the silence would be long enough; a delivery moves it."""

    def __init__(self, every: int, n: int):
        self.every, self.n = every, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, total long, told boolean")

    def _due(self, last: int) -> int:
        return (last + self.n + 1) * self.every * 1000

    def _report(self, feed: str, last: int, total: int) -> tuple:
        at = pd.Timestamp((last + self.n) * self.every, unit="s")
        return feed, at, "gone_quiet" if total else "never_carried", (self.n - 1) * self.every

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["feed", "checked_at", "kind", "quiet_seconds"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last = int(initialState["first_check"].min()) - 1
        self.state.update((last, 0, False))
        self.handle.registerTimer(self._due(last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        last, total, told = self.state.get() if known else (None, 0, False)
        out = []
        b = pd.concat(list(rows)).sort_values("check")
        for check, n in zip(b["check"].tolist(), b["n"].tolist()):
            if last is not None:
                if check > last + self.n and not told:
                    out.append(self._report(key[0], last, total))
                self.handle.deleteTimer(self._due(last))
            last, total, told = check, total + n, False
            self.handle.registerTimer(self._due(last))
        self.state.update((last, total, told))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, total, told = self.state.get()
        if told or self._due(last) != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.update((last, total, True))
        yield from self._frame([self._report(key[0], last, total)])

    def close(self) -> None: ...


def stream_quiet_feeds(certs: DataFrame, every_seconds: int = 60, n: int = 3, feeds: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """``(feed, checked_at, kind, quiet_seconds)`` once a silence of ``n`` checks; a delivery
    arms it again.  Checks stand on a grid of event time and count when the watermark passes.

    certs: feed and seen_at, a timestamp.  feeds: ``(feed, since)`` of those that should carry;
    one that never did is told too.  Deliveries are counted per feed and check before they
    reach the state, so a busy feed is one row a check there.
    """
    slot = F.window("seen_at", f"{every_seconds} seconds")
    counts = certs.select("feed", "seen_at").withWatermark("seen_at", delay).groupBy(slot, "feed").agg(F.count("*").alias("n"))
    check = lambda at: F.floor(F.unix_seconds(at) / every_seconds)
    rows = counts.select("feed", F.window_time("window").alias("at"), check(F.col("window.start")).alias("check"), "n")
    first = None if feeds is None else feeds.select("feed", check(F.col("since").cast("timestamp")).alias("first_check")).groupBy("feed")
    return rows.groupBy("feed").transformWithStateInPandas(_Quiet(every_seconds, n), "feed string, checked_at timestamp, kind string, quiet_seconds long", "append", "eventTime", initialState=first)


class _Bucket(StatefulProcessor):
    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.state.get() if self.state.exists() else (self.burst, None)
        for b in rows:
            b = b.sort_values(["ts", "req_id"], kind="stable")
            out = []
            for t in b["ts"].astype("int64") / 1e9:
                tokens = tokens if last is None else min(self.burst, tokens + (t - last) * self.rate)
                last = t
                ok = tokens >= 1
                tokens -= ok
                out.append(bool(ok))
            self.state.update((float(tokens), float(last)))
            yield b.assign(admitted=out)

    def close(self) -> None: ...


def stream_admit_per_address(requests: DataFrame, rate: float = 32.0, burst: float = 64.0) -> DataFrame:
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])
    return requests.groupBy("address").transformWithStateInPandas(_Bucket(rate, burst), schema, "append", "none")


def stream_union(feeds: dict[str, DataFrame], delays: dict[str, str], selection: str = "all", stalled: str = "wait") -> DataFrame:
    """The selected feeds as one stream, each with a watermark of its own.

    stalled: with ``wait`` the slowest feed holds the watermark of all back, so that nothing of
    it is late; with ``pass`` the fastest one moves it, so that a feed that stopped doesn't stop
    the rest, and what it then brings is late.  Sets the session's policy, which a query takes
    when it starts.
    """
    policy = {"wait": "min", "pass": "max"}[stalled]
    marked = {name: df.withWatermark("seen_at", delays.get(name, "0 seconds")) for name, df in feeds.items()}
    out = union_feeds(marked, selection)
    out.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
    return out


def counted_names(certs: DataFrame, name: str = "names") -> DataFrame:
    """A stream of certificates as one of names that counts on the way: one pass gives the rows
    and, in the query's progress under ``name``, the counters; see FunnelListener."""
    flagged = flagged_names(certs)
    seen = flagged.observe(
        name, F.count_if("head").alias("certs"), F.count("host").alias("names"), F.count_if((F.col("origin") == "san") & F.col("host").isNotNull()).alias("from_san"),
        F.count_if(F.col("head") & F.col("skipped")).alias("skipped_cn"), F.coalesce(F.sum(F.when(F.col("head"), F.col("sans_cut"))), F.lit(0)).alias("sans_cut"),
    )
    return seen.where("host IS NOT NULL").select(*NAMES)


class FunnelListener(StreamingQueryListener):
    """Live counters: sums what the queries' batches observed under ``name``, and keeps each
    report ``(time, query, metrics)``.  Register it with ``spark.streams.addListener``."""

    def __init__(self, name: str = "names"):
        self.name, self.reports, self.totals = name, [], {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            seen = row.asDict()
            self.reports.append((event.progress.timestamp, str(event.progress.id), seen))
            for k, v in seen.items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
