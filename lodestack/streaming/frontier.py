"""The crawl frontier as a stream: urls are taken once, hosts are waited for."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestack.functions import urls as U
from lodestack.operators.crawl import DELAY


class Frontier:
    """The frontier of one process. A url is taken once, ever; a host answers again a delay after its last url, and is
    forgotten with its last url."""

    def __init__(self, delay: float = DELAY):
        self.delay, self.seen, self.waiting, self.due = delay, set(), {}, []

    def submit(self, now: float, host: str, url: str) -> bool:
        if url in self.seen:
            return False
        self.seen.add(url)
        if host not in self.waiting:
            self.waiting[host] = []
            heapq.heappush(self.due, (now, host))
        self.waiting[host].append(url)
        return True

    def next(self, now: float) -> tuple[str, str | int | None]:
        """("url", url), ("wait", microseconds) or ("done", None)."""
        if not self.due:
            return "done", None
        at, host = self.due[0]
        if at > now:
            return "wait", round((at - now) * 1e6)
        heapq.heappop(self.due)
        urls = self.waiting[host]
        url = urls.pop(0)
        if urls:
            heapq.heappush(self.due, (now + self.delay, host))
        else:
            del self.waiting[host]
        return "url", url


def submitted(urls: DataFrame, within: str | None = None, at: str = "ts") -> DataFrame:
    """(url, host) of a stream (url), each url once; urls without a host are no pages. Once is once ever, so the state
    grows with the urls; with `within` (as "7 days") it is once in that time of the column `at`, and state is let go."""
    own = urls.select(U.without_fragment(F.col("url")).alias("url"), *([at] if within else []))
    own = own.withColumn("host", U.host(F.col("url"))).where("host IS NOT NULL")
    if within:
        return own.withWatermark(at, within).dropDuplicatesWithinWatermark(["url"])
    return own.dropDuplicates(["url"])


def polite(stream: DataFrame, delay: float = DELAY) -> DataFrame:
    """(host, url, at) of a stream (host, url, ts): when each url may be fetched, a delay after the host's one before, and
    not before it came. State is one time per host."""

    def each(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values(["ts", "url"])
            at = []
            for ts in rows["ts"]:
                free = max(free, ts.value // 1000)
                at.append(free)
                free += round(delay * 1e6)
            yield pd.DataFrame({"host": rows["host"], "url": rows["url"], "at": pd.to_datetime(at, unit="us")})
        state.update((free,))

    return stream.groupBy("host").applyInPandasWithState(each, "host string, url string, at timestamp", "free bigint", "append", "NoTimeout")


class _Held(StatefulProcessor):
    """Per host the urls that wait, and when the next may go; a timer lets one go at a time."""

    def __init__(self, delay: float):
        self.delay = round(delay * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "url string")
        self.free = handle.getValueState("free", "at bigint")

    def _let_go(self, host: str, now: int) -> Iterator[pd.DataFrame]:
        """Lets the first url go if it may; sets the timer for the next. A host is forgotten with its last url."""
        urls = [r[0] for r in self.waiting.get()]
        free = self.free.get()[0] if self.free.exists() else now
        if urls and free <= now:
            yield pd.DataFrame({"host": [host], "url": [urls[0]], "at": [now]})
            urls, free = urls[1:], now + self.delay
        if urls:
            self.waiting.put([(u,) for u in urls])
            self.free.update((free,))
            self.handle.registerTimer(free)
        else:
            self.waiting.clear()
            if free <= now:
                self.free.clear()
            else:
                self.free.update((free,))
                self.handle.registerTimer(free)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(u,) for part in rows for u in part["url"]]
        if new:
            self.waiting.appendList(new)
        if not self.free.exists() or not any(True for _ in self.handle.listTimers()):
            yield from self._let_go(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._let_go(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def held(stream: DataFrame, delay: float = DELAY) -> DataFrame:
    """(host, url, at) of a stream (host, url): each url is held back until its host may be asked again, by a timer of its
    host; at is in milliseconds. Needs the RocksDB state store. The stream must run on, since timers fire with batches."""
    return stream.groupBy("host").transformWithStateInPandas(_Held(delay), "host string, url string, at bigint", "append", "ProcessingTime")


def next_urls(waiting: DataFrame, hosts: DataFrame, now: int, delay: float = DELAY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of a frontier kept in tables: waiting (url, host) urls and hosts (host, free) with the microsecond from
    which on each may be asked, unknown hosts at once. Gives what is taken (url, host, at), one url of each host that is
    free, and the tables after it: nothing is lost while a host is waited for, and a host's time only moves on. A host
    without urls is forgotten once it is free."""
    first = waiting.groupBy("host").agg(F.min("url").alias("url"), F.count("*").alias("n"))
    due = first.join(hosts.groupBy("host").agg(F.max("free").alias("free")), "host", "full")
    may = F.coalesce(F.col("free"), F.lit(0)) <= now
    taken = due.where(may & F.col("url").isNotNull()).select("url", "host", F.lit(now).alias("at"))
    left = waiting.join(taken.select("url", "host"), ["url", "host"], "left_anti")
    step = F.when(may & F.col("url").isNotNull(), F.lit(now + round(delay * 1e6))).otherwise(F.col("free"))
    kept = due.where(F.col("url").isNotNull() & (F.col("n") > 1) | ~may | (F.col("url").isNotNull() & ~may))
    return taken, left, kept.select("host", step.alias("free"))
