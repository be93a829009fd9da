"""Attempts at the items of an import, folded to one state an item and one event an import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States that are never redone.
TERMINAL = ("success", "skipped", "deferred")
ITEMS = "import_id string, item_id string, state string, attempts int, discovered long"
ITEM = Row("import_id", "item_id", "state", "attempts", "discovered")
DONE = "import_id string, discovered long, success long, skipped long, deferred long, outcome string"
IMPORT = Row("import_id", "discovered", "success", "skipped", "deferred", "outcome")


class ItemStates(StatefulProcessor):
    """One item of an import: claims take a lease, outcomes end it, and a lease that runs out is a failed attempt.

    Items are many and their rows few, so they come as rows: a frame for each would cost more than what is done with it."""

    def __init__(self, most: int, lease_ms: int):
        self.most, self.lease_ms = most, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempts int, token string, lease long")

    def _failed(self, attempts: int) -> str:
        return "deferred" if attempts >= self.most else "failed"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1] is None:
            for r in rows:
                if r["kind"] == "discovered":
                    yield ITEM(key[0], None, None, None, r["total"])
            return
        state, attempts, token, lease = self.item.get() or ("pending", 0, None, 0)
        if state in TERMINAL:
            return
        found = sorted(rows, key=lambda r: r["kind"] or "", reverse=True)  # outcomes before claims
        for r in sorted(found, key=lambda r: (r["at_ms"] is None, r["at_ms"])):
            kind, given, at = r["kind"], r["token"], float("nan") if r["at_ms"] is None else r["at_ms"]
            if state == "processing" and lease <= at:
                state, token = self._failed(attempts), None
            if state in TERMINAL:
                break
            if kind == "claim" and state != "processing":
                state, attempts, token, lease = "processing", attempts + 1, given, int(at) + self.lease_ms
            elif kind == "outcome" and state == "processing" and given == token:
                state, token = r["outcome"] if r["outcome"] in TERMINAL[:2] else self._failed(attempts), None
        self.item.update((state, attempts, token, lease))
        if state == "processing":
            self.handle.registerTimer(lease)
        if state in TERMINAL:
            yield ITEM(key[0], key[1], state, attempts, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, attempts, _, lease = self.item.get()
        if state == "processing" and lease <= expiredTimerInfo.getExpiryTimeInMs():
            state = self._failed(attempts)
            self.item.update((state, attempts, None, lease))
            if state in TERMINAL:
                yield ITEM(key[0], key[1], state, attempts, None)

    def close(self) -> None:
        pass


class Imports(StatefulProcessor):
    """One import: the numbers of its terminal items, and whether its event is out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "discovered long, success long, skipped long, deferred long, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        discovered, *counts, done = self.totals.get() or (None, 0, 0, 0, False)
        for r in rows:
            if r["discovered"] is not None:
                discovered = r["discovered"] if discovered is None else max(discovered, r["discovered"])
            counts = [n + r[s] for n, s in zip(counts, TERMINAL, strict=True)]
        ready = not done and discovered is not None and sum(counts) >= discovered
        self.totals.update((discovered, *counts, done or ready))
        if ready:
            yield IMPORT(key[0], discovered, *counts, "success" if sum(counts) == discovered else "invalid")

    def close(self) -> None:
        pass


def item_states(feed: DataFrame, most: int = 4, lease_ms: int = 300_000, delay: str = "1 minute") -> DataFrame:
    """import_id, item_id, state, attempts, discovered: a row when an item becomes success, skipped or deferred, once and for
    all, and one for each row that says how many items an import has.

    feed: import_id, item_id, kind (``discovered`` with total and no item_id; ``claim`` with token; ``outcome`` with token
    and outcome), at. A claim counts as an attempt unless the item is terminal or under a lease; an outcome counts only for
    the token that holds the lease. Any outcome but success and skipped fails the attempt, as does a lease that runs out (on an
    event-time timer); the ``most``-th failure defers the item. Rows later than ``delay`` behind the newest one are dropped.
    """
    rows = feed.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    grouped = rows.select("import_id", "item_id", "kind", "token", "outcome", F.col("total").cast("long").alias("total"), "at", "at_ms").groupBy("import_id", "item_id")
    return grouped.transformWithState(ItemStates(most, lease_ms), ITEMS, "Append", "EventTime")


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts = {s: (b["state"] == s).astype(int) for s in TERMINAL}
        yield b.assign(**counts).groupby("import_id", as_index=False).agg(discovered=("discovered", "max"), **{s: (s, "sum") for s in TERMINAL}).astype({"discovered": "Int64"})


def finished_imports(items: DataFrame) -> DataFrame:
    """import_id, discovered, success, skipped, deferred, outcome: one event when an import's terminal items are as many as
    were discovered (``success``), or more (``invalid``). items is what item_states gives; it is tallied before it is shuffled,
    so that a large import sends a few rows a task."""
    tallied = items.mapInPandas(_tally, "import_id string, discovered long, success long, skipped long, deferred long")
    return tallied.groupBy("import_id").transformWithState(Imports(), DONE, "Append", "None")
