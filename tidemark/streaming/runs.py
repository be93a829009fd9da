"""Runs gathered in keyed state until their end-of-run marker comes, over as many micro-batches as it takes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.stateful import CHUNK, frames, sharded

GATHERED = "run_id string, kind string, payload string, expected long, failures int"
COLUMNS = ["run_id", "kind", "payload", "expected", "failures"]


class Gatherer(StatefulProcessor):
    """A shard of one run: rows are held until the marker, and given out from then on; the timer clears what never ends."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # arrays of many items a row: each row and each call costs a round trip to the JVM, whatever it holds
        self.held = handle.getListState("held", "payloads array<string>")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.ended.exists()
        ended = known and self.ended.get()[0]
        latest, expected, failures = 0, None, 0
        items: list[str] = []
        for df in rows:
            latest = max(latest, int(df["at_ms"].max()))
            mark = df["expected"].notna()
            items += df.loc[~mark, "payload"].tolist()
            if mark.any():
                expected = max(expected or 0, int(df.loc[mark, "expected"].max()))
                failures = max(failures, int(df.loc[mark, "failures"].fillna(0).max()))
                if not ended:
                    ended = True
                    yield from self._let_go(key)
            while len(items) >= CHUNK:
                if ended:
                    yield from self._rows(key, items[:CHUNK])
                else:
                    self.held.appendList([(items[:CHUNK],)])
                del items[:CHUNK]
        if not known:
            self.handle.registerTimer(latest + self.patience_ms)
        if items and ended:
            yield from self._rows(key, items)
        elif items:
            self.held.appendList([(items,)])
        if expected is not None:
            yield from frames([(key[0], "end", None, expected, failures)], COLUMNS)
        if not known or expected is not None:
            self.ended.update((ended,))

    def _let_go(self, key) -> Iterator[pd.DataFrame]:
        for (payloads,) in self.held.get():
            yield from self._rows(key, list(payloads))
        self.held.clear()

    @staticmethod
    def _rows(key, payloads: list[str]) -> Iterator[pd.DataFrame]:
        yield from frames([(key[0], "row", p, None, None) for p in payloads], COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.ended.clear()
        yield from frames([(key[0], "expired", None, None, None)], COLUMNS)

    def close(self) -> None:
        pass


def gather_runs(feed: DataFrame, item: str, columns: list[str], delay: str = "1 hour", patience_ms: int = 86_400_000, shards: int = 32) -> DataFrame:
    """run_id, kind, payload, expected, failures of a feed (run_id, at, expected, failures, item and columns).

    A row with ``expected`` is the marker: its run has ended, and has so many distinct items. Before it nothing of the run
    comes out; with it all rows that are held (kind ``row``, the payload a JSON object of the columns) and an ``end`` for each
    shard, afterwards what still arrives. A run that hasn't been cleared ``patience_ms`` of event time after its first row
    gives ``expired`` for each shard that knows it, and its state goes. A run is held by ``shards`` groups, however large it
    is. Rows later than ``delay`` behind the newest one are dropped.
    """
    rows = feed.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at")).withColumn("payload", F.to_json(F.struct(*columns)))
    rows = sharded(rows, item, F.col("expected").isNotNull(), shards)
    grouped = rows.select("run_id", "shard", "at", "at_ms", "payload", F.col("expected").cast("long").alias("expected"), F.col("failures").cast("int").alias("failures")).groupBy("run_id", "shard")
    return grouped.transformWithStateInPandas(Gatherer(patience_ms), GATHERED, "Append", "EventTime")
