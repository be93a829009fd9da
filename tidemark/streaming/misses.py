"""Misses in a row, removals and returns of the items of a scope, with absence inferred at the end of each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.stateful import CHUNK, frames, sharded

EVENTS = "scope string, source_id string, run_id string, type string, miss_count long"
COLUMNS = ["scope", "source_id", "run_id", "type", "miss_count"]


def _parts(values: list) -> list[list]:
    return [values[i : i + CHUNK] for i in range(0, len(values), CHUNK)]


def _packed(items: dict) -> list[tuple]:
    return [*zip(_parts(list(items)), _parts(list(items.values())), strict=True)]


class Misses(StatefulProcessor):
    """A shard of one scope. State: misses of each live item, when each removed one was removed (which is forgotten after a
    while), the observations of runs that haven't ended, and the last run that has. A run's end reads and writes all of it,
    as it concerns each item."""

    def __init__(self, threshold: int, keep_removed_ms: int):
        self.threshold, self.keep_removed_ms = threshold, keep_removed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # arrays of many items a row: each row and each call costs a round trip to the JVM, whatever it holds
        self.live = handle.getListState("live", "source_ids array<string>, misses array<long>")
        self.removed = handle.getListState("removed", "source_ids array<string>, at_ms array<long>")
        self.waiting = handle.getListState("waiting", "run_id string, source_ids array<string>")
        self.last = handle.getValueState("last", "run_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        mark = df["complete"].notna()
        last = self.last.get()[0] if self.last.exists() else ""
        seen = df.loc[~mark & (df["run_id"] > last) & df["source_id"].notna(), ["run_id", "source_id"]].groupby("run_id")["source_id"].unique()
        ends = df.loc[mark & (df["run_id"] > last)].groupby("run_id")["complete"].all().sort_index()
        if not len(ends):
            if len(seen):
                self.waiting.appendList(self._runs(seen.items()))
            return
        waiting: dict[str, set] = {}
        for run, ids in [*self.waiting.get(), *seen.items()]:
            waiting.setdefault(run, set()).update(ids)
        now = timerValues.getCurrentProcessingTimeInMs()
        live = {s: n for ids, misses in self.live.get() for s, n in zip(ids, misses, strict=True)}
        removed = {s: at for ids, when in self.removed.get() for s, at in zip(ids, when, strict=True) if not self.keep_removed_ms or at + self.keep_removed_ms > now}
        out: list[tuple] = []
        for run, complete in ends.items():
            observed = waiting.pop(run, set())
            for s in sorted(observed):
                if s not in live and s in removed:
                    del removed[s]
                    out.append((key[0], s, run, "RESTORED", 0))
                elif live.get(s):
                    out.append((key[0], s, run, "RESTORED", 0))
                live[s] = 0
            for s in sorted(live.keys() - observed) if complete else ():
                live[s] += 1
                gone = live[s] >= self.threshold
                out.append((key[0], s, run, "REMOVED" if gone else "MISSING", live[s]))
                if gone:
                    del live[s]
                    removed[s] = now
            last = run
            while len(out) >= CHUNK:
                yield from frames(out[:CHUNK], COLUMNS)
                del out[:CHUNK]
        for state, rest in ((self.live, _packed(live)), (self.removed, _packed(removed)), (self.waiting, self._runs((r, ids) for r, ids in waiting.items() if r > last))):
            state.clear()
            if rest:
                state.put(rest)
        self.last.update((last,))
        yield from frames(out, COLUMNS)

    @staticmethod
    def _runs(runs) -> list[tuple]:
        return [(run, part) for run, ids in runs for part in _parts(list(ids))]

    def close(self) -> None:
        pass


def miss_counter(feed: DataFrame, threshold: int = 3, keep_removed_ms: int = 90 * 86_400_000, shards: int = 16) -> DataFrame:
    """Events MISSING, REMOVED and RESTORED of a feed (scope, run_id, source_id, complete), with the misses in a row.

    A row without ``complete`` says that the run observed the item; a row with it that the run has ended, and whether it saw
    the whole scope. At the end of a complete run each live item that it didn't observe misses once more; an incomplete one
    only restores. Runs go in the order of their ids; what comes after its run's end, or of a run before the last ended one,
    is late and ignored. Removed items are remembered for ``keep_removed_ms`` of processing time; one that returns later is
    new. A scope is held by ``shards`` groups of its items. Repeated rows change nothing.
    With the trigger availableNow, start the stream within state_store(spark, idle_batches=False).
    """
    rows = sharded(feed.withColumn("source_id", F.col("source_id").cast("string")), "source_id", F.col("complete").isNotNull(), shards)
    grouped = rows.select("scope", "shard", "run_id", "source_id", "complete").groupBy("scope", "shard")
    return grouped.transformWithStateInPandas(Misses(max(2, int(threshold)), keep_removed_ms), EVENTS, "Append", "ProcessingTime")
