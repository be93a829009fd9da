"""What the keyed state machines share: the state store they need, and shards of hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Rows of one frame that a state machine gives out.
CHUNK = 10_000


@contextmanager
def state_store(spark: SparkSession, idle_batches: bool = True):
    """Streams started inside keep their state in RocksDB, which transformWithState needs; the session's settings come back.

    Without idle_batches they only run for new data. State machines on processing time would otherwise never come to an end
    with the trigger availableNow; those on event time need idle batches for their last timers.
    """
    wanted = {PROVIDER: ROCKS, IDLE: str(idle_batches).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sharded(feed: DataFrame, item: str, is_mark: Column, shards: int) -> DataFrame:
    """feed with a column shard: one by the item's hash, and every shard for marks that concern the whole key. So a key of
    any size is spread over that many groups."""
    own = F.array(F.pmod(F.xxhash64(item), F.lit(shards)).cast("int"))
    return feed.withColumn("shard", F.explode(F.when(is_mark, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)))


def frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for i in range(0, max(len(rows), 1), CHUNK):
        yield pd.DataFrame(rows[i : i + CHUNK], columns=columns, dtype=object)
