"""Queries that run the streaming operators over the driver's tables until these are read, and return what they wrote."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.registry import query
from tidemark.sources.fixtures import Tables
from tidemark.sources.shared import new_folder
from tidemark.streaming import sync
from tidemark.streaming.misses import miss_counter
from tidemark.streaming.outcomes import finished_imports, item_states
from tidemark.streaming.stateful import state_store


def _folder(t: Tables) -> str:
    return new_folder(t.spark, "stream")


def _events(t: Tables) -> DataFrame:
    """The events table as a stream of its files."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir) if t.events.inputFiles()[0].endswith("/events.parquet") else t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet")


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by 1, 2")
def stream_dedup(t: Tables) -> DataFrame:
    root = _folder(t)
    messages = sync.dedup_messages(_events(t).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", "3650 days")
    messages.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(messages.schema).parquet(f"{root}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _fed(t: Tables, root: str, parts: list[DataFrame], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream on these parts one after the other: a part is added to its feed, and it goes on from its checkpoint.

    A part is one batch, however many files it has, so the number of batches doesn't grow with the tables.
    """
    for p in parts:
        p.write.mode("append").parquet(f"{root}/feed")
        start(t.spark.readStream.schema(p.schema).parquet(f"{root}/feed")).awaitTermination()


def _written(t: Tables, root: str, parts: list[DataFrame], states: Callable[[DataFrame], DataFrame], idle_batches: bool = True) -> DataFrame:
    def start(feed: DataFrame) -> StreamingQuery:
        with state_store(t.spark, idle_batches):
            return states(feed).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()

    _fed(t, root, parts, start)
    return t.spark.read.parquet(f"{root}/out")


@query("""with o as (select distinct event_type as scope, user_id as source_id, cast(ts as date) as d from events), r as (select distinct scope, d from o),
    f as (select scope, source_id, min(d) as first from o group by 1, 2),
    a as (select f.scope, f.source_id, r.d, o.d is not null as seen from f join r on r.scope = f.scope and r.d >= f.first left join o on o.scope = f.scope and o.source_id = f.source_id and o.d = r.d where o.d is not null or day(r.d) <> 13),
    g as (select *, sum(cast(seen as int)) over (partition by scope, source_id order by d) as grp from a),
    m as (select *, row_number() over (partition by scope, source_id, grp order by d) - 1 as misses from g), l as (select *, lag(misses) over (partition by scope, source_id order by d) as before from m)
    select scope, source_id, cast(d as varchar) as run_id, case when seen then 'RESTORED' when misses = 2 then 'REMOVED' else 'MISSING' end as type, misses as miss_count from l where (seen and before > 0) or (not seen and misses <= 2)""")
def stream_misses(t: Tables) -> DataFrame:
    """Each event type is a scope and each day a run that observes its users; the run of the 13th is incomplete."""
    root = _folder(t)
    day = F.date_format("ts", "yyyy-MM-dd")
    seen = t.events.select(F.col("event_type").alias("scope"), day.alias("run_id"), F.col("user_id").cast("string").alias("source_id")).distinct()
    rows = seen.withColumn("complete", F.lit(None).cast("boolean"))
    ends = seen.groupBy("scope", "run_id").agg(F.lit(None).cast("string").alias("source_id"), (F.substring(F.first("run_id"), 9, 2) != "13").alias("complete"))
    cuts = ["", "2024-01-08", "2024-01-20", "9"]
    # a run's rows and its end come in different batches, the end last
    parts = [df.where((F.col("run_id") >= a) & (F.col("run_id") < b)) for a, b in zip(cuts, cuts[1:], strict=False) for df in (rows, ends)]
    return _written(t, root, parts, lambda feed: miss_counter(feed, 2), False).withColumn("source_id", F.col("source_id").cast("long"))


@query("""with recursive e as (select user_id, cast(user_id as varchar) || '-' || cast(cast(floor((epoch_us(ts) - 1704067200000000) / 604800000000) as integer) as varchar) as item, epoch_us(ts) as at, event_type,
        row_number() over (partition by user_id, floor((epoch_us(ts) - 1704067200000000) / 604800000000) order by ts, event_id) as n from events),
    r as (select user_id, item, cast(0 as bigint) as n, cast(0 as bigint) as busy, 0 as attempts, 'pending' as state from (select distinct user_id, item from e)
      union all
      select r.user_id, r.item, e.n, case when e.at < r.busy then r.busy else e.at + case when e.event_type = 'view' then 300000000 else 60000000 end end, case when e.at < r.busy then r.attempts else r.attempts + 1 end,
        case when e.at < r.busy then r.state when e.event_type = 'purchase' then 'success' when e.event_type = 'signup' then 'skipped' when r.attempts + 1 >= 4 then 'deferred' else 'failed' end
      from r join e on e.item = r.item and e.n = r.n + 1 where r.state not in ('success', 'skipped', 'deferred')),
    i as (select user_id, item, max_by(state, n) as state from r group by 1, 2)
    select cast(user_id as varchar) as import_id, count(*) as discovered, count(*) filter (where state = 'success') as success, count(*) filter (where state = 'skipped') as skipped, count(*) filter (where state = 'deferred') as deferred, 'success' as outcome
    from i group by 1 having count(*) = count(*) filter (where state in ('success', 'skipped', 'deferred'))""")
def stream_outcomes(t: Tables) -> DataFrame:
    """Each user is an import and each week of theirs an item; each event claims the item, and all but views end the claim a minute later."""
    root = _folder(t)
    at = F.col("ts").cast("timestamp")
    week = F.floor((F.unix_micros(at) - 1704067200000000) / 604800000000).cast("int")
    e = t.events.select(F.col("user_id").cast("string").alias("import_id"), F.concat_ws("-", "user_id", week.cast("string")).alias("item_id"), F.col("event_id").cast("string").alias("token"), "event_type", at.alias("at"))
    none = lambda kind: F.lit(None).cast(kind)
    claims = e.select("import_id", "item_id", F.lit("claim").alias("kind"), "token", none("string").alias("outcome"), none("long").alias("total"), "at")
    ends = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "skipped").otherwise("failed")
    outcomes = e.where("event_type <> 'view'").select("import_id", "item_id", F.lit("outcome").alias("kind"), "token", ends.alias("outcome"), none("long").alias("total"), (F.col("at") + F.expr("interval 1 minute")).alias("at"))
    first, last = e.agg(F.min("at"), F.max("at")).first()
    found = e.groupBy("import_id").agg(F.countDistinct("item_id").alias("total"))
    found = found.select("import_id", none("string").alias("item_id"), F.lit("discovered").alias("kind"), none("string").alias("token"), none("string").alias("outcome"), "total", F.lit(first).alias("at"))
    tick = t.spark.createDataFrame([(last + timedelta(days=1),)], "at timestamp").select(F.lit("none").alias("import_id"), none("string").alias("item_id"), F.lit("tick").alias("kind"), none("string").alias("token"), none("string").alias("outcome"), none("long").alias("total"), "at")
    every = claims.unionByName(outcomes)
    middle = first + (last - first) / 2
    parts = [found, every.where(F.col("at") < F.lit(middle)), every.where(F.col("at") >= F.lit(middle)), tick]
    return _written(t, root, parts, lambda feed: finished_imports(item_states(feed)))


@query("""with runs as (select source_id, 1 as seen from cur_obs union all select source_id, 0 from prev_index where source_id not in (select source_id from cur_obs)),
    n as (select (select count(*) from cur_obs) as r2, (select count(*) from runs) as known, (select count(*) from cur_obs where k % 10 = 1) as r3),
    d as (select known >= 100 and known - r3 >= 100 and r3 < 0.5 * known as blocked from n)
    select r.source_id, case when blocked then case when seen = 1 then 'active' else 'missing' end when c.k % 10 = 1 then 'active' else 'missing' end as status, case when blocked then 1 - seen when c.k % 10 = 1 then 0 else 2 - seen end as miss_count, case when blocked then 'r2' else 'r3' end as version
    from runs r cross join d left join cur_obs c on c.source_id = r.source_id""", ("prev_index", "cur_obs"))
def stream_sync(t: Tables) -> DataFrame:
    """Runs dealt over several batches with their markers apart; one is a catastrophe, one empty, and one never ends."""
    root = _folder(t)
    cols = ["source_id", "fingerprint", "category_id", "category_path_ids"]
    at = lambda hour: F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp").alias("at")

    def rows(run: str, hour: int, df: DataFrame) -> DataFrame:
        return df.select(F.lit(run).alias("run_id"), at(hour), *cols, F.lit(None).cast("long").alias("expected"), F.lit(None).cast("int").alias("failures"))

    def end(run: str, hour: int, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("expected")).select(F.lit(run).alias("run_id"), at(hour), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols], "expected", F.lit(0).alias("failures"))

    prev, cur, few = t.prev_index.select(*cols, "k"), t.cur_obs.select(*cols, "k"), t.cur_obs.where("k % 10 = 1").select(*cols, "k")
    parts = [rows("r1", 1, prev.where("k % 3 < 2")), rows("r1", 1, prev.where("k % 3 = 2")).unionByName(end("r1", 1, prev))]
    parts += [end("r2", 2, cur).unionByName(rows("r2", 2, cur.where("k % 2 = 0"))), rows("r2", 2, cur.where("k % 2 = 1")).unionByName(rows("r2", 2, cur.where("k % 10 = 3")))]  # the end first, and repeated rows
    parts += [rows("r3", 3, few).unionByName(end("r3", 3, few)), end("r4", 4, cur.where("false")).unionByName(rows("r5", 4, cur.where("k % 2 = 0")))]
    _fed(t, root, parts, lambda feed: sync.sync_stream(feed, f"{root}/index", f"{root}/check", buckets=8))
    return sync.promoted_index(t.spark, f"{root}/index").select("source_id", "status", "miss_count", "version")
