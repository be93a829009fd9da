"""The synchronisation as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ranking import latest_per_key
from tidemark.operators.sync import Policy, decide_safety
from tidemark.sources.commits import latest
from tidemark.sources.indexes import ListingIndex
from tidemark.streaming.runs import GATHERED, gather_runs
from tidemark.streaming.stateful import state_store

OBSERVED = "source_id string, fingerprint string, category_id string, category_path_ids array<string>"


def dedup_messages(stream: DataFrame, keys: list[str], time: str, watermark: str = "1 hour") -> DataFrame:
    """The first message of each key within the watermark; late repeats beyond it are new messages."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def reject_late_runs(batch: DataFrame, promoted: str | None) -> DataFrame:
    """Rows of runs that come after the promoted one."""
    return batch if promoted is None else batch.where(F.col("run_id") > promoted)


def promoted_runs(spark: SparkSession, index_root: str) -> list[str]:
    """The ids of the last runs that were promoted into the index below index_root, in order."""
    return latest(spark, index_root)[1].get("labels", [])


def promoted_index(spark: SparkSession, index_root: str) -> DataFrame:
    """The index, with the run that it comes from as version."""
    index = ListingIndex(spark, index_root)
    return index.table().withColumn("version", F.lit(index.labels[-1]))


STAGED = f"{GATHERED}, batch long"


def write_header(spark: SparkSession, root: str, run: str, outcome: str, reason: str | None, observed: int, known: int) -> None:
    """One row on a run below root/headers, whatever became of it."""
    row = spark.createDataFrame([(run, outcome, reason, observed, known)], "run_id string, outcome string, reason string, observed long, known long")
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/headers/of={run}")


def run_headers(spark: SparkSession, index_root: str) -> DataFrame:
    """run_id, outcome, reason, observed, known of each run that was decided."""
    return spark.read.parquet(f"{index_root}/headers").drop("of")


def _forget_staged(rows: DataFrame) -> None:
    """Remove the folders of the staged rows of a run: one for each batch that brought any."""
    spark = rows.sparkSession
    for (folder,) in rows.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sync_stream(source: DataFrame, index_root: str, checkpoint: str, policy: Policy = Policy(), threshold: int = 3, delay: str = "1 hour", patience_ms: int = 86_400_000, shards: int = 32, buckets: int = 64) -> StreamingQuery:
    """Compare each run of a stream of observations (run_id, at, source_id, fingerprint, category_id, category_path_ids) with
    the index below index_root (a ListingIndex of so many buckets), and add what changed if the run may be trusted.

    A run may be dealt over any number of micro-batches: its rows are held in keyed state until the marker comes, a row with
    ``expected`` (its number of distinct items) and ``failures``, then staged below index_root/staged, and compared once as
    many items are there. Runs go in the order of their ids; those not after the promoted one are dropped, so that a
    replayed batch changes nothing. The safety decision is made once a run, on its counts; a run that it blocks (empty, a
    catastrophic drop, failures) or that hasn't become complete in ``patience_ms`` of event time after its first row leaves the index as it
    is. Each decision leaves a header (run_headers).
    """

    def settle(spark: SparkSession, run: str) -> bool:
        """Whether the run was promoted."""
        rows = spark.read.schema(STAGED).parquet(f"{index_root}/staged").where(F.col("run_id") == run)
        item = F.from_json("payload", OBSERVED)
        seen = rows.where("kind = 'row'").select(item.alias("o")).select("o.*").dropDuplicates(["source_id"])
        distinct = F.count_distinct(F.struct(item["source_id"])).alias("observed")  # a struct, as null is an item too
        each = rows.where("kind = 'row'").agg(distinct)
        marks = rows.where("kind <> 'row'").agg(F.max("expected").alias("expected"), F.max("failures").alias("failures"), F.bool_or(F.col("kind") == "expired").alias("expired"))
        on = marks.crossJoin(each).first()
        observed = on["observed"]
        complete = on["expected"] == observed
        if not complete and not on["expired"]:
            return False
        index = ListingIndex(spark, index_root, buckets)
        known = index.table().where("status <> 'deleted'").count()
        scan = spark.createDataFrame([(run, complete, on["failures"] or 0, observed, known)], "scope string, complete boolean, failures int, observed long, known long")
        decision = decide_safety(scan, policy).first()
        ok = decision["outcome"] == "proceed"
        if ok:
            index.promote(seen, F.current_timestamp(), threshold, run)
        index.close()
        write_header(spark, index_root, run, decision["outcome"], decision["reason"], observed, known)
        _forget_staged(rows)
        return ok

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        path = f"{index_root}/staged/batch={number}"
        df.write.mode("overwrite").partitionBy("run_id").parquet(path)
        came = spark.read.schema(GATHERED).parquet(path)
        for (run,) in came.select("run_id").distinct().orderBy("run_id").collect():  # a row a run
            now = (promoted_runs(spark, index_root) or [None])[-1]
            if reject_late_runs(came.where(F.col("run_id") == run), now).isEmpty():
                _forget_staged(spark.read.schema(STAGED).parquet(f"{index_root}/staged").where(F.col("run_id") == run))
            else:
                settle(spark, run)

    gathered = gather_runs(source, "source_id", ["source_id", "fingerprint", "category_id", "category_path_ids"], delay, patience_ms, shards)
    with state_store(source.sparkSession):
        return gathered.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_outcomes(attempts: DataFrame, most: int = 4) -> DataFrame:
    """item, state, attempt: the last attempt of each item; a retry after ``most`` attempts is deferred. The batch form of outcomes.item_states."""
    last = latest_per_key(attempts.select("item", "attempt", "outcome"), ["item"], ["attempt"])
    state = F.when((F.col("outcome") == "retry") & (F.col("attempt") >= most), "deferred").otherwise(F.col("outcome"))
    return last.select("item", state.alias("state"), "attempt")
