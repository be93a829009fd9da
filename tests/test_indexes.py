"""The bucketed index against full promotions, and writers that meet."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sync
from tidemark.sources import commits, snapshots
from tidemark.sources.indexes import MOST_WRITES, ListingIndex

OBSERVED = "source_id string, fingerprint string, category_id string, category_path_ids array<string>"
DAY = "2024-01-01"


def held(df):
    return sorted(map(str, df.select("source_id", "fingerprint", "category_id", "category_path_ids", "detail_fingerprint", "status", "miss_count", "changed_at").collect()))


def test_random_deltas(spark, tmp_path):
    rng = random.Random(4)
    items = {str(i): (str(i), "f0", "c", ["c"]) for i in range(60)}
    index = ListingIndex(spark, str(tmp_path / "index"), 4)
    full = sync.load_initial_index(spark.createDataFrame([*items.values()], OBSERVED), F.lit(DAY).cast("timestamp")).withColumn("detail_fingerprint", F.lit("d")).withColumn("miss_count", F.col("miss_count").cast("int"))
    index.rewrite(full)
    expected = spark.createDataFrame(full.collect(), full.schema)
    for n in range(MOST_WRITES + 2):
        for i in rng.sample(sorted(items), 4):
            items[i] = (i, f"f{n}", rng.choice("cd"), ["c"])
        gone = set(rng.sample(sorted(items), 5))
        items[f"new{n}"] = (f"new{n}", "f", None, [])
        seen = spark.createDataFrame([v for k, v in items.items() if k not in gone], OBSERVED)
        now = F.lit(f"2024-02-{n + 1:02}").cast("timestamp")
        after = sync.promote(expected, seen, sync.plan_delta(expected, seen), now)
        before = set(held(expected))
        expected = spark.createDataFrame(after.collect(), after.schema)
        index.promote(seen, now)
        if len(index.writes) > 1:  # else it was compacted
            written = spark.table(index._opened(index.base)).where(F.col("_write") == index.writes[-1]).count()
            assert written == len(set(held(expected)) - before) < 60
        assert held(index.table()) == held(expected)
    assert len(index.writes) <= MOST_WRITES
    again = ListingIndex(spark, str(tmp_path / "index"), 99)
    assert again.buckets == 4 and held(again.table()) == held(expected)
    again.upsert(spark.createDataFrame([("1", "deleted"), ("x", "active")], "source_id string, status string"), ["status"])
    rows = {r["source_id"]: r for r in again.table().where("source_id in ('1', 'x')").collect()}
    assert rows["1"]["status"] == "deleted" and rows["1"]["fingerprint"] is not None and rows["x"]["fingerprint"] is None
    with pytest.raises(commits.Conflict):
        index.upsert(spark.createDataFrame([("2", "deleted")], "source_id string, status string"), ["status"])
    index.refresh()
    assert index.table().where("source_id = '2' and status = 'deleted'").isEmpty()  # what lost isn't read


def test_only_observations_are_shuffled(spark, tmp_path):
    index = ListingIndex(spark, str(tmp_path / "index"), 8)
    rows = sync.load_initial_index(spark.createDataFrame([(str(i), "f", "c", ["c"]) for i in range(50)], OBSERVED), F.lit(DAY).cast("timestamp"))
    index.rewrite(rows)
    index._add(index.table().limit(3))
    new = spark.createDataFrame([("1", "f")], "source_id string, g string")
    plan = index.table().hint("merge").join(new, "source_id", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "log")
    assert commits.latest(spark, root) == (0, {})
    assert [commits.commit(spark, root, 1, {"by": w}) for w in "ab"] == [True, False] and commits.latest(spark, root) == (1, {"by": "a"})
    rows = spark.range(3)
    root = str(tmp_path / "published")
    one = snapshots.publish_snapshot({"rows": rows}, root, "one")
    assert snapshots.publish_snapshot({"rows": rows.where("id > 0")}, root, "two", after=one) == one + 1
    with pytest.raises(commits.Conflict):
        snapshots.publish_snapshot({"rows": rows}, root, "late", after=one)
    assert snapshots.read_published(spark, root, "rows").count() == 2 and not (tmp_path / "published" / "v=late").exists()


def test_headers_of_runs(spark, tmp_path):
    sync.stage_run(str(tmp_path), "r1", {"rows": spark.range(3)}, "proceed")
    sync.stage_run(str(tmp_path), "r2", {"rows": spark.range(3)}, "quarantine", "sync_scan_empty")
    got = {r["run_id"]: (r["outcome"], r["reason"], r["tables"]) for r in sync.run_headers(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("proceed", None, {"rows": 3}), "r2": ("quarantine", "sync_scan_empty", {})} and not (tmp_path / "run_id=r2").exists()
