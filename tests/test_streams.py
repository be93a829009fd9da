"""Streams: runs over several micro-batches, inferred absence, leases, and what comes late, twice or never."""

from __future__ import annotations

from datetime import datetime, timedelta
from unittest.mock import Mock

import pandas as pd

from tidemark.plans import registry, streams
from tidemark.streaming import sync
from tidemark.streaming.misses import Misses, miss_counter
from tidemark.streaming.outcomes import finished_imports, item_states
from tidemark.streaming.runs import Gatherer
from tidemark.streaming.stateful import PROVIDER, state_store

OBSERVATIONS = "run_id string, at timestamp, source_id string, fingerprint string, category_id string, category_path_ids array<string>, expected long, failures int"
BEGIN = datetime(2024, 1, 1)


def feed(spark, path, schema, files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def observed(run, hour, ids):
    return [(run, BEGIN + timedelta(hours=hour), str(i), "f", "c", ["c"], None, None) for i in ids]


def ended(run, hour, n, failures=0):
    return [(run, BEGIN + timedelta(hours=hour), None, None, None, None, n, failures)]


def index_of(spark, root):
    return sorted((r["source_id"], r["status"], r["miss_count"], r["version"]) for r in sync.promoted_index(spark, root).collect())


def test_a_run_over_five_batches(spark, tmp_path):
    rows = observed("r1", 0, range(60))
    second = observed("r2", 1, range(50)) + ended("r2", 1, 50)
    dealt = [rows[:20], rows[20:30], ended("r1", 0, 60) + rows[:5], rows[30:55], rows[55:], second, observed("r3", 2, range(9))]
    whole = [[*rows, *ended("r1", 0, 60)], second]
    for name, files in (("dealt", dealt), ("whole", whole)):
        sync.sync_stream(feed(spark, f"{tmp_path}/{name}", OBSERVATIONS, files), f"{tmp_path}/{name}-index", f"{tmp_path}/{name}-check", shards=3, buckets=4).awaitTermination()
    assert index_of(spark, f"{tmp_path}/dealt-index") == index_of(spark, f"{tmp_path}/whole-index") == sorted((str(i), "active" if i < 50 else "missing", int(i >= 50), "r2") for i in range(60))
    assert sync.promoted_runs(spark, f"{tmp_path}/dealt-index") == ["r1", "r2"]
    # the same feed once more, as after a lost checkpoint
    again = spark.readStream.schema(OBSERVATIONS).parquet(f"{tmp_path}/dealt")
    sync.sync_stream(again, f"{tmp_path}/dealt-index", f"{tmp_path}/check-2", shards=3, buckets=4).awaitTermination()
    assert index_of(spark, f"{tmp_path}/dealt-index") == index_of(spark, f"{tmp_path}/whole-index")
    assert "HDFS" in spark.conf.get(PROVIDER)


def test_a_run_waits_while_others_go(spark, tmp_path):
    """r3 has ended, but lacks rows while r2 is promoted and r1's last rows come late; a run's id may be any text."""
    files = [observed("r1", 0, range(20)) + ended("r1", 0, 20), observed("r3: a/b%", 1, range(15)) + ended("r3: a/b%", 1, 18), observed("r2", 1, range(19)) + ended("r2", 1, 19), observed("r1", 1, [40])]
    files += [observed("r3: a/b%", 2, range(15, 18))]
    root = f"{tmp_path}/index"
    sync.sync_stream(feed(spark, f"{tmp_path}/feed", OBSERVATIONS, files), root, f"{tmp_path}/check", shards=2, buckets=4).awaitTermination()
    assert sync.promoted_runs(spark, root) == ["r1", "r2", "r3: a/b%"]
    assert index_of(spark, root) == sorted((str(i), "active" if i < 18 else "missing", {18: 1, 19: 2}.get(i, 0), "r3: a/b%") for i in range(20))
    assert spark.read.schema(sync.STAGED).parquet(f"{root}/staged").where("kind = 'row'").isEmpty()


def test_blocked_and_unfinished_runs(spark, tmp_path):
    files = [observed("r1", 0, range(300)) + ended("r1", 0, 300), observed("r2", 1, range(10)) + ended("r2", 1, 10)]  # a catastrophe
    files += [observed("r3", 2, range(290)) + ended("r3", 2, 299), observed("r4", 2, range(280)), ended("r5", 2, 0)]  # lacks rows, never ends, is empty
    files += [observed("r6", 3, range(295)) + ended("r6", 3, 295, failures=2), observed("r7", 40, range(285)) + ended("r7", 40, 285)]
    root = f"{tmp_path}/index"
    sync.sync_stream(feed(spark, f"{tmp_path}/feed", OBSERVATIONS, files), root, f"{tmp_path}/check", shards=2, buckets=4, patience_ms=24 * 3_600_000).awaitTermination()
    headers = {r["run_id"]: (r["outcome"], r["reason"], r["observed"], r["known"]) for r in sync.run_headers(spark, root).collect()}
    assert headers.pop("r1")[0] == "proceed" and headers.pop("r7") == ("proceed", None, 285, 300)
    assert headers == {"r2": ("quarantine", "sync_catastrophic_volume_drop", 10, 300), "r5": ("quarantine", "sync_scan_empty", 0, 300), "r6": ("preserve_last_known_good", "sync_scan_has_disqualifying_failures", 295, 300)}
    assert sync.promoted_runs(spark, root) == ["r1", "r7"]
    assert not [r for r in spark.read.schema(sync.STAGED).parquet(f"{root}/staged").collect() if r["kind"] == "row"]


def test_inferred_absence(spark, tmp_path):
    schema = "scope string, run_id string, source_id string, complete boolean"
    seen = lambda run, ids: [("s", run, i, None) for i in ids]
    end = lambda run, ok=True: [("s", run, None, ok)]
    files = [seen("1", "abc") + end("1"), seen("2", "a"), seen("2", "aa"), end("2") + seen("3", "b"), end("3", False), seen("4", "a") + end("4"), end("2") + seen("1", "c"), seen("5", "c") + end("5")]
    out = miss_counter(feed(spark, f"{tmp_path}/feed", schema, files), 2, shards=3)
    with state_store(spark, idle_batches=False):
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["run_id"], r["source_id"], r["type"], r["miss_count"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    # 3 is incomplete: it restores b, and c doesn't miss again; what comes of 1 and 2 after the end of 4 is late
    assert got == [("2", "b", "MISSING", 1), ("2", "c", "MISSING", 1), ("3", "b", "RESTORED", 0), ("4", "b", "MISSING", 1), ("4", "c", "REMOVED", 2), ("5", "a", "MISSING", 1), ("5", "b", "REMOVED", 2), ("5", "c", "RESTORED", 0)]


def test_outcomes_fold_to_one_event(spark, tmp_path):
    schema = "import_id string, item_id string, kind string, token string, outcome string, total long, at timestamp"
    at = lambda m: BEGIN + timedelta(minutes=m)
    claim = lambda m, item, token: ("i", item, "claim", token, None, None, at(m))
    outcome = lambda m, item, token, what: ("i", item, "outcome", token, what, None, at(m))
    files = [[("i", None, "discovered", None, None, 4, at(0)), ("j", None, "discovered", None, None, 1, at(0))], [claim(1, "a", "t1"), claim(2, "a", "t2"), outcome(2, "a", "t2", "success"), claim(1, "b", "t3")]]
    files += [[outcome(3, "a", "t1", "success"), outcome(3, "a", "t1", "success"), claim(7, "b", "t4"), outcome(8, "b", "t4", "skipped")]]
    files += [[r for k in range(4) for r in (claim(10 + 10 * k, "c", f"c{k}"), outcome(11 + 10 * k, "c", f"c{k}", "failed"))], [r for k in range(4) for r in [claim(50 + 10 * k, "d", f"d{k}")]]]
    files += [[("none", None, "tick", None, None, None, at(200))]]  # d's last lease runs out by a timer
    states = item_states(feed(spark, f"{tmp_path}/feed", schema, files), lease_ms=300_000)
    with state_store(spark):
        query = finished_imports(states).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [("i", 4, 1, 1, 2, "success")]


class CountedList(list):
    """A list state that counts its calls: each is a round trip."""

    calls = 0

    def get(self):
        CountedList.calls += 1
        return iter([*self])

    def put(self, rows):
        CountedList.calls += 1
        self[:] = rows

    def appendList(self, rows):  # noqa: N802
        CountedList.calls += 1
        self.extend(rows)

    def clear(self):
        CountedList.calls += 1
        self[:] = []


def test_misses_of_many_items_take_few_calls():
    state, runs = Misses(2, 1000), [f"r{i}" for i in range(4)]
    state.live, state.removed, state.waiting = CountedList(), CountedList(), CountedList()
    state.last = Mock(**{"exists.return_value": False})
    items = [(r, str(i), None) for r in runs[:1] for i in range(3000)] + [("r3", "7", None)]
    df = pd.DataFrame(items + [(r, None, True) for r in runs], columns=["run_id", "source_id", "complete"])
    out = pd.concat(state.handleInputRows(("s", 0), iter([df]), Mock(**{"getCurrentProcessingTimeInMs.return_value": 5})))
    assert out["type"].value_counts().to_dict() == {"MISSING": 3000, "REMOVED": 3000, "RESTORED": 1}
    assert CountedList.calls < 20 and {s for ids, _ in state.removed for s in ids} == {str(i) for i in range(3000)} - {"7"}


def test_a_gathered_run_takes_few_calls():
    """30,000 rows in frames of 1,000 and their marker in the middle; those before it lie in the state."""
    state, now = Gatherer(1000), Mock()
    state.handle, state.held = Mock(), CountedList()
    state.ended = Mock(**{"exists.return_value": False})
    CountedList.calls = 0
    frame = lambda items: pd.DataFrame({"at_ms": 5, "payload": items, "expected": [None] * len(items), "failures": None})
    rows = [str(i) for i in range(30_000)]
    parts = [frame(rows[i : i + 1000]) for i in range(0, 30_000, 1000)]
    assert not [*state.handleInputRows(("r", 0), iter(parts[:25]), now)] and len(state.held) == 3
    state.ended = Mock(**{"exists.return_value": True, "get.return_value": (False,)})
    mark = pd.DataFrame({"at_ms": [6], "payload": ["{}"], "expected": [30_000], "failures": [1]})
    out = pd.concat(state.handleInputRows(("r", 0), iter([parts[25], mark, *parts[26:]]), now))
    assert sorted(out.loc[out["kind"] == "row", "payload"]) == sorted(rows)
    assert out.loc[out["kind"] == "end", ["expected", "failures"]].values.tolist() == [[30_000, 1]]
    assert CountedList.calls < 10 and not state.held


def test_batches_of_stream_sync_do_not_grow_with_its_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "tables"
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").repartition(12).write.parquet(f"{folder}/part.parquet")
    monkeypatch.setattr(streams, "_folder", lambda t: f"{tmp_path}/stream")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task a file
    try:
        assert registry.queries()["stream_sync"](spark, str(folder)).count() > 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    batches = [p for p in (tmp_path / "stream" / "check" / "commits").iterdir() if p.name.isdigit()]
    assert len(batches) <= 12
