"""Synchronisation by snapshot diff: safety decisions, typed events, staging, promotion, scopes, ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_ws
from tidemark.operators.ranking import global_positions, top_n

#: Event types in their order.
EVENTS = ("NEW", "RESTORED", "CHANGED_MOVED", "CHANGED", "MOVED", "MISSING", "REMOVED")

# -- normal forms ---------------------------------------------------------------------------------------------------


def _blank(c: str) -> Column:
    return F.nullif(clean_ws(F.col(c)), F.lit(""))


def normalise_index(rows: DataFrame, path_json: str | None = None) -> DataFrame:
    """The last known good index in its normal form: blanks null, statuses and counters within their bounds; a path that
    is no JSON array of strings fails the job."""
    out = rows
    if path_json:
        parsed = F.from_json(path_json, "array<string>")
        out = out.withColumn("category_path_ids", F.when(F.col(path_json).isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.raise_error(F.lit("path is no JSON array")).cast("array<string>")))).drop(path_json)
    status = F.lower(clean_ws(F.col("status")))
    return out.withColumns({"source_id": clean_ws(F.col("source_id")), "category_id": _blank("category_id"), "detail_fingerprint": _blank("detail_fingerprint"), "status": F.when(status.isin("active", "missing", "deleted"), status).otherwise("active"), "miss_count": F.greatest(F.coalesce("miss_count", F.lit(0)), F.lit(0))})


def normalise_observations(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source_id": clean_ws(F.col("source_id")), "category_id": _blank("category_id")})


# -- safety ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    least_known: int = 100
    least_drop: int = 100
    least_ratio: float = 0.5


def decide_safety(scans: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """For each row of scans (scope, complete, failures, observed, known): outcome, reason and what the run may do.

    The names of reasons and outcomes are fixed values.
    """
    drop = F.greatest(F.col("known") - F.col("observed"), F.lit(0))
    ratio = F.when(F.col("known") > 0, F.least(F.lit(1.0), F.col("observed") / F.col("known")))
    reason = (
        F.when(~F.col("complete"), "sync_scan_incomplete").when(F.col("failures") > 0, "sync_scan_has_disqualifying_failures").when(F.col("observed") == 0, "sync_scan_empty")
        .when((F.col("known") >= policy.least_known) & (drop >= policy.least_drop) & (ratio < policy.least_ratio), "sync_catastrophic_volume_drop")
    )
    out = scans.withColumn("drop_count", drop).withColumn("remaining_ratio", ratio).withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNull(), "proceed").when(F.col("reason").isin("sync_scan_empty", "sync_catastrophic_volume_drop"), "quarantine").otherwise("preserve_last_known_good")
    out = out.withColumn("outcome", outcome)
    ok = F.col("outcome") == "proceed"
    return out.withColumns({"allow_missing": ok, "allow_removal": ok, "preserve_last_known_good": ~ok, "quarantine": F.col("outcome") == "quarantine", "cursor_promotion": F.when(ok, "after_verification").otherwise("blocked")})


def scan_coverage(pages: DataFrame) -> DataFrame:
    """complete: every scope of a scan (scope_id, page, item) ended by itself.

    A scope ended if its last page brought no item that an earlier page hadn't. Rows without an item stand for an empty page.
    """
    first = pages.where("item is not null").groupBy("scope_id", "item").agg(F.min("page").alias("page"))
    new = first.groupBy("scope_id", "page").agg(F.count("*").alias("new_items"))
    seen = pages.select("scope_id", "page").distinct().join(new, ["scope_id", "page"], "left")
    last = seen.groupBy("scope_id").agg(F.max("page").alias("last_page"), F.max_by(F.coalesce("new_items", F.lit(0)), "page").alias("new_on_last"))
    return last.select("scope_id", "last_page", (F.col("new_on_last") == 0).alias("natural_end"))


# -- deltas ---------------------------------------------------------------------------------------------------------


def check_unique(df: DataFrame, key: str) -> None:
    """Raises if a key repeats."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")


def plan_delta(prev: DataFrame, cur: DataFrame, threshold: int = 3, infer_missing: bool | Column = True) -> DataFrame:
    """source_id, type, needs_detail, miss_count, reason of each change from prev to cur; unchanged rows give none.

    One full join on the source id; categories are compared null-safe and paths by value.
    """
    both = prev.select("source_id", F.struct("fingerprint", "category_id", "category_path_ids", "detail_fingerprint", "status", "miss_count").alias("p")).join(cur.select("source_id", F.struct("fingerprint", "category_id", "category_path_ids").alias("c")), "source_id", "full_outer")
    kind, misses, reason = change_of(F.col("p"), F.col("c"), threshold, infer_missing)
    events = both.select("source_id", kind.alias("type"), misses.alias("miss_count"), reason.alias("reason"))
    return events.where("type is not null").withColumn("needs_detail", F.col("type").isin("NEW", "RESTORED", "CHANGED", "CHANGED_MOVED"))


def change_of(p: Column, c: Column, threshold: int = 3, infer_missing: bool | Column = True) -> tuple[Column, Column, Column]:
    """Type, misses and reason of the change from an index row p to an observation c, either null where it is absent."""
    moved = ~p["category_id"].eqNullSafe(c["category_id"]) | ~p["category_path_ids"].eqNullSafe(c["category_path_ids"])
    changed = ~p["fingerprint"].eqNullSafe(c["fingerprint"])
    pending = F.coalesce(p["detail_fingerprint"], F.lit("")) == ""
    absence = F.lit(infer_missing) if isinstance(infer_missing, bool) else infer_missing
    misses = p["miss_count"] + 1
    gone = c.isNull() & absence & (p["status"] != "deleted")
    kind = (
        F.when(gone, F.when(misses >= max(2, int(threshold or 3)), "REMOVED").otherwise("MISSING")).when(c.isNull(), None).when(p.isNull(), "NEW").when(p["status"].isin("missing", "deleted"), "RESTORED")
        .when(changed & moved, "CHANGED_MOVED").when(changed | pending, "CHANGED").when(moved, "MOVED")
    )
    reason = F.when(c.isNotNull() & p.isNotNull() & p["status"].isin("active"), F.when(changed, "listing-changed").when(pending, "detail-pending"))
    return kind, F.when(gone, misses), reason


def plan_safe_delta(prev: DataFrame, cur: DataFrame, scan: DataFrame, threshold: int = 3, policy: Policy = Policy()) -> DataFrame:
    """plan_delta with the outcome of the run's safety decision: absence counts, and details are asked for, only if it proceeds.

    scan is one row (complete, failures); known and observed are counted here.
    """
    known = prev.agg(F.count_if(F.col("status") != "deleted").alias("known"))
    decision = decide_safety(scan.crossJoin(known).crossJoin(cur.agg(F.count("*").alias("observed"))).withColumn("scope", F.lit("all")), policy)
    row = F.broadcast(decision.select("outcome"))  # one row
    events = plan_delta(prev, cur, threshold, True).crossJoin(row)
    ok = F.col("outcome") == "proceed"
    return events.where(ok | ~F.col("type").isin("MISSING", "REMOVED")).withColumn("needs_detail", F.col("needs_detail") & ok)


def event_rank(kind: Column) -> Column:
    rank = F.lit(len(EVENTS))
    for i, e in reversed([*enumerate(EVENTS)]):
        rank = F.when(kind == e, i).otherwise(rank)
    return rank


def order_events(events: DataFrame) -> DataFrame:
    return events.withColumn("event_rank", event_rank(F.col("type"))).orderBy("event_rank", "source_id")


def event_counts(events: DataFrame) -> DataFrame:
    """One row: events by type, with changed and moved counting the mixed type."""
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    return events.agg(*[n(e).alias(e.lower()) for e in EVENTS], n("CHANGED", "CHANGED_MOVED").alias("changed_total"), n("MOVED", "CHANGED_MOVED").alias("moved_total"), F.count("*").alias("total"))


def detail_queue(events: DataFrame) -> DataFrame:
    return order_events(events.where("needs_detail")).select("source_id", "event_rank")


def baseline_events(cur: DataFrame, prev: DataFrame, products: DataFrame) -> DataFrame:
    """Observed rows that the index lacks but whose product is public already: they are taken as they are."""
    rows = cur.join(prev, "source_id", "left_anti").join(products.select("source_id"), "source_id", "left_semi")
    return rows.select("source_id", F.lit("BASELINE").alias("type"), F.sha2(F.concat(F.lit("baseline|"), "source_id", F.lit("|"), "fingerprint"), 256).alias("detail_fingerprint"))


# -- stage, verify, promote -----------------------------------------------------------------------------------------


def stage_run(root: str, run_id: str, tables: dict[str, DataFrame], outcome: str, reason: str | None = None) -> dict[str, int]:
    """Write a run's tables below root/run_id and return their counts; a blocked run writes none. Either writes its header
    (run_headers): run_id, outcome, reason, tables with their counts."""
    counts = {}
    for name, df in tables.items() if outcome == "proceed" else ():
        path = f"{root}/run_id={run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        counts[name] = df.sparkSession.read.parquet(path).count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(outcome, reason, counts)], "outcome string, reason string, tables map<string,long>").coalesce(1).write.mode("overwrite").parquet(f"{root}/_headers/run_id={run_id}")
    return counts


def run_headers(spark: SparkSession, root: str) -> DataFrame:
    """run_id, outcome, reason, tables of all runs staged below root, blocked ones included."""
    return spark.read.schema("outcome string, reason string, tables map<string,long>, run_id string").parquet(f"{root}/_headers")


def seal_run(staged: DataFrame) -> DataFrame:
    """state of each run (run_id, outcome, expected, actual, details_pending)."""
    state = (
        F.when(F.col("outcome") == "quarantine", "quarantined").when(F.col("outcome") != "proceed", "preserved").when(F.col("expected") != F.col("actual"), "failed")
        .when(F.col("details_pending") > 0, "details_pending").otherwise("planned")
    )
    return staged.withColumn("state", state).withColumn("verified", F.col("state") == "planned")


def promote(index: DataFrame, observations: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The next index: observed rows active with no misses, changed_at moved only by an event; new rows without details;
    missing and removed rows with their status and counter; all others as they are. index has changed_at."""
    o = observations.select("source_id", F.struct("fingerprint", "category_id", "category_path_ids").alias("o"))
    e = events.select("source_id", F.struct("type", F.col("miss_count").alias("misses")).alias("e"))
    i = index.select("source_id", F.struct(*[c for c in index.columns if c != "source_id"]).alias("i"))
    all3 = i.join(o, "source_id", "full_outer").join(e, "source_id", "left")
    i, o, e = F.col("i"), F.col("o"), F.col("e")
    kind, misses = F.when(e.isNotNull(), e["type"]), F.when(e.isNotNull(), e["misses"])
    return all3.select("source_id", *promoted_row(i, o, kind, misses, now))


def promoted_row(i: Column, o: Column, kind: Column, misses: Column, now: Column) -> list[Column]:
    """The columns of the next index row, from the old row i, the observation o and the event between them (null for none)."""
    took = lambda c: F.when(o.isNotNull(), o[c]).otherwise(i[c]).alias(c)
    gone = kind.isin("MISSING", "REMOVED")
    status = F.when(o.isNotNull(), "active").when(gone, F.when(kind == "REMOVED", "deleted").otherwise("missing")).otherwise(i["status"])
    return [
        took("fingerprint"), took("category_id"), took("category_path_ids"), i["detail_fingerprint"].alias("detail_fingerprint"), status.alias("status"),
        F.when(o.isNotNull(), 0).when(gone, misses).otherwise(i["miss_count"]).cast("int").alias("miss_count"), F.when(kind.isNotNull(), now).otherwise(i["changed_at"]).alias("changed_at"),
    ]


def apply_delta(products: DataFrame, events: DataFrame, details: DataFrame) -> DataFrame:
    """Outcome and new row of each product and event: REMOVED goes, MOVED changes the category only, an event without a
    detail is retried later, one whose detail is no product goes, one without name or media is deferred, others replace
    the product. New products come first.

    products: source_id, name, category_id, images, position; events: source_id, type, category_id; details: source_id, kind, name, images.
    """
    d = details.select("source_id", F.struct("kind", "name", "images").alias("d"))
    ev = events.select("source_id", F.struct("type", "category_id").alias("e")).join(d, "source_id", "left")
    both = products.select("source_id", F.struct("name", "category_id", "images", "position").alias("p")).join(ev, "source_id", "full_outer")
    p, e, d = F.col("p"), F.col("e"), F.col("d")
    empty = (F.coalesce(d["name"], F.lit("")) == "") | (F.coalesce(d["images"], F.lit(0)) == 0)
    outcome = (
        F.when(e.isNull(), "kept").when(e["type"] == "REMOVED", F.when(p.isNotNull(), "removed").otherwise("ignored")).when(e["type"] == "MISSING", "kept").when(e["type"] == "MOVED", F.when(p.isNotNull(), "moved").otherwise("ignored"))
        .when(d.isNull(), "retry").when(d["kind"] != "product", "not_product").when(empty, "deferred").when(p.isNull(), "created").otherwise("updated")
    )
    out = both.withColumn("outcome", outcome)
    took = F.col("outcome").isin("created", "updated")
    rows = out.select("source_id", "outcome", F.when(took, d["name"]).otherwise(p["name"]).alias("name"), F.when(took | (F.col("outcome") == "moved"), e["category_id"]).otherwise(p["category_id"]).alias("category_id"), F.when(took, d["images"]).otherwise(p["images"]).alias("images"), p["position"].alias("_at"))
    gone = F.col("outcome").isin("removed", "not_product", "ignored") | (F.col("_at").isNull() & (F.col("outcome") != "created"))
    return rows.withColumn("alive", ~gone)


# -- scopes and ledgers ---------------------------------------------------------------------------------------------


def reconcile_scope(state: DataFrame, members: DataFrame, observed: DataFrame, scope_id: str, complete: bool, catalog: bool = False, legacy: tuple[str, ...] = ()) -> DataFrame:
    """public_id, change of a scan of one scope: new, restored, updated, detached, unobserved, removed.

    state: public_id, status, content_hash; members: scope_id, public_id; observed: public_id, content_hash. A complete
    catalog scan drops the legacy scopes before it looks for other scopes that still list an item.
    """
    s = state.select("public_id", F.struct("status", "content_hash").alias("s"))
    o = observed.select("public_id", F.col("content_hash").alias("h"))
    seen = o.join(s, "public_id", "left").select("public_id", F.when(F.col("s").isNull(), "new").when(F.col("s.status") == "removed", "restored").when(F.col("s.content_hash") != F.col("h"), "updated").alias("change")).where("change is not null")
    had = members.where(F.col("scope_id") == scope_id).select("public_id").distinct()
    lost = had.join(o, "public_id", "left_anti")
    gone = lost.select("public_id", F.lit("detached" if complete else "unobserved").alias("change"))
    out = seen.unionByName(gone)
    if not complete:
        return out
    others = members.where(F.col("scope_id") != scope_id)
    orphans = lost
    if catalog:
        dropped = members.where(F.col("scope_id").isin(*legacy)).select("public_id").distinct().join(o, "public_id", "left_anti") if legacy else None
        others = others.where(~F.col("scope_id").isin(*legacy)) if legacy else others
        orphans = lost.unionByName(dropped).distinct() if dropped is not None else lost
    active = state.where("status = 'active'").select("public_id")
    removed = orphans.join(others.select("public_id"), "public_id", "left_anti").join(active, "public_id", "left_semi")
    return out.unionByName(removed.select("public_id", F.lit("removed").alias("change")))


def migrate_ledger_v1(state: DataFrame, scope_id: str) -> DataFrame:
    """Members of the one scope that a ledger without scopes stands for: all active items."""
    return state.where("status = 'active'").select(F.lit(scope_id).alias("scope_id"), "public_id")


def load_initial_index(observations: DataFrame, now: Column) -> DataFrame:
    """A fresh index; an empty scan fails."""
    if observations.isEmpty():
        raise ValueError("the scan is empty")
    return observations.select("source_id", "fingerprint", "category_id", "category_path_ids", F.lit(None).cast("string").alias("detail_fingerprint"), F.lit("active").alias("status"), F.lit(0).alias("miss_count"), now.alias("changed_at"))


def change_report(events: DataFrame, names: DataFrame, top: int = 20) -> DataFrame:
    """type, total, names (the first ones), more: a change report by class."""
    named = events.join(names, "source_id", "left").select("type", F.coalesce("name", "source_id").alias("name"), "source_id")
    totals = named.groupBy("type").agg(F.count("*").alias("total"))
    listed = top_n(named, ["type"], ["name", "source_id"], top).groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return totals.join(listed, "type").select("type", "total", "names", F.greatest(F.col("total") - top, F.lit(0)).alias("more"))


def public_positions(products: DataFrame) -> DataFrame:
    """Positions of what is left after apply_delta: created ones first, then the old order."""
    alive = products.where("alive").withColumn("_old", F.col("_at").isNotNull())
    return global_positions(alive.drop("position"), ["_old", "_at", "source_id"]).drop("_old", "_at")
