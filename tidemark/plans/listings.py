"""Queries of the synchronisation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import sync, tables
from tidemark.operators.counts import apply_counters as apply_counts
from tidemark.operators.ranking import latest_per_key, next_miss_count
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Tables
from tidemark.sources.indexes import ListingIndex
from tidemark.sources.shared import new_folder

DELTA = """delta as (select coalesce(p.source_id, c.source_id) as source_id,
    case when c.source_id is null then case when p.status = 'deleted' then null when p.miss_count + 1 >= 3 then 'REMOVED' else 'MISSING' end
         when p.source_id is null then 'NEW' when p.status in ('missing', 'deleted') then 'RESTORED'
         when p.fingerprint <> c.fingerprint and (p.category_id is distinct from c.category_id) then 'CHANGED_MOVED'
         when p.fingerprint <> c.fingerprint or coalesce(p.detail_fingerprint, '') = '' then 'CHANGED' when p.category_id is distinct from c.category_id then 'MOVED' end as type,
    case when c.source_id is null and p.status <> 'deleted' then p.miss_count + 1 end as miss_count,
    case when c.source_id is null or p.source_id is null or p.status in ('missing', 'deleted') then null when p.fingerprint <> c.fingerprint then 'listing-changed' when coalesce(p.detail_fingerprint, '') = '' then 'detail-pending' end as reason
    from prev_index p full join cur_obs c on p.source_id = c.source_id),
    events_of as (select source_id, type, miss_count, reason, type in ('NEW', 'RESTORED', 'CHANGED', 'CHANGED_MOVED') as needs_detail from delta where type is not null)"""
BOTH = ("prev_index", "cur_obs")


def _delta(t: Tables) -> DataFrame:
    return sync.plan_delta(t.prev_index, t.cur_obs)


@query(f"with {DELTA} select source_id, type, miss_count, reason, needs_detail, 'proceed' as outcome from events_of", BOTH)
def delta_events(t: Tables) -> DataFrame:
    scan = t.spark.createDataFrame([(True, 0)], "complete boolean, failures int")
    return sync.plan_safe_delta(t.prev_index, t.cur_obs, scan)


@query(f"with {DELTA} select source_id, type, miss_count, reason, false as needs_detail, 'preserve_last_known_good' as outcome from events_of where type not in ('MISSING', 'REMOVED')", BOTH)
def safe_delta_partial(t: Tables) -> DataFrame:
    scan = t.spark.createDataFrame([(False, 0)], "complete boolean, failures int")
    return sync.plan_safe_delta(t.prev_index, t.cur_obs, scan)


@query(f"with {DELTA} select source_id, type, miss_count, reason, false as needs_detail, 'quarantine' as outcome from events_of where type not in ('MISSING', 'REMOVED') and false union all select e.source_id, e.type, e.miss_count, e.reason, false, 'quarantine' from events_of e join cur_obs c on c.source_id = e.source_id where c.k % 10 = 1", BOTH)
def safe_delta_catastrophe(t: Tables) -> DataFrame:
    scan = t.spark.createDataFrame([(True, 0)], "complete boolean, failures int")
    return sync.plan_safe_delta(t.prev_index, t.cur_obs.where("k % 10 = 1"), scan)


@query(f"""with {DELTA} select {', '.join(f"count(*) filter (where type = '{e}') as {e.lower()}" for e in sync.EVENTS)}, count(*) filter (where type in ('CHANGED', 'CHANGED_MOVED')) as changed_total,
    count(*) filter (where type in ('MOVED', 'CHANGED_MOVED')) as moved_total, count(*) as total from events_of""", BOTH)
def delta_counts(t: Tables) -> DataFrame:
    return sync.event_counts(_delta(t))


@query(f"with {DELTA} select source_id, list_position(['NEW', 'RESTORED', 'CHANGED_MOVED', 'CHANGED', 'MOVED', 'MISSING', 'REMOVED'], type) - 1 as event_rank from events_of where needs_detail", BOTH)
def detail_queue(t: Tables) -> DataFrame:
    return sync.detail_queue(_delta(t))


@query("""with d as (select 'healthy' as scope, true as complete, 0 as failures, n as observed, known from (select count(*) as n from cur_obs), (select count(*) as known from prev_index where status <> 'deleted')
    union all select 'partial', false, 0, n, known from (select count(*) as n from cur_obs), (select count(*) as known from prev_index where status <> 'deleted')
    union all select 'failed', true, 2, n, known from (select count(*) as n from cur_obs), (select count(*) as known from prev_index where status <> 'deleted')
    union all select 'empty', true, 0, 0, known from (select count(*) as known from prev_index where status <> 'deleted')
    union all select 'catastrophic', true, 0, n, known from (select count(*) as n from cur_obs where k % 10 = 1), (select count(*) as known from prev_index where status <> 'deleted')),
    r as (select *, case when not complete then 'sync_scan_incomplete' when failures > 0 then 'sync_scan_has_disqualifying_failures' when observed = 0 then 'sync_scan_empty'
      when known >= 100 and greatest(known - observed, 0) >= 100 and least(1.0, observed / known) < 0.5 then 'sync_catastrophic_volume_drop' end as reason from d)
    select scope, observed, known, greatest(known - observed, 0) as drop_count, reason, case when reason is null then 'proceed' when reason in ('sync_scan_empty', 'sync_catastrophic_volume_drop') then 'quarantine' else 'preserve_last_known_good' end as outcome, reason is null as allow_removal from r""", BOTH)
def safety_decisions(t: Tables) -> DataFrame:
    known = t.prev_index.agg(F.count_if(F.col("status") != "deleted").alias("known"))
    n = t.cur_obs.agg(F.count("*").alias("all"), F.count_if(F.col("k") % 10 == 1).alias("few"))
    variants = t.spark.createDataFrame([("healthy", True, 0, "all"), ("partial", False, 0, "all"), ("failed", True, 2, "all"), ("empty", True, 0, "none"), ("catastrophic", True, 0, "few")], "scope string, complete boolean, failures int, which string")
    scans = variants.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(n)).withColumn("observed", F.when(F.col("which") == "all", F.col("all")).when(F.col("which") == "few", F.col("few")).otherwise(0))
    return sync.decide_safety(scans).select("scope", "observed", "known", "drop_count", "reason", "outcome", "allow_removal")


@query("select c.source_id, 'BASELINE' as type, sha256('baseline|' || c.source_id || '|' || c.fingerprint) as detail_fingerprint from cur_obs c where c.source_id not in (select source_id from prev_index) and c.k % 4 = 0", BOTH)
def baseline_events(t: Tables) -> DataFrame:
    public = t.cur_obs.where("k % 4 = 0").select("source_id")
    return sync.baseline_events(t.cur_obs, t.prev_index, public)


@query(f"""with {DELTA} select coalesce(p.source_id, c.source_id) as source_id, coalesce(c.fingerprint, p.fingerprint) as fingerprint, coalesce(c.category_id, p.category_id) as category_id, p.detail_fingerprint,
    case when c.source_id is not null then 'active' when e.type = 'REMOVED' then 'deleted' when e.type = 'MISSING' then 'missing' else p.status end as status,
    case when c.source_id is not null then 0 when e.type is not null then e.miss_count else p.miss_count end as miss_count, cast(case when e.type is not null then timestamp '2024-02-01' else timestamp '2024-01-01' end as timestamp) as changed_at
    from prev_index p full join cur_obs c on c.source_id = p.source_id left join events_of e on e.source_id = coalesce(p.source_id, c.source_id)""", BOTH)
def promote_index(t: Tables) -> DataFrame:
    index = t.prev_index.drop("k").withColumn("changed_at", F.lit("2024-01-01").cast("timestamp"))
    return sync.promote(index, t.cur_obs, _delta(t), F.lit("2024-02-01").cast("timestamp")).drop("category_path_ids")


@query(f"""with {DELTA} select coalesce(p.source_id, c.source_id) as source_id, coalesce(c.fingerprint, p.fingerprint) as fingerprint, coalesce(c.category_id, p.category_id) as category_id, p.detail_fingerprint,
    case when c.source_id is not null then 'active' when e.type = 'REMOVED' then 'deleted' when e.type = 'MISSING' then 'missing' else p.status end as status,
    case when c.source_id is not null then 0 when e.type is not null then e.miss_count else p.miss_count end as miss_count, cast(case when e.type is not null then timestamp '2024-02-01' else timestamp '2024-01-01' end as timestamp) as changed_at
    from prev_index p full join cur_obs c on c.source_id = p.source_id left join events_of e on e.source_id = coalesce(p.source_id, c.source_id)""", BOTH)
def promote_in_buckets(t: Tables) -> DataFrame:
    """promote_index on an index in hash buckets, to which only the rows that differ are added."""
    index = ListingIndex(t.spark, new_folder(t.spark, "index"), 16)
    index.rewrite(t.prev_index.withColumn("changed_at", F.lit("2024-01-01").cast("timestamp")))
    index.promote(t.cur_obs, F.lit("2024-02-01").cast("timestamp"))
    return index.table().drop("category_path_ids")


@query("""with runs as (select *, max(run) over () as last from scope_runs), cur as (select scope_id, member, content_hash from runs where run = last), old as (select distinct scope_id, member from runs where run < last and run >= last - 6),
    st as (select member as public_id, case when member % 9 = 0 then 'removed' else 'active' end as status, max(content_hash) as content_hash from runs where run < last and run >= last - 6 group by member),
    obs as (select member as public_id, content_hash from cur where scope_id = 'click'), lost as (select member as public_id from old where scope_id = 'click' and member not in (select public_id from obs))
    select o.public_id, case when s.public_id is null then 'new' when s.status = 'removed' then 'restored' else 'updated' end as change from obs o left join st s on s.public_id = o.public_id where s.public_id is null or s.status = 'removed' or s.content_hash <> o.content_hash
    union all select public_id, 'detached' from lost union all select l.public_id, 'removed' from lost l join st s on s.public_id = l.public_id where s.status = 'active' and l.public_id not in (select member from old where scope_id <> 'click')""", ("scope_runs",))
def scoped_reconcile(t: Tables) -> DataFrame:
    last = F.broadcast(t.scope_runs.agg(F.max("run").alias("last")))
    runs = t.scope_runs.crossJoin(last)
    old = runs.where("run < last and run >= date_sub(last, 6)")
    state = old.groupBy(F.col("member").alias("public_id")).agg(F.max("content_hash").alias("content_hash")).withColumn("status", F.when(F.col("public_id") % 9 == 0, "removed").otherwise("active"))
    observed = runs.where("run = last and scope_id = 'click'").select(F.col("member").alias("public_id"), "content_hash")
    members = old.select("scope_id", F.col("member").alias("public_id")).distinct()
    return sync.reconcile_scope(state, members, observed, "click", True)


@query("""with runs as (select *, max(run) over () as last from scope_runs), cur as (select distinct scope_id, member from runs where run = last), old as (select distinct scope_id, member from runs where run = last - 1)
    select 'union' as kind, count(*) as n from (select * from cur union select * from old) union all select 'replace', count(*) from cur union all select 'missing', count(*) from (select * from old except select * from cur)""", ("scope_runs",))
def member_sets(t: Tables) -> DataFrame:
    runs = t.scope_runs.crossJoin(F.broadcast(t.scope_runs.agg(F.max("run").alias("last"))))
    cur, old = (runs.where(c).select("scope_id", "member") for c in ("run = last", "run = date_sub(last, 1)"))
    parts = {"union": tables.merge_members(old, cur, False), "replace": tables.merge_members(old, cur, True), "missing": tables.missing_members(old, cur)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select event_type as scope_id, max(page) as last_page, count(*) filter (where page = last and first = page) = 0 as natural_end from (select event_type, user_id, page, min(page) over (partition by event_type, user_id) as first, max(page) over (partition by event_type) as last from (select event_type, user_id, cast(event_id // 500 as bigint) as page from events)) group by event_type")
def scan_coverage(t: Tables) -> DataFrame:
    pages = t.events.select(F.col("event_type").alias("scope_id"), F.expr("event_id div 500").alias("page"), F.col("user_id").alias("item"))
    return sync.scan_coverage(pages)


@query("""with t as (select parent, run_id, created_at, status, row_number() over (partition by parent order by created_at desc, run_id desc) as a,
    row_number() over (partition by parent order by case status when 'O' then 0 when 'P' then 1 else 2 end, created_at desc, run_id desc) as b from state_runs)
    select parent, max(run_id) filter (where a = 1) as latest_run, max(status) filter (where a = 1) as latest_status, max(run_id) filter (where b = 1) as picked_run from t group by parent""", ("state_runs",))
def latest_and_picked(t: Tables) -> DataFrame:
    from tidemark.operators.ranking import priority_pick

    latest = latest_per_key(t.state_runs, ["parent"], ["created_at", "run_id"]).select("parent", F.col("run_id").alias("latest_run"), F.col("status").alias("latest_status"))
    picked = priority_pick(t.state_runs, ["parent"], "status", ["O", "P"], [F.desc("created_at"), F.desc("run_id")]).select("parent", F.col("run_id").alias("picked_run"))
    return latest.join(picked, "parent")


@query("""with d as (select parent as source, max(created_at) as done_at from state_runs where status = 'F' group by parent), f as (select parent as source, max(created_at) as failed_at from state_runs where status = 'P' group by parent),
    s as (select c_custkey as source, timestamp '1998-01-01' + c_custkey * interval 1 day as next_at from customer)
    select s.source, s.next_at, d.done_at from s join d on d.source = s.source left join f on f.source = s.source where s.source not in (select parent from state_runs where status = 'O') and s.next_at <= timestamp '1999-01-01' and (f.failed_at is null or f.failed_at <= d.done_at)""", ("state_runs",))
def due_sources(t: Tables) -> DataFrame:
    start = F.lit("1998-01-01").cast("timestamp")
    sources = t.customer.select(F.col("c_custkey").alias("source"), (start + F.make_dt_interval(F.col("c_custkey").cast("int"))).alias("next_at"))
    jobs = t.state_runs.select(F.col("parent").alias("source"), "status", F.col("created_at").alias("at"))
    return tables.due_sources(sources, jobs, F.lit("1999-01-01").cast("timestamp"))


@query("""with o as (select p.k, p.source_id, p.fingerprint as old, c.fingerprint as new, c.category_id from prev_index p full join cur_obs c on c.source_id = p.source_id)
    select coalesce(p.source_id, c.source_id) as source_id, coalesce(c.fingerprint, p.fingerprint) as fingerprint, coalesce(p.category_id, c.category_id) as category_id, case when c.source_id is not null and (p.source_id is null or p.fingerprint <> c.fingerprint) then 2 when p.source_id is null then null else 1 end as version
    from prev_index p full join cur_obs c on c.source_id = p.source_id""", BOTH)
def keyed_upsert(t: Tables) -> DataFrame:
    old = t.prev_index.select("source_id", "fingerprint", "category_id", F.lit(1).alias("version"))
    return tables.upsert(old, t.cur_obs.select("source_id", "fingerprint", "category_id"), ["source_id"], ["fingerprint"], {"version": ("fingerprint", F.lit(2))})


@query("""select source_id, fingerprint, 'old' as side from prev_index union all select source_id, fingerprint, 'new' from cur_obs where source_id not in (select source_id from prev_index)""", BOTH)
def insert_if_absent(t: Tables) -> DataFrame:
    side = lambda df, s: df.select("source_id", "fingerprint", F.lit(s).alias("side"))
    return tables.insert_absent(side(t.prev_index, "old"), side(t.cur_obs, "new"), ["source_id"])


@query("""select source_id, category_id from prev_index where k % 7 <> 0 union all select source_id, category_id from cur_obs where k % 7 = 0""", BOTH)
def replaced_children(t: Tables) -> DataFrame:
    cols = ("source_id", "category_id")
    touched = t.prev_index.where("k % 7 = 0").unionByName(t.cur_obs.where("k % 7 = 0"), allowMissingColumns=True).select("source_id")
    return tables.replace_children(t.prev_index.select(*cols), t.cur_obs.where("k % 7 = 0").select(*cols), ["source_id"], touched)


@query("""select source_id, fingerprint from cur_obs union all select source_id, fingerprint from prev_index where source_id not in (select source_id from cur_obs)""", BOTH)
def union_override(t: Tables) -> DataFrame:
    cols = ("source_id", "fingerprint")
    return tables.union_override(t.prev_index.select(*cols), t.cur_obs.select(*cols), ["source_id"])


@query("""with l as (select source_id as id, case when status = 'deleted' then 'removed' else 'active' end as status from prev_index), c as (select source_id as id from cur_obs)
    select 'public_not_in_ledger' as kind, id from c where id not in (select id from l) union all select 'public_but_removed', id from c where id in (select id from l where status = 'removed')
    union all select 'active_not_public', id from l where status = 'active' and id not in (select id from c) union all select 'removed_not_public', id from l where status = 'removed' and id not in (select id from c)""", BOTH)
def ledger_differences(t: Tables) -> DataFrame:
    ledger = t.prev_index.select(F.col("source_id").alias("id"), F.when(F.col("status") == "deleted", "removed").otherwise("active").alias("status"))
    return tables.ledger_differences(t.cur_obs.select(F.col("source_id").alias("id")), ledger)


@query(f"""with {DELTA}, named as (select e.type, e.source_id, coalesce(t.title, e.source_id) as name from events_of e left join titles t on cast(t.k as varchar) = e.source_id), r as (select *, row_number() over (partition by type order by name, source_id) as rank from named)
    select type, count(*) as total, string_agg(name, '|' order by rank) filter (where rank <= 20) as names, greatest(count(*) - 20, 0) as more from r group by type""", ("prev_index", "cur_obs", "titles"))
def change_report(t: Tables) -> DataFrame:
    names = t.titles.select(F.col("k").cast("string").alias("source_id"), F.col("title").alias("name"))
    return sync.change_report(_delta(t), names).withColumn("names", F.array_join("names", "|"))


@query(f"""with {DELTA}, d as (select source_id, case when k % 29 = 0 then 'information' else 'product' end as kind, case when k % 31 = 0 then '' else 'detail ' || k end as name, cast(k % 5 as integer) as images from cur_obs where k % 37 <> 0),
    e as (select v.source_id, v.type, c.category_id from events_of v left join cur_obs c on c.source_id = v.source_id), p as (select source_id, 'name ' || k as name, category_id, 1 as images from prev_index),
    j as (select coalesce(p.source_id, e.source_id) as source_id, p.source_id is not null as had, p.name as pname, p.category_id as pcat, e.type, e.category_id as ecat, d.source_id is not null as detail, d.kind, d.name as dname, d.images as dimages from p full join e on e.source_id = p.source_id left join d on d.source_id = e.source_id),
    o as (select *, case when type is null then 'kept' when type = 'REMOVED' then case when had then 'removed' else 'ignored' end when type = 'MISSING' then 'kept' when type = 'MOVED' then case when had then 'moved' else 'ignored' end
      when not detail then 'retry' when kind <> 'product' then 'not_product' when dname = '' or dimages = 0 then 'deferred' when not had then 'created' else 'updated' end as outcome from j)
    select source_id, outcome, case when outcome in ('created', 'updated') then dname else pname end as name, case when outcome in ('created', 'updated', 'moved') then ecat else pcat end as category_id,
    not (outcome in ('removed', 'not_product', 'ignored') or (not had and outcome <> 'created')) as alive from o""", BOTH)
def apply_delta(t: Tables) -> DataFrame:
    return _applied(t).select("source_id", "outcome", "name", "category_id", "alive")


OUTCOMES = ("kept", "created", "updated", "moved", "removed", "not_product", "deferred", "retry", "ignored")


@query(f"""with {DELTA}, d as (select source_id, case when k % 29 = 0 then 'information' else 'product' end as kind, case when k % 31 = 0 then '' else 'detail ' || k end as name, cast(k % 5 as integer) as images from cur_obs where k % 37 <> 0),
    e as (select v.source_id, v.type, c.category_id from events_of v left join cur_obs c on c.source_id = v.source_id), p as (select source_id, 'name ' || k as name, category_id, 1 as images from prev_index),
    j as (select coalesce(p.source_id, e.source_id) as source_id, p.source_id is not null as had, p.name as pname, p.category_id as pcat, e.type, e.category_id as ecat, d.source_id is not null as detail, d.kind, d.name as dname, d.images as dimages from p full join e on e.source_id = p.source_id left join d on d.source_id = e.source_id),
    o as (select *, case when type is null then 'kept' when type = 'REMOVED' then case when had then 'removed' else 'ignored' end when type = 'MISSING' then 'kept' when type = 'MOVED' then case when had then 'moved' else 'ignored' end
      when not detail then 'retry' when kind <> 'product' then 'not_product' when dname = '' or dimages = 0 then 'deferred' when not had then 'created' else 'updated' end as outcome from j)
    select {', '.join(f"count(*) filter (where outcome = '{o}') as {o}" for o in OUTCOMES)} from o""", BOTH)
def apply_counters(t: Tables) -> DataFrame:
    return apply_counts(_applied(t), [*OUTCOMES])


def _applied(t: Tables) -> DataFrame:
    k = F.col("k")
    s = k.cast("string")
    details = t.cur_obs.where("k % 37 <> 0").select("source_id", F.when(k % 29 == 0, "information").otherwise("product").alias("kind"), F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("detail "), s)).alias("name"), (k % 5).cast("int").alias("images"))
    events = _delta(t).select("source_id", "type").join(t.cur_obs.select("source_id", "category_id"), "source_id", "left")
    products = t.prev_index.select("source_id", F.concat(F.lit("name "), s).alias("name"), "category_id", F.lit(1).alias("images"), k.alias("position"))
    return sync.apply_delta(products, events, details)


@query(f"""with {DELTA}, d as (select source_id, k % 29 = 0 as info, k % 31 = 0 or k % 5 = 0 as bare from cur_obs where k % 37 <> 0),
    o as (select v.source_id, p.source_id is not null as had, d.source_id is not null as detail, d.info, d.bare, v.type from events_of v left join prev_index p on p.source_id = v.source_id left join d on d.source_id = v.source_id),
    c as (select source_id, cast(null as bigint) as place from o where type not in ('REMOVED', 'MISSING', 'MOVED') and detail and not info and not bare and not had),
    kk as (select p.source_id, p.k as place from prev_index p left join o on o.source_id = p.source_id where not coalesce(o.type = 'REMOVED' or (o.type not in ('MISSING', 'MOVED') and o.detail and o.info), false))
    select source_id, row_number() over (order by was, place, source_id) - 1 as position from (select source_id, place, false as was from c union all select source_id, place, true from kk)""", BOTH)
def product_positions(t: Tables) -> DataFrame:
    return sync.public_positions(_applied(t).withColumn("position", F.lit(0))).select("source_id", "position")


@query("""select k, case when k % 3 = 0 then 0 when status = 'deleted' then miss_count else miss_count + 1 end as miss_count from prev_index""", ("prev_index",))
def next_misses(t: Tables) -> DataFrame:
    return t.prev_index.select("k", next_miss_count(F.col("status"), F.col("miss_count"), F.col("k") % 3 == 0).alias("miss_count"))


@query("""select cast(k as varchar) as run_id, case when k % 4 = 1 then 'quarantined' when k % 4 = 2 then 'preserved' when k % 5 = 0 then 'failed' when k % 7 = 0 then 'details_pending' else 'planned' end as state, k % 4 not in (1, 2) and k % 5 <> 0 and k % 7 <> 0 as verified from titles""", ("titles",))
def sealed_runs(t: Tables) -> DataFrame:
    k = F.col("k")
    runs = t.titles.select(k.cast("string").alias("run_id"), F.when(k % 4 == 1, "quarantine").when(k % 4 == 2, "preserve_last_known_good").otherwise("proceed").alias("outcome"), F.lit(10).alias("expected"), F.when(k % 5 == 0, 9).otherwise(10).alias("actual"), F.when(k % 7 == 0, 1).otherwise(0).alias("details_pending"))
    return sync.seal_run(runs).select("run_id", "state", "verified")


@query("""with a as (select user_id as item, row_number() over (partition by user_id order by event_id) as attempt, case event_type when 'error' then 'retry' when 'view' then 'skipped' else 'success' end as outcome from events)
    select item, case when outcome = 'retry' and attempt >= 4 then 'deferred' else outcome end as state, attempt from a qualify row_number() over (partition by item order by attempt desc) = 1""")
def outcome_fold(t: Tables) -> DataFrame:
    from tidemark.operators.ranking import assign_positions
    from tidemark.streaming.sync import fold_outcomes

    kind = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "view", "skipped").otherwise("success")
    rows = assign_positions(t.events.select(F.col("user_id").alias("item"), "event_id", kind.alias("outcome")), ["item"], ["event_id"], "at")
    return fold_outcomes(rows.select("item", (F.col("at") + 1).alias("attempt"), "outcome"))


@query("select source_id, fingerprint, category_id, 'active' as status, 0 as miss_count from cur_obs", ("cur_obs",))
def initial_index(t: Tables) -> DataFrame:
    return sync.load_initial_index(t.cur_obs, F.current_timestamp()).select("source_id", "fingerprint", "category_id", "status", "miss_count")


@query("select source_id, lower(trim(status)) as status, case when k % 6 = 0 then null else category_id end as category_id, miss_count from prev_index", ("prev_index",))
def normal_index(t: Tables) -> DataFrame:
    raw = t.prev_index.withColumns({"source_id": F.concat(F.lit(" "), "source_id"), "status": F.concat(F.upper("status"), F.lit(" ")), "category_id": F.when(F.col("k") % 6 == 0, " ").otherwise(F.col("category_id"))})
    return sync.normalise_index(raw).select("source_id", "status", "category_id", "miss_count")
