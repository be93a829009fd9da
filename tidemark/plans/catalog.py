"""Queries of the catalog: categories, counts, search, media, joins, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import IMAGE_SCORES
from tidemark.operators import counts, ranking, sync, tables, taxonomy
from tidemark.operators.search import PagedTable, SearchIndex
from tidemark.plans.registry import query
from tidemark.sources import html_pages, snapshots
from tidemark.sources.fixtures import Tables
from tidemark.sources.shared import new_folder, stored

CLOSURE = "closure as (select id, id as ancestor, 0 as distance from tree union all select a.id, b.id, 1 from tree a join tree b on b.id = a.parent_id union all select a.id, c.id, 2 from tree a join tree b on b.id = a.parent_id join tree c on c.id = b.parent_id)"
DIRECT = "direct as (select id, count(*) as n from members group by id)"


def _direct(t: Tables) -> DataFrame:
    return t.members.groupBy("id").agg(F.count("*").alias("n"))


@query(f"with {CLOSURE}, paths as (select id, string_agg(ancestor, '>' order by distance desc) as path from closure group by id) select p.id, p.path, max(c.distance) as depth from paths p join closure c on c.id = p.id group by 1, 2", ("tree",))
def category_trail(t: Tables) -> DataFrame:
    return taxonomy.trail(t.tree).join(taxonomy.depth(t.tree), "id").select("id", F.array_join("path_ids", ">").alias("path"), "depth")


@query(f"with {CLOSURE}, {DIRECT} select c.ancestor as id, case when c.ancestor = 'r0' then 7 else cast(coalesce(sum(d.n), 0) as bigint) end as total from closure c left join direct d on d.id = c.id group by 1", ("tree", "members"))
def category_rollup(t: Tables) -> DataFrame:
    given = t.spark.createDataFrame([("r0", 7)], "id string, n long")
    return counts.rollup_counts(taxonomy.descendants(t.tree), _direct(t), given)


@query(f"with {CLOSURE}, {DIRECT}, s as (select c.ancestor as id, cast(sum(d.n) as bigint) as total from closure c join direct d on d.id = c.id group by 1) select t.id, t.name, s.total from tree t join s on s.id = t.id where t.parent_id is null and s.total > 0", ("tree", "members"))
def root_categories(t: Tables) -> DataFrame:
    total = counts.rollup_counts(taxonomy.descendants(t.tree), _direct(t))
    return taxonomy.child_categories(t.tree, total).select("id", "name", "total")


@query(f"with {CLOSURE}, used as (select 's0-BUILDING' as id union all select 's3-MACHINERY' union all select 'n5'), keep as (select distinct c.ancestor as id from closure c join used u on u.id = c.id) select t.id, t.parent_id, (select max(distance) from closure c where c.id = t.id) as depth, (select count(*) from tree x join keep k2 on k2.id = x.id where x.parent_id = t.id) as children from tree t join keep k on k.id = t.id", ("tree",))
def used_branches(t: Tables) -> DataFrame:
    used = t.spark.createDataFrame([("s0-BUILDING",), ("s3-MACHINERY",), ("n5",)], "id string")
    return taxonomy.used_taxonomy(t.tree, used).select("id", "parent_id", "depth", F.size("child_ids").cast("long").alias("children"))


@query(f"with {CLOSURE}, used as (select distinct id from members where item % 3 = 0), d as (select id, max(distance) as depth from closure group by id) select count(*) as total, count(*) filter (where depth = 0) as roots, count(*) filter (where depth > 0) as nested, max(depth) as max_depth, count(u.id) as used from d left join used u on u.id = d.id", ("tree", "members"))
def taxonomy_stats(t: Tables) -> DataFrame:
    return counts.taxonomy_stats(taxonomy.depth(t.tree), t.members.where("item % 3 = 0").select("id"))


@query(f"with {CLOSURE} select m.item from members m join closure c on c.id = m.id where c.ancestor = 'r1'", ("tree", "members"))
def subtree_members(t: Tables) -> DataFrame:
    rows = t.members.select(F.col("item").alias("product_id"), F.array("id").alias("category_path_ids"))
    return taxonomy.in_subtree(rows, taxonomy.descendants(t.tree), "r1").select(F.col("product_id").alias("item"))


@query("""with p as (select c_custkey as product_id, case when c_custkey % 4 = 0 then 'n' || c_nationkey when c_custkey % 4 = 1 then null else 'gone' end as source_id, case when c_custkey % 4 = 1 then 'nation ' || c_nationkey when c_custkey % 4 = 2 then 'building' else null end as source_name, case when c_custkey % 8 = 3 then 'r0' else null end as category_id, case when c_custkey % 8 = 7 then 'ASIA' else 'x' end as category_name from customer),
    u as (select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as folded, min(id) as id from tree group by 1 having count(*) = 1)
    select p.product_id, coalesce(t.id, a.id, b.id, h.id, 'uncategorised') as category_id, case when t.id is not null then 'id' when a.id is not null then 'source name' when b.id is not null then 'name' when h.id is not null then 'kept' else 'uncategorised' end as how
    from p left join tree t on t.id = p.source_id left join u a on a.folded = trim(regexp_replace(lower(p.source_name), '[^a-z0-9]+', ' ', 'g')) left join u b on b.folded = trim(regexp_replace(lower(p.category_name), '[^a-z0-9]+', ' ', 'g')) left join tree h on h.id = p.category_id""", ("tree",))
def resolved_categories(t: Tables) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    c = t.customer
    products = c.select(k.alias("product_id"), F.when(k % 8 == 3, "r0").alias("category_id"), F.when(k % 8 == 7, "ASIA").otherwise("x").alias("category_name"))
    source = c.select(k.alias("product_id"), F.when(k % 4 == 0, F.concat(F.lit("n"), nation)).when(k % 4 == 1, None).otherwise("gone").alias("source_id"), F.when(k % 4 == 1, F.concat(F.lit("nation "), nation)).when(k % 4 == 2, "building").alias("source_name"))
    return taxonomy.enrich_taxonomy(products, source, t.tree).select("product_id", "category_id", "how")


@query("select id, min(name) as name, min(parent_id) filter (where parent_id is not null) as parent_id from (select 'n' || n_nationkey as id, n_name as name, 'r' || n_regionkey as parent_id from nation) group by id")
def merged_entries(t: Tables) -> DataFrame:
    nation = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    linked = nation.select("id", F.lit(1).alias("pos"), F.lit("").alias("name"), F.col("parent").alias("parent_id"), F.lit("").alias("url"))
    bare = nation.select("id", F.lit(0).alias("pos"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("url"))
    return taxonomy.merge_category_entries(bare.unionByName(linked)).select("id", "name", "parent_id")


@query(f"with {CLOSURE}, {DIRECT} select c.ancestor as id, cast(coalesce(sum(d.n), 0) as bigint) as total from closure c left join direct d on d.id = c.id group by 1", ("tree", "members"))
def interval_rollup(t: Tables) -> DataFrame:
    """Category totals from the numbers of a walk through the tree."""
    return taxonomy.rollup_by_intervals(stored(taxonomy.intervals(t.tree), "intervals"), _direct(t))


@query("select category_id, count(*) as product_count from product_categories group by 1", ("product_categories",))
def category_path_counts(t: Tables) -> DataFrame:
    return counts.path_counts(t.products)


@query("""with f as (select * from products where search_text like '%ring%' and category_name = 'ECONOMY'), n as (select count(*) as total from f)
    select product_id, sort_order, total, greatest(1, cast(ceil(total / 15.0) as bigint)) as total_pages, true as has_previous, 2 < greatest(1, ceil(total / 15.0)) as has_more from f, n order by sort_order, product_id limit 15 offset 15""", ("products",))
def search_page(t: Tables) -> DataFrame:
    q = tables.SearchQuery.normalise(q=" Ring ", category_id="ECONOMY", page=2, team_id="")
    found = tables.search_products(t.products, q, t.product_categories)
    return ranking.page(found, q.page, q.limit).select("product_id", "sort_order", "total", F.col("total_pages").cast("long").alias("total_pages"), "has_previous", "has_more")


@query("select product_id, search_text from products where search_text like '%d_bolt%' union all select product_id, search_text from products where contains(search_text, 'brand#13')", ("products",))
def indexed_search(t: Tables) -> DataFrame:
    """Two searches by posting lists of trigrams: one with a wildcard, one without."""
    index = SearchIndex(t.spark, new_folder(t.spark, "search"), parts=16)
    index.build(t.products)
    return index.search("d_bolt").unionByName(index.search("brand#13"))


@query("""select l_orderkey, l_linenumber, n as total, cast(ceil(n / 30.0) as bigint) as total_pages, true as has_previous, p < ceil(n / 30.0) as has_more from lineitem, (select count(*) as n, cast(ceil(count(*) / 30.0) as bigint) // 2 as p from lineitem) order by l_orderkey, l_linenumber limit 30 offset (select (cast(ceil(count(*) / 30.0) as bigint) // 2 - 1) * 30 from lineitem)""")
def deep_page(t: Tables) -> DataFrame:
    """The page in the middle of all lines."""
    table = PagedTable(t.spark, new_folder(t.spark, "pages"))
    table.build(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 10_000)
    total = table.directory().agg(F.sum("n")).first()[0]
    return table.page(-(-total // 30) // 2, 30)


@query("select product_id, k from products where k > 100 order by k limit 50", ("products",))
def scan_after(t: Tables) -> DataFrame:
    return ranking.scan_after(t.products, "k", 100, 50).select("product_id", "k")


@query("select split_part(p_name, ' ', 1) as facet_id, count(distinct p_partkey) as product_count from part where split_part(p_name, ' ', 2) = 'ring' group by 1")
def team_facets(t: Tables) -> DataFrame:
    noun, adj = F.split("p_name", " ")[1], F.split("p_name", " ")[0]
    products = t.part.select(F.col("p_partkey").alias("product_id"), noun.alias("team_id"))
    return tables.team_facets(products, t.part.select(F.col("p_partkey").alias("product_id"), adj.alias("facet_id")), "ring")


@query("""select team_id, league_id, coalesce(n, 0) as product_count from team_dim left join (select split_part(p_name, ' ', 2) as team, count(*) as n from part where p_partkey % 3 = 0 group by 1) c on c.team = team_id""", ("team_dim",))
def dim_counts(t: Tables) -> DataFrame:
    facts = t.part.where("p_partkey % 3 = 0").select(F.split("p_name", " ")[1].alias("team_id"))
    return counts.dim_counts(t.team_dim, facts, "team_id").select("team_id", "league_id", "product_count")


@query("select p_brand as category_id, count(distinct p_partkey) as product_count from part where p_partkey % 2 = 0 group by 1")
def distinct_counts(t: Tables) -> DataFrame:
    bridge = t.part.select(F.col("p_brand").alias("category_id"), F.col("p_partkey").alias("k"))
    return counts.distinct_counts(bridge, t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k")), "category_id", "k")


@query("select n_regionkey as country, cast(sum(n) as bigint) as product_count, count(*) as league_count from (select n_nationkey, n_regionkey, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1, 2) group by 1")
def country_rollup(t: Tables) -> DataFrame:
    facts = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    leagues = counts.dim_counts(t.nation, facts, "n_nationkey").withColumnRenamed("n_regionkey", "country")
    return counts.country_rollup(leagues)


@query("""with m as (select hash, count(*) as refs, sum(bytes) as bytes, max(bytes) as one from media_refs group by hash) select cast(sum(refs) as bigint) as logical, count(*) as "unique", cast(sum(refs) - count(*) as bigint) as duplicates, cast(sum(bytes) as bigint) as logical_bytes, cast(sum(one) as bigint) as unique_bytes, cast(sum(bytes) - sum(one) as bigint) as saved_bytes, max(refs) as most_refs from m""", ("media_refs",))
def media_dedup_stats(t: Tables) -> DataFrame:
    return counts.media_dedup_stats(t.media_refs)


@query("select product_key, media_id, position from product_media", ("product_media",))
def media_positions(t: Tables) -> DataFrame:
    return t.product_media


@query("""with l as (select p_partkey as item, unnest([1, 2, 3, 4]) as pos from part), u as (select item, pos, 'https://photo.test/shop/' || item || '/' || case pos when 1 then 'small.jpg' when 2 then 'big.jpg' when 3 then 'x' || item || '.jpg' else 'medium.jpg' end as url from l where not (pos = 3 and item % 3 = 0))
    select item, 'photo.test/shop/' || item as group_key, max(url) filter (where pos = case when item % 3 = 0 then 2 else 3 end) as "full", max(url) filter (where pos = 2) as display, max(url) filter (where pos = 1) as thumb from u group by item""")
def best_variants(t: Tables) -> DataFrame:
    assert set(IMAGE_SCORES) == {"full", "display", "thumb"}
    item = F.col("p_partkey").cast("string")
    file = lambda name: F.concat(F.lit("https://photo.test/shop/"), item, F.lit("/"), name)
    options = F.array(*[F.struct(F.lit(i).alias("pos"), file(n).alias("url")) for i, n in ((1, F.lit("small.jpg")), (2, F.lit("big.jpg")), (3, F.concat(F.lit("x"), item, F.lit(".jpg"))), (4, F.lit("medium.jpg")))])
    rows = t.part.select(F.col("p_partkey").alias("item"), F.explode(options).alias("o")).where("not (o.pos = 3 and item % 3 = 0)")
    return ranking.best_variants(rows.select("item", "o.pos", "o.url", F.lit(70).alias("priority"))).drop("pos")


@query("""with a as (select l_partkey as item, l_suppkey as category_id, l_linenumber % 3 as depth from lineitem) select item, category_id, depth from a qualify row_number() over (partition by item order by depth desc, category_id) = 1""")
def best_category(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("category_id"), (F.col("l_linenumber") % 3).alias("depth"))
    return ranking.best_category(rows)


@query("""with e as (select user_id as card, event_id as pos, case when event_id % 3 = 0 then '' else event_type end as title, case when event_id % 5 = 0 then null else 'c' || event_id end as cover, case when event_id % 7 = 0 then cast(event_id % 10 as integer) end as image_count, repeat('x', cast(event_id % 11 as integer)) as signal from events)
    select card, arg_min(title, pos) filter (where title <> '') as title, arg_min(cover, pos) filter (where cover is not null) as cover, arg_min(image_count, pos) filter (where image_count is not null) as image_count, max(length(signal)) as longest from e group by card""")
def merged_cards(t: Tables) -> DataFrame:
    e = F.col("event_id")
    cards = t.events.select(F.col("user_id").alias("card"), e.alias("pos"), F.when(e % 3 == 0, "").otherwise(F.col("event_type")).alias("title"), F.when(e % 5 != 0, F.concat(F.lit("c"), e.cast("string"))).alias("cover"), F.when(e % 7 == 0, (e % 10).cast("int")).alias("image_count"), F.expr("repeat('x', cast(event_id % 11 as int))").alias("signal"))
    return ranking.merge_cards(cards, "card", "pos").select("card", "title", "cover", "image_count", F.length("signal").cast("long").alias("longest"))


@query("select user_id, event_id as first_event, (select max(event_id) from events b where b.user_id = a.user_id) as last_event from events a qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_and_last(t: Tables) -> DataFrame:
    first = ranking.first_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"))
    last = ranking.last_by_hash(t.events.select("user_id", "event_id"), "user_id", "event_id").select("user_id", F.col("event_id").alias("last_event"))
    return first.join(last, "user_id")


@query("select l_partkey, l_orderkey, rank from (select l_partkey, l_orderkey, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey, l_quantity) as rank from lineitem) where rank <= 3")
def top_lines(t: Tables) -> DataFrame:
    return ranking.top_n(t.lineitem, ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], 3).select("l_partkey", "l_orderkey", F.col("rank").cast("long").alias("rank"))


@query("select p.k, p.source_name, i.status, o.json from products p left join prev_index i on i.k = p.k left join overrides o on o.k = p.k", ("products", "prev_index", "overrides"))
def enriched_products(t: Tables) -> DataFrame:
    return tables.enrich_products(t.products.select("k", "source_name"), t.prev_index.select("k", "status"), t.overrides)


@query("select product_key, media_id from product_media where product_key not in (select k from products where k % 10 <> 0) or media_id not in (select media_id from media_sources where active)", ("product_media", "products", "media_sources"))
def media_orphans(t: Tables) -> DataFrame:
    products = t.products.where("k % 10 <> 0").select(F.col("k").alias("product_key"))
    return tables.orphans(t.product_media, [(products, "product_key"), (t.media_sources.where("active"), "media_id")]).select("product_key", "media_id")


@query("select k, status from prev_index where k in (select k from overrides) union all select k, 'none' from overrides where k not in (select k from prev_index)", ("prev_index", "overrides"))
def members_and_absent(t: Tables) -> DataFrame:
    here = tables.semi(t.prev_index, t.overrides, ["k"]).select("k", "status")
    return here.unionByName(tables.absent(t.overrides, t.prev_index, ["k"]).select("k", F.lit("none").alias("status")))


@query("select source_id, p.status as was, p.source_id is null as is_new, c.source_id is null as is_gone from (select coalesce(p.source_id, c.source_id) as source_id, p, c from prev_index p full join cur_obs c on c.source_id = p.source_id)", ("prev_index", "cur_obs"))
def snapshot_diff(t: Tables) -> DataFrame:
    return tables.snapshot_diff(t.prev_index, t.cur_obs, "source_id").select("source_id", F.col("previous.status").alias("was"), F.col("previous").isNull().alias("is_new"), F.col("current").isNull().alias("is_gone"))


@query("select c_custkey as k, (select n_name from nation where n_nationkey = c_nationkey) || '>' || c_mktsegment as names from customer")
def resolved_paths(t: Tables) -> DataFrame:
    n = F.col("c_nationkey").cast("string")
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.array(F.lit("unknown"), F.concat(F.lit("n"), n), F.concat(F.lit("s"), n, F.lit("-"), "c_mktsegment")).alias("path"))
    return tables.resolve_path(rows, "k", "path", t.tree).select("k", F.array_join("path_names", ">").alias("names"))


@query("select trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as folded, min(id) as id from tree group by 1 having count(*) = 1", ("tree",))
def unique_names(t: Tables) -> DataFrame:
    from tidemark.functions.text import fold

    return tables.unique_names(t.tree, fold(F.col("name")))


@query("select product_id, case when k % 4 = 0 then source_name else 'Shown ' || k end as name, case when k % 3 = 0 then category_name else '' end as category, cast(case when k % 5 = 0 then 0 else k end as bigint) as image_count from products", ("products",))
def product_views(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.products.withColumns({"display_name": F.when(k % 4 != 0, F.concat(F.lit("Shown "), k.cast("string"))).otherwise(""), "display_category": F.lit(""), "category_name": F.when(k % 3 == 0, F.col("category_name")), "image_count": F.when(k % 5 != 0, k)})
    return tables.product_view(rows)


@query("select doc_id, 'raw' as \"column\" from texts where contains(lower(raw), 'https://')", ("texts",))
def leak_scan(t: Tables) -> DataFrame:
    return tables.find_leaks(t.texts, "doc_id", ["text", "raw"], ["https://", "photo.supplier"])


@query("select 'product_id' as \"column\", 'x' || product_id as value from products where k % 6 = 0", ("products",))
def bad_ids(t: Tables) -> DataFrame:
    return tables.bad_ids(t.products.withColumn("product_id", F.when(F.col("k") % 6 == 0, F.concat(F.lit("x"), "product_id")).otherwise(F.col("product_id"))), {"product_id": "p"})


@query("select l_returnflag as state, count(*) as total from lineitem group by 1 union all select 'Z', 0")
def state_histogram(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("state"))
    return counts.state_histogram(rows, "state", rows.distinct().unionByName(t.spark.createDataFrame([("Z",)], "state string")))


@query("select count(*) filter (where status = 'O') as \"O\", count(*) filter (where status = 'F') as \"F\", count(*) as total from state_runs", ("state_runs",))
def status_pivot(t: Tables) -> DataFrame:
    return counts.status_counts(t.state_runs, "status", ["O", "F"])


@query("select count(*) filter (where status <> 'deleted') as known_good from prev_index", ("prev_index",))
def known_good(t: Tables) -> DataFrame:
    return counts.known_good_count(t.prev_index)


@query("select event_type as scope_id, count(distinct user_id) as members from events group by 1")
def scope_counts(t: Tables) -> DataFrame:
    return counts.scope_counts(t.events.select(F.col("event_type").alias("scope_id"), F.col("user_id").alias("member")))


@query("select s_suppkey as media_id, s_acctbal as balance from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def pruned_media(t: Tables) -> DataFrame:
    refs = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("media_id"))
    kept = tables.prune_orphans(t.supplier.select(F.col("s_suppkey").alias("media_id"), F.col("s_acctbal").alias("balance")), refs, ["media_id"])
    return tables.prune_zero(kept.withColumn("n", F.lit(1)), "n").drop("n")


@query("select team_id as key, '{\"league_id\":\"' || league_id || '\",\"ordinal\":' || ordinal || '}' as value from team_dim", ("team_dim",))
def meta_rows(t: Tables) -> DataFrame:
    return tables.meta_rows(t.team_dim.select("team_id", "league_id", "ordinal"), "team_id")


@query("select event_id, 0 as pos, json_extract_string(props, '$.k') as value from events union all select event_id, 1, event_type from events")
def json_arrays(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.to_json(F.array(F.get_json_object("props", "$.k"), "event_type")).alias("list"))
    return snapshots.json_array_rows(rows, "event_id", "list")


@query("select page_id, case when contains(url, '.com/') then 'com' when contains(url, '.net/') then 'net' end as provider from pages")
def detected_sources(t: Tables) -> DataFrame:
    return snapshots.detect_source(t.pages, {"com": r"\.com/", "net": r"\.net/", "other": r"\.other/"}).select("page_id", "provider")


@query("select source_id, 'fingerprint' as rule from cur_obs where k % 8 = 0 union all select source_id, 'category_path_ids' from cur_obs where k % 9 = 0", ("cur_obs",))
def contract_violations(t: Tables) -> DataFrame:
    rows = t.cur_obs.withColumns({"fingerprint": F.when(F.col("k") % 8 == 0, "short").otherwise(F.col("fingerprint")), "category_path_ids": F.when(F.col("k") % 9 != 0, F.col("category_path_ids"))})
    return snapshots.check_observations(rows)


#: Character references; the last one counts without its semicolon too.
DECODE = "regexp_replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g')"
TITLE = "substr(trim(regexp_replace(" + DECODE.format(r"regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g')), 1, 240)"


@query(f"select page_id, {TITLE} as title from pages")
def page_titles(t: Tables) -> DataFrame:
    return html_pages.extract_details(t.pages).select("page_id", F.col("name").alias("title"))


@query(r"""with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0)) as x from pages), b as (select page_id, regexp_extract(x, 'href="/([^"]*)"', 1) as item_id, regexp_extract(x, '(?is)>(.*?)</a>', 1) as title from a) select page_id, item_id, min(title) as title from b where item_id <> '' group by 1, 2""")
def page_listing(t: Tables) -> DataFrame:
    return html_pages.extract_listing(t.pages, r"^/(.+)$").select("page_id", "item_id", "title")


@query(rf"""with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>', 0)) as x from pages), b as (select regexp_extract(x, 'href="/([^"]+)"', 1) as id, trim(regexp_replace({DECODE.format("regexp_replace(regexp_extract(x, '(?is)>(.*?)</a>', 1), '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) as name from a)
    select id, min(name) as name, cast(null as varchar) as parent_id from b where id <> '' and name <> '' and not regexp_matches(name, '^[0-9]+$') and lower(name) not in ('all categories', 'all') group by id""")
def page_categories(t: Tables) -> DataFrame:
    return html_pages.extract_categories(t.pages, r"^/(.+)$")


@query(r"""with a as (select page_id, url, x, pos from (select page_id, url, unnest(regexp_extract_all(html, '(?:<li>)?<a\b[^>]*?href="/[^"]+"')) as x, generate_subscripts(regexp_extract_all(html, '(?:<li>)?<a\b[^>]*?href="/[^"]+"'), 1) as pos from pages)),
    b as (select page_id, url, regexp_extract(x, 'href="/([^"]+)"', 1) as item_id, min_by(x, pos) as x from a group by 1, 2, 3), o as (select *, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) as origin from b where starts_with(x, '<li>'))
    select page_id, item_id, origin || '/' || item_id as item_url, 'é' || item_id as title, origin || split_part('/t/' || item_id || '.jpg', ',', 1) as cover, 12 as image_count, 'i-' || item_id as signal from o""")
def page_cards(t: Tables) -> DataFrame:
    """Items of lists whose cards got bare and single-quoted attributes, a srcset, character references and an inner count."""
    card = """<li data-id=i-$1><img srcset='/t/$1.jpg 1x, /b/$1.jpg 2x'><i class="x photo-count">&#x31;2</i><a title='&eacute;$1' href=/$1>"""
    pages = t.pages.withColumn("html", F.regexp_replace("html", r'<li><a href="/([^"]+)">', card))
    return html_pages.extract_listing(pages, r"^/(.+)$", cards=("li",)).where("signal is not null")


@query("select league_id, team_id from team_dim union select league_id, league_id from types", ("team_dim", "types"))
def supported_leagues(t: Tables) -> DataFrame:
    return tables.supported_leagues(t.team_dim.select("team_id", "league_id"), t.types.select(F.col("league_id").alias("team_id"), "league_id"), ["team_id"])


# -- listings, projections, sources ---------------------------------------------------------------------------------


@query("""select team_id, league_id, product_count, row_number() over (order by product_count desc, team_id) as place from (select d.team_id, d.league_id, count(*) as product_count from team_dim d join part on split_part(p_name, ' ', 2) = d.team_id where p_partkey % 3 = 0 group by 1, 2) where league_id <> 'PROMO'""", ("team_dim",))
def dim_listing(t: Tables) -> DataFrame:
    """Teams that have products, without one league, most products first."""
    facts = t.part.where("p_partkey % 3 = 0").select(F.split("p_name", " ")[1].alias("team_id"))
    dim = counts.dim_counts(t.team_dim, facts, "team_id").withColumns({"name": F.col("team_id"), "shown": F.col("league_id") != "PROMO"})
    listed = ranking.order_dim(tables.list_dim(dim, shown=True), "team")
    return ranking.global_positions(listed.withColumn("_down", -F.col("product_count")), ["_down", "name"], "place").select("team_id", "league_id", "product_count", (F.col("place") + 1).alias("place"))


@query("select count(*) as leaks from texts where contains(lower(raw), 'https://')", ("texts",))
def published_leaks(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(tables.leak_gate(t.texts.select("raw"), ["https://"]),)], "leaks long")


@query("select * from (select 'observations' as name, count(*) as n from cur_obs union all select 'categories', count(distinct category_id) from cur_obs) union all select 'blocked', 0", ("cur_obs",))
def staged_run(t: Tables) -> DataFrame:
    """Counts of what a run stages, and of a blocked one, which stages nothing."""
    root = new_folder(t.spark, "stage")
    parts = {"observations": t.cur_obs, "categories": t.cur_obs.select("category_id").distinct()}
    found = sync.stage_run(root, "r1", parts, "proceed")
    return t.spark.createDataFrame([*found.items(), ("blocked", len(sync.stage_run(root, "r2", parts, "quarantine")))], "name string, n long")


@query("select 'catalog' as scope_id, source_id as public_id from prev_index where status = 'active'", ("prev_index",))
def migrated_members(t: Tables) -> DataFrame:
    return sync.migrate_ledger_v1(t.prev_index.select(F.col("source_id").alias("public_id"), "status"), "catalog")


@query("""select 'entity_type' as kind, league_id as id, cast(sum(n) as bigint) as total from (select d.team_id, d.league_id, count(*) as n from team_dim d join part on split_part(p_name, ' ', 2) = d.team_id group by 1, 2) group by league_id union all select 'facet', split_part(p_name, ' ', 1), count(*) from part group by 2""", ("team_dim",))
def navigation_counts(t: Tables) -> DataFrame:
    teams = counts.dim_counts(t.team_dim, t.part.select(F.split("p_name", " ")[1].alias("team_id")), "team_id")
    facets = t.part.groupBy(F.split("p_name", " ")[0].alias("facet_id")).agg(F.count("*").alias("product_count"))
    return counts.navigation_counts(teams.withColumnRenamed("league_id", "entity_type"), facets)


@query("select l_orderkey, l_linenumber, s_acctbal > 0 as active from lineitem join supplier on s_suppkey = l_suppkey")
def matched_media(t: Tables) -> DataFrame:
    """Every line with its source; a line without one fails the run."""
    sources = t.media_sources.withColumnRenamed("media_id", "l_suppkey")
    return tables.require_total_match(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), sources, ["l_suppkey"]).drop("l_suppkey")


@query("""with m as (select distinct event_type as scope_id, cast(user_id as varchar) || '|' || cast(cast(ts as date) as varchar) as member from events), n as (select member, count(*) as scopes, max(scope_id) as one from m group by 1) select member from n where scopes = 1 and one = 'error'""")
def removable_members(t: Tables) -> DataFrame:
    """Users' days with errors and nothing else."""
    members = t.events.select(F.col("event_type").alias("scope_id"), F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("member")).distinct()
    return tables.removable(members.where("scope_id = 'error'").select("member"), members.where("scope_id <> 'error'"), ["member"])


@query("select product_id, brand from products", ("products",))
def public_projection(t: Tables) -> DataFrame:
    return tables.public_columns(t.products, ["product_id", "brand", "image"])


@query("""select k as product_id, case when k % 3 = 0 then 'u' || k || ',v' when k % 3 = 1 then 'r' || k else '' end as urls, case when k % 3 = 0 then 'u' || k || ',v' when k % 3 = 1 then 't' || k else '' end as thumbs from titles""", ("titles",))
def media_views(t: Tables) -> DataFrame:
    k = F.col("k").cast("string")
    kind = F.col("k") % 3
    rich = F.array(F.struct(F.concat(F.lit("r"), k).alias("url"), F.concat(F.lit("t"), k).alias("thumb"), F.lit("").alias("download")))
    rows = t.titles.select(F.col("k").alias("product_id"), F.when(kind == 0, F.array(F.concat(F.lit("u"), k), F.lit(""), F.lit("v"))).alias("images"), F.when(kind == 1, rich).alias("media"))
    return tables.media_view(rows).select("product_id", F.array_join("media.url", ",").alias("urls"), F.array_join("media.thumb", ",").alias("thumbs"))


@query("""with f as (select s_nationkey as n, string_agg(s_name || chr(10), '' order by s_suppkey) as content from supplier group by 1), g as (select *, sha256(content) as hash, strlen(content) as bytes from f)
    select 'file' as kind, 'm_' || substr(hash, 1, 20) as id, bytes from g union all select 'format txt', cast(count(*) as varchar), cast(sum(bytes) as bigint) from g union all select 'unreferenced', cast(count(*) as varchar), cast(sum(bytes) as bigint) from g where n % 2 = 1""")
def media_files(t: Tables) -> DataFrame:
    """Files written by Spark, one a nation, read back as media: their ids, formats, and those that nothing refers to."""
    root = new_folder(t.spark, "media")
    t.supplier.repartition(1, "s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(root)
    files = snapshots.read_media(t.spark, root).where("format = 'txt'")
    referenced = files.where(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int") % 2 == 0)
    out = files.select(F.lit("file").alias("kind"), F.col("media_id").alias("id"), "bytes")
    out = out.unionByName(counts.media_formats(files).select(F.concat(F.lit("format "), "format").alias("kind"), F.col("total").cast("string").alias("id"), "bytes"))
    return out.unionByName(snapshots.unreferenced_media(files, referenced).select(F.lit("unreferenced").alias("kind"), F.col("files").cast("string").alias("id"), "bytes"))


@query("select 'product' as kind, p_name as id from part union all select 'node', n_name from nation union all select 'generated', 'today'")
def catalog_snapshot(t: Tables) -> DataFrame:
    """Snapshot documents of at most 1,000 parts, written by Spark, and read as products, taxonomy and meta."""
    listed = lambda *cols: F.collect_list(F.struct(*cols))
    products = t.part.groupBy(F.expr("p_partkey div 1000").alias("no")).agg(listed(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")).alias("products"))
    taxonomy = F.broadcast(t.nation.agg(listed(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")).alias("taxonomy")))
    root = new_folder(t.spark, "snapshot")
    products.crossJoin(taxonomy).withColumn("generatedAt", F.lit("today")).write.partitionBy("no").json(root)  # the taxonomy is one row
    doc = snapshots.read_catalog_snapshot(t.spark, root)
    out = doc["products"].select(F.lit("product").alias("kind"), F.col("name").alias("id")).unionByName(doc["taxonomy"].select(F.lit("node").alias("kind"), F.col("name").alias("id")).distinct())
    return out.unionByName(doc["meta"].select(F.lit("generated").alias("kind"), F.col("generatedAt").alias("id")).distinct())


@query("select n_name as name, n_regionkey as region from nation")
def nested_results(t: Tables) -> DataFrame:
    """Rows of payloads whose results hold results: nations below regions below one document."""
    leaf = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    wrap = lambda c: F.concat(F.lit('{"results":['), F.array_join(F.collect_list(c), ","), F.lit("]}"))
    one = t.nation.groupBy("n_regionkey").agg(wrap(leaf).alias("r")).agg(wrap(F.col("r")).alias("payload"))
    return snapshots.flatten_results(one).select(F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.region").cast("long").alias("region"))


@query("select n_nationkey as id, 'second' as run from nation where n_regionkey <> 0")
def published_snapshot(t: Tables) -> DataFrame:
    """Two snapshots published one after the other; readers see the whole second one."""
    root, rows = new_folder(t.spark, "published"), t.nation.select(F.col("n_nationkey").alias("id"), "n_regionkey")
    snapshots.publish_snapshot({"rows": rows.select("id", F.lit("first").alias("run"))}, root, "first")
    snapshots.publish_snapshot({"rows": rows.where("n_regionkey <> 0").select("id", F.lit("second").alias("run"))}, root, "second")
    return snapshots.read_published(t.spark, root, "rows")
