"""Catalog tables derived from the driver's tables, as DataFrames and as DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What DuckDB runs for each derived table, in order of dependence.
CTES = {
    "titles": """select a.p_partkey as k, a.p_type, a.p_brand, a.p_name, a.p_retailprice, a.p_size, a.p_name || case when a.p_partkey % 5 = 0 then ' ' || b.p_name else '' end
        || case when a.p_partkey % 4 = 0 then ' 24/25' else '' end || case when a.p_partkey % 12 = 0 then ' 2025-26' else '' end as title
        from part a join part b on b.p_partkey = (a.p_partkey * 7) % (select count(*) from part)""",
    "products": """select 'p_' || substr(sha256('fixture:id:v1|part|' || k), 1, 20) as product_id, k, title as source_name, p_type as category_name, p_brand as brand,
        [p_type, p_type || '/' || p_brand] as category_path_ids, k as sort_order, lower(title || ' ' || p_type || ' ' || p_brand) as search_text from titles""",
    "product_categories": "select distinct product_id, unnest(category_path_ids) as category_id from products",
    "media_sources": "select s_suppkey as media_id, s_acctbal > 0 as active from supplier",
    "product_media": "select l_partkey as product_key, l_suppkey as media_id, row_number() over (partition by l_partkey order by l_suppkey) - 1 as position from (select distinct l_partkey, l_suppkey from lineitem)",
    "media_refs": "select l_partkey as product_key, sha256(cast(l_partkey as varchar)) as hash, cast(l_quantity as bigint) as bytes from lineitem",
    "prev_index": """select cast(p_partkey as varchar) as source_id, sha256(p_name || '|' || cast(cast(round(p_retailprice * 100) as bigint) as varchar)) as fingerprint, p_type as category_id,
        [p_type] as category_path_ids, case when p_partkey % 23 = 0 then null else 'd' || p_partkey end as detail_fingerprint,
        case when p_partkey % 17 = 0 then 'deleted' when p_partkey % 19 = 0 then 'missing' else 'active' end as status,
        cast(case when p_partkey % 17 = 0 then 0 when p_partkey % 19 = 0 then 1 + p_partkey % 3 else 0 end as integer) as miss_count, p_partkey as k from part where p_partkey % 10 <> 0""",
    "cur_obs": """select cast(p_partkey as varchar) as source_id, sha256(p_name || '|' || cast(cast(round(p_retailprice * 100) as bigint) as varchar) || case when p_partkey % 7 = 0 then '!' else '' end) as fingerprint,
        p_type || case when p_partkey % 11 = 0 then '*' else '' end as category_id, [p_type || case when p_partkey % 11 = 0 then '*' else '' end] as category_path_ids, p_partkey as k from part where p_partkey % 13 <> 0""",
    "tree": """select 'r' || r_regionkey as id, r_name as name, cast(null as varchar) as parent_id from region union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey from nation
        union all select distinct 's' || c_nationkey || '-' || c_mktsegment, c_mktsegment, 'n' || c_nationkey from customer""",
    "members": "select c_custkey as item, 's' || c_nationkey || '-' || c_mktsegment as id from customer",
    "nouns": "select noun, row_number() over (order by noun) - 1 as ordinal from (select distinct split_part(p_name, ' ', 2) as noun from part)",
    "types": "select p_type as league_id, row_number() over (order by p_type) - 1 as ordinal from (select distinct p_type from part)",
    "team_dim": "select noun as team_id, league_id, n.ordinal from nouns n join types t on t.ordinal = n.ordinal % (select count(*) from types)",
    "facet_dim": "select adj as facet_id, case when adj in ('hot', 'cold', 'new', 'old') then 'version' else 'style' end as facet_type, row_number() over (order by adj) - 1 as ordinal from (select distinct split_part(p_name, ' ', 1) as adj from part)",
    "overrides": """select doc_id as k, case when doc_id % 3 = 0 then '{"teamId":null}' else '{"teamId":"bolt"}' end as json from labels where quality = 0 and doc_id < (select count(*) from part)""",
    "scope_runs": "select event_type as scope_id, cast(ts as date) as run, user_id as member, sha256(user_id || '|' || cast(max(cast(round(value * 100) as bigint)) as varchar)) as content_hash from events group by event_type, cast(ts as date), user_id",
    "state_runs": "select o_custkey as parent, o_orderkey as run_id, cast(o_orderdate as timestamp) as created_at, o_orderstatus as status from orders",
    "texts": "select doc_id, text, case when doc_id % 9 = 0 then text || ' see https://supplier.test/a WhatsApp: +55 11' else text end as raw from documents",
}


def with_tables(*names: str) -> str:
    """A WITH clause of these derived tables and all that they are made of."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in CTES:
            if other != name and other not in need and f" {other}" in CTES[name].replace("\n", " ").replace("(", " ").replace(")", " "):
                if [*CTES].index(other) < [*CTES].index(name):
                    add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as materialized ({CTES[n]})" for n in sorted(need, key=[*CTES].index)) + " "


class Tables:
    """The driver's tables and those derived from them, read from one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.get = cache(self._get)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def _get(self, name: str) -> DataFrame:
        make: Callable[[], DataFrame] | None = getattr(type(self), f"_{name}", None)
        return make(self) if make else self.raw(name)

    def _titles(self) -> DataFrame:
        part = self.raw("part")
        n = part.count()
        k = F.col("p_partkey")
        other = part.select(F.col("p_partkey").alias("at"), F.col("p_name").alias("other"))
        title = F.concat("p_name", F.when(k % 5 == 0, F.concat(F.lit(" "), "other")).otherwise(""), F.when(k % 4 == 0, " 24/25").otherwise(""), F.when(k % 12 == 0, " 2025-26").otherwise(""))
        joined = part.join(other, F.col("at") == (k * 7) % n)
        return joined.select(k.alias("k"), "p_type", "p_brand", "p_name", "p_retailprice", "p_size", title.alias("title"))

    def _products(self) -> DataFrame:
        oid = F.concat(F.lit("p_"), F.substring(F.sha2(F.concat(F.lit("fixture:id:v1|part|"), F.col("k").cast("string")), 256), 1, 20))
        return self.titles.select(
            oid.alias("product_id"), "k", F.col("title").alias("source_name"), F.col("p_type").alias("category_name"), F.col("p_brand").alias("brand"),
            F.array("p_type", F.concat_ws("/", "p_type", "p_brand")).alias("category_path_ids"), F.col("k").alias("sort_order"), F.lower(F.concat_ws(" ", "title", "p_type", "p_brand")).alias("search_text"),
        )

    def _product_categories(self) -> DataFrame:
        return self.products.select("product_id", F.explode("category_path_ids").alias("category_id")).distinct()

    def _media_sources(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("media_id"), (F.col("s_acctbal") > 0).alias("active"))

    def _product_media(self) -> DataFrame:
        from tidemark.operators.ranking import assign_positions

        return assign_positions(self.raw("lineitem").select(F.col("l_partkey").alias("product_key"), F.col("l_suppkey").alias("media_id")).distinct(), ["product_key"], ["media_id"])

    def _media_refs(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("product_key"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"), F.col("l_quantity").cast("long").alias("bytes"))

    @staticmethod
    def _price() -> Column:
        return F.round(F.col("p_retailprice") * 100).cast("long").cast("string")

    def _prev_index(self) -> DataFrame:
        k = F.col("p_partkey")
        status = F.when(k % 17 == 0, "deleted").when(k % 19 == 0, "missing").otherwise("active")
        return self.raw("part").where(k % 10 != 0).select(
            k.cast("string").alias("source_id"), F.sha2(F.concat_ws("|", "p_name", self._price()), 256).alias("fingerprint"), F.col("p_type").alias("category_id"),
            F.array("p_type").alias("category_path_ids"), F.when(k % 23 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("detail_fingerprint"), status.alias("status"),
            F.when(status == "missing", 1 + k % 3).otherwise(0).cast("int").alias("miss_count"), k.alias("k"),
        )

    def _cur_obs(self) -> DataFrame:
        k = F.col("p_partkey")
        category = F.concat("p_type", F.when(k % 11 == 0, "*").otherwise(""))
        mark = F.when(k % 7 == 0, "!").otherwise("")
        return self.raw("part").where(k % 13 != 0).select(k.cast("string").alias("source_id"), F.sha2(F.concat(F.concat_ws("|", "p_name", self._price()), mark), 256).alias("fingerprint"), category.alias("category_id"), F.array(category).alias("category_path_ids"), k.alias("k"))

    def _tree(self) -> DataFrame:
        s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        regions = self.raw("region").select(s("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
        nations = self.raw("nation").select(s("n", "n_nationkey"), "n_name", s("r", "n_regionkey"))
        segments = self.raw("customer").select(F.concat(s("s", "c_nationkey"), F.lit("-"), "c_mktsegment"), "c_mktsegment", s("n", "c_nationkey")).distinct()
        return regions.union(nations).union(segments)

    def _members(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("item"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment").alias("id"))

    def _dim(self, column: Column, name: str) -> DataFrame:
        from tidemark.operators.ranking import small_ordinal

        return small_ordinal(self.raw("part").select(column.alias(name)).distinct(), name)

    def _nouns(self) -> DataFrame:
        return self._dim(F.split("p_name", " ")[1], "noun")

    def _types(self) -> DataFrame:
        return self._dim(F.col("p_type"), "league_id")

    def _team_dim(self) -> DataFrame:
        types = self.types.select("league_id", F.col("ordinal").alias("at"))
        return self.nouns.join(types, F.col("at") == F.col("ordinal") % types.count()).select(F.col("noun").alias("team_id"), "league_id", "ordinal")

    def _facet_dim(self) -> DataFrame:
        adj = self._dim(F.split("p_name", " ")[0], "facet_id")
        return adj.select("facet_id", F.when(F.col("facet_id").isin("hot", "cold", "new", "old"), "version").otherwise("style").alias("facet_type"), "ordinal")

    def _overrides(self) -> DataFrame:
        n = self.raw("part").count()
        k = F.col("doc_id")
        return self.raw("labels").where((F.col("quality") == 0) & (k < n)).select(k.alias("k"), F.when(k % 3 == 0, '{"teamId":null}').otherwise('{"teamId":"bolt"}').alias("json"))

    def _scope_runs(self) -> DataFrame:
        most = F.max(F.round(F.col("value") * 100).cast("long")).cast("string")
        grouped = self.raw("events").groupBy(F.col("event_type").alias("scope_id"), F.to_date("ts").alias("run"), F.col("user_id").alias("member")).agg(most.alias("most"))
        return grouped.select("scope_id", "run", "member", F.sha2(F.concat_ws("|", F.col("member").cast("string"), "most"), 256).alias("content_hash"))

    def _state_runs(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderstatus").alias("status"))

    def _texts(self) -> DataFrame:
        raw = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" see https://supplier.test/a WhatsApp: +55 11"))).otherwise(F.col("text"))
        return self.raw("documents").select("doc_id", "text", raw.alias("raw"))
