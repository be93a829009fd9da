"""Whole-table operators: upserts, child replacement, pruning, set operations, joins, search, projections."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import filled

# -- writing new versions of a table --------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], when_changed: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """old with the rows of new: the update columns taken from new, others preserved, new keys added.

    when_changed: column -> (watched, value): the column gets the value only where the watched column differs.
    """
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_in_new"))
    both = old.withColumn("_in_old", F.lit(True)).join(fresh, keys, "full_outer")

    def value(c: str) -> Column:
        given = F.col(f"_new_{c}") if c in new.columns else F.lit(None)
        if when_changed and c in when_changed:
            watched, then = when_changed[c]
            moved = F.col("_in_new") & (F.col("_in_old").isNull() | ~F.col(watched).eqNullSafe(F.col(f"_new_{watched}")))
            return F.when(moved, then).otherwise(F.col(c))
        return F.when(F.col("_in_old").isNull(), given).when(F.col("_in_new"), given if c in update else F.col(c)).otherwise(F.col(c))

    return both.select(*[c if c in keys else value(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent_keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Children of the touched parents (by default those in new) replaced by new."""
    gone = (touched if touched is not None else new).select(*parent_keys).distinct()
    return old.join(gone, parent_keys, "left_anti").unionByName(new)


def prune_orphans(df: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    return df.join(refs.select(*on), on, "left_semi")


def prune_zero(df: DataFrame, count_col: str) -> DataFrame:
    return df.where(F.col(count_col) > 0)


def meta_rows(df: DataFrame, key: str) -> DataFrame:
    """key, value: each row of df, without its key, as a JSON object."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))


# -- sets -----------------------------------------------------------------------------------------------------------


def merge_members(prev: DataFrame, cur: DataFrame, complete: bool) -> DataFrame:
    """Members of a scope after a scan: replaced by a complete one, united with a partial one."""
    return cur.distinct() if complete else prev.unionByName(cur).distinct()


def missing_members(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return prev.distinct().join(cur, prev.columns, "left_anti")


def supported_leagues(teams: DataFrame, leagues: DataFrame, keys: list[str]) -> DataFrame:
    return teams.select(*keys, "league_id").unionByName(leagues.select(*keys, "league_id")).where("league_id is not null").distinct()


def union_override(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, those of newer instead of those of base."""
    return base.join(newer, keys, "left_anti").unionByName(newer)


def ledger_differences(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """kind, id of catalog (id) against ledger (id, status): public but unknown, public but removed, active but not public, never both."""
    out = [
        ("public_not_in_ledger", catalog.select("id").join(ledger, "id", "left_anti")),
        ("public_but_removed", catalog.select("id").join(ledger.where("status = 'removed'"), "id", "left_semi")),
        ("active_not_public", ledger.where("status = 'active'").select("id").join(catalog, "id", "left_anti")),
        ("removed_not_public", ledger.where("status = 'removed'").select("id").join(catalog, "id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "id") for k, d in out])


# -- joins ----------------------------------------------------------------------------------------------------------


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def absent(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def orphans(bridge: DataFrame, parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows of a bridge that lack one of their parents."""
    marked = bridge
    for i, (parent, key) in enumerate(parents):
        marked = marked.join(parent.select(key, F.lit(True).alias(f"_has{i}")).distinct(), key, "left")
    missing = reduce(lambda a, b: a | b, [F.col(f"_has{i}").isNull() for i in range(len(parents))])
    return marked.where(missing).select(*bridge.columns)


def enrich_products(products: DataFrame, index: DataFrame, overrides: DataFrame, key: str = "k") -> DataFrame:
    """Each product with its index row and override, if there are any."""
    return products.join(index, key, "left").join(overrides, key, "left")


def snapshot_diff(prev: DataFrame, cur: DataFrame, on: str) -> DataFrame:
    """on, previous, current: both sides of each key as structs, null where it is absent."""
    p = prev.select(on, F.struct(*prev.columns).alias("previous"))
    c = cur.select(on, F.struct(*cur.columns).alias("current"))
    return p.join(c, on, "full_outer")


def resolve_path(df: DataFrame, key: str, path_col: str, dim: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """key, path_names: names of the ids of a path in order, without unknown ones."""
    steps = df.select(key, F.posexplode_outer(path_col).alias("pos", id_col))
    named = steps.join(dim.select(id_col, F.col(name_col).alias("_name")), id_col, "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("pos", "_name"))))
    return named.groupBy(key).agg(F.transform(pairs, lambda p: p["_name"]).alias("path_names"))


def unique_names(tree: DataFrame, folded: Column, id_col: str = "id") -> DataFrame:
    """folded, id: names whose folded form occurs once."""
    return tree.select(folded.alias("folded"), id_col).groupBy("folded").agg(F.count("*").alias("n"), F.first(id_col).alias(id_col)).where("n = 1").drop("n")


def require_total_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join; raises if a row of left has no match."""
    lacking = left.join(right, on, "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} rows have no match")
    return left.join(right, on)


def removable(missing: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Missing items that no other scope lists."""
    return missing.join(members.select(*on), on, "left_anti")


def due_sources(sources: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Sources (source, next_at) that are due: loaded once, nothing active, no failure without a later success."""
    done = jobs.where("status = 'F'").groupBy("source").agg(F.max("at").alias("done_at"))
    active = jobs.where("status = 'O'").select("source").distinct()
    failed = jobs.where("status = 'P'").groupBy("source").agg(F.max("at").alias("failed_at"))
    loaded = sources.join(done, "source").join(active, "source", "left_anti").join(failed, "source", "left")
    return loaded.where((F.col("next_at") <= now) & (F.col("failed_at").isNull() | (F.col("failed_at") <= F.col("done_at")))).select("source", "next_at", "done_at")


# -- queries of a shop front ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchQuery:
    """The parameters of a product search, as a visitor may give them."""

    q: str | None = None
    category_id: str | None = None
    team_id: str | None = None
    league_id: str | None = None
    facet_id: str | None = None
    page: int = 1
    limit: int = 15

    @classmethod
    def normalise(cls, **given) -> SearchQuery:
        """Blank and invalid filters are no filters; numbers are held within their bounds."""
        import re

        q = "".join(c for c in unicodedata.normalize("NFD", str(given.get("q") or "")) if not "̀" <= c <= "ͯ").lower()
        q = " ".join(q.split())[:120] or None
        slug = lambda v: v if isinstance(v, str) and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_/#-]{0,119}", v) else None

        def number(name: str, default: int, most: int) -> int:
            try:
                return max(1, min(int(given.get(name) or default), most))
            except (TypeError, ValueError):
                return default

        return cls(q, *(slug(given.get(n)) for n in ("category_id", "team_id", "league_id", "facet_id")), number("page", 1, 100_000), number("limit", 15, 30))


def with_membership(df: DataFrame, bridge: DataFrame, key: str, column: str, value: str) -> DataFrame:
    return df.join(bridge.where(F.col(column) == value).select(key), key, "left_semi")


def search_products(products: DataFrame, query: SearchQuery, categories: DataFrame | None = None, facets: DataFrame | None = None, key: str = "product_id", wildcards: bool = True) -> DataFrame:
    """Products that fit all filters given. In q, % and _ are wildcards unless wildcards is off."""
    out = products
    if query.q:
        out = out.where(F.col("search_text").like(f"%{query.q}%") if wildcards else F.col("search_text").contains(query.q))
    if query.team_id:
        out = out.where(F.col("team_id") == query.team_id)
    if query.league_id:
        out = out.where(F.col("league_id") == query.league_id)
    if query.category_id and categories is not None:
        out = with_membership(out, categories, key, "category_id", query.category_id)
    if query.facet_id and facets is not None:
        out = with_membership(out, facets, key, "facet_id", query.facet_id)
    return out


def list_dim(dim: DataFrame, **filters) -> DataFrame:
    """Dimension rows with products, by the filters given."""
    out = dim.where("product_count > 0")
    for c, v in filters.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out


def team_facets(products: DataFrame, bridge: DataFrame, team_id: str, key: str = "product_id") -> DataFrame:
    """Facets of a team's products with the number of these products."""
    rows = products.where(F.col("team_id") == team_id).select(key).join(bridge, key)
    return rows.groupBy("facet_id").agg(F.countDistinct(key).alias("product_count"))


def product_view(products: DataFrame) -> DataFrame:
    """What a visitor sees of a product: display values before source values, empty for null."""
    show = lambda *c: F.coalesce(filled(*[F.col(x) for x in c]), F.lit(""))
    return products.select("product_id", show("display_name", "source_name").alias("name"), show("display_category", "category_name").alias("category"), F.coalesce("image_count", F.lit(0)).alias("image_count"))


def find_leaks(df: DataFrame, key: str, columns: list[str], patterns: list[str]) -> DataFrame:
    """key, column of each text that holds a forbidden pattern (lower case)."""
    hit = lambda c: reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(p) for p in patterns])
    flags = F.filter(F.array(*[F.when(hit(c), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.select(key, F.explode(flags).alias("column"))


def leak_gate(df: DataFrame, patterns: list[str]) -> int:
    """The number of rows that hold a forbidden pattern in any string column."""
    columns = [c for c, t in df.dtypes if t == "string"]
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(p) for c in columns for p in patterns], F.lit(False))
    return df.where(hit).count()


def is_navigation_category(col: Column, patterns: tuple[str, ...] = (), uncategorised: str = "uncategorised") -> Column:
    """Whether a category's name can stand in a navigation: neither blank, nor the catch-all, nor one of the caller's patterns."""
    from tidemark.functions.text import fold

    text = F.coalesce(col, F.lit(""))
    shown = (text != "") & (fold(text) != uncategorised)
    return shown & ~text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else shown


def bad_ids(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """column, value of each id that doesn't have the form of its prefix."""
    from tidemark.functions.ids import is_opaque

    return reduce(DataFrame.unionByName, [df.where(~is_opaque(F.col(c), p)).select(F.lit(c).alias("column"), F.col(c).alias("value")) for c, p in rules.items()])


def public_columns(df: DataFrame, allow: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in allow])


def media_view(products: DataFrame) -> DataFrame:
    """product_id, media: the rich list, or else the plain addresses; thumb and download default to the address, blank ones go."""
    plain = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("thumb"), F.lit(None).cast("string").alias("download")))
    rich = F.when(F.size(F.coalesce("media", F.array().cast("array<struct<url:string,thumb:string,download:string>>"))) > 0, F.col("media"))
    full = F.transform(F.coalesce(rich, plain), lambda m: F.struct(m["url"].alias("url"), F.coalesce(filled(m["thumb"]), m["url"]).alias("thumb"), F.coalesce(filled(m["download"]), m["url"]).alias("download")))
    return products.select("product_id", F.filter(full, lambda m: F.coalesce(m["url"], F.lit("")) != "").alias("media"))
