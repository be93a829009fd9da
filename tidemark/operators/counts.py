"""Counts: dimensions, states, events, media, taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_counts(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """dim with product_count: facts of each of its keys, 0 where there are none."""
    n = facts.groupBy(key).agg(F.count("*").alias("product_count"))
    return dim.drop("product_count").join(n, key, "left").withColumn("product_count", F.coalesce("product_count", F.lit(0)))


def distinct_counts(bridge: DataFrame, facts: DataFrame, key: str, of: str) -> DataFrame:
    """Distinct facts by key, for keys that have any."""
    return bridge.join(facts.select(of), of, "left_semi").groupBy(key).agg(F.countDistinct(of).alias("product_count"))


def status_counts(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.coalesce(F.col(status) == v, F.lit(False))).alias(v) for v in values], F.count("*").alias("total"))


def state_histogram(df: DataFrame, state: str, states: list[str] | DataFrame) -> DataFrame:
    """Every state (of a list, or of a table's column of that name) with its count, 0 included."""
    every = states.select(state).distinct() if isinstance(states, DataFrame) else df.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    return every.join(df.groupBy(state).agg(F.count("*").alias("total")), state, "left").select(state, F.coalesce("total", F.lit(0)).alias("total"))


def path_counts(products: DataFrame, path: str = "category_path_ids") -> DataFrame:
    """Products by category, each category of a path counted once."""
    return products.select(F.explode(F.array_distinct(path)).alias("category_id")).groupBy("category_id").agg(F.count("*").alias("product_count"))


def rollup_counts(closure: DataFrame, direct: DataFrame, precomputed: DataFrame | None = None) -> DataFrame:
    """id, total: direct counts (id, n) summed over the descendants in closure (id, descendant); a precomputed count wins."""
    d = direct.select(F.col("id").alias("descendant"), "n")
    out = closure.join(d, "descendant", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    if precomputed is None:
        return out
    given = precomputed.select("id", F.col("n").alias("_given"))
    return out.join(given, "id", "left").select("id", F.coalesce("_given", "total").alias("total"))


def country_rollup(leagues: DataFrame) -> DataFrame:
    """Products and leagues by country, most products first."""
    return leagues.groupBy("country").agg(F.sum("product_count").alias("product_count"), F.count("*").alias("league_count")).orderBy(F.desc("product_count"), "country")


def navigation_counts(teams: DataFrame, facets: DataFrame) -> DataFrame:
    """kind, id, total: products by entity type, and by facet."""
    by_type = teams.groupBy("entity_type").agg(F.sum("product_count").alias("total")).select(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("id"), "total")
    return by_type.unionByName(facets.select(F.lit("facet").alias("kind"), F.col("facet_id").alias("id"), F.col("product_count").alias("total")))


def media_dedup_stats(media: DataFrame) -> DataFrame:
    """Logical and unique media (hash, bytes), and the bytes that sharing saves; one row, aggregated by hash before."""
    each = media.groupBy("hash").agg(F.count("*").alias("refs"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("one"))
    return each.agg(
        F.sum("refs").alias("logical"), F.count("*").alias("unique"), (F.sum("refs") - F.count("*")).alias("duplicates"),
        F.sum("bytes").alias("logical_bytes"), F.sum("one").alias("unique_bytes"), (F.sum("bytes") - F.sum("one")).alias("saved_bytes"), F.max("refs").alias("most_refs"),
    )


def media_formats(media: DataFrame) -> DataFrame:
    return media.groupBy("format").agg(F.count("*").alias("total"), F.sum("bytes").alias("bytes"))


def taxonomy_stats(depths: DataFrame, used: DataFrame) -> DataFrame:
    """One row: nodes, roots, nested ones, greatest depth, used ones; depths has id, depth."""
    marked = depths.join(used.select("id", F.lit(1).alias("_used")).distinct(), "id", "left")
    return marked.agg(
        F.count("*").alias("total"), F.count_if(F.col("depth") == 0).alias("roots"), F.count_if(F.col("depth") > 0).alias("nested"), F.max("depth").alias("max_depth"), F.count("_used").alias("used"))


def aggregate_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Best score and the sorted distinct sources of each key."""
    return matches.groupBy(*keys).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def exception_metrics(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if("review_required").alias("review"), F.count_if("research_required").alias("research"), F.count_if(F.col("conflict_count") > 0).alias("conflicts"))


def known_good_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count_if(F.col("status") != "deleted").alias("known_good"))


def scope_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("scope_id").agg(F.countDistinct("member").alias("members"))


def apply_counters(applied: DataFrame, outcomes: list[str]) -> DataFrame:
    return applied.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
