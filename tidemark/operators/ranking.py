"""Order-dependent operators: first, best, latest, positions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.urls import image_group_key, image_score
from tidemark.sources.shared import stored

Order = list[str | Column]


def first_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row of each key; the order should be total. By columns alone it is an aggregate, which combines before the shuffle."""
    if all(isinstance(c, str) for c in order):
        rest = [c for c in df.columns if c not in keys]
        picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return picked.select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: list[str], order: Order, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by order, aggregated before the shuffle; no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def priority_pick(df: DataFrame, keys: list[str], status: str, ranks: list[str], order: Order) -> DataFrame:
    """The row of each key whose status comes first in ranks, then by order."""
    rank = F.lit(len(ranks))
    for i, r in reversed([*enumerate(ranks)]):
        rank = F.when(F.col(status) == r, i).otherwise(rank)
    return first_per_key(df, keys, [rank, *order])


def assign_positions(df: DataFrame, keys: list[str], order: Order, name: str = "position") -> DataFrame:
    """A running number from 0 within each key."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def small_ordinal(dim: DataFrame, by: str) -> DataFrame:
    """The dense number of each row of a small dictionary, by a column without ties. One task numbers it, so it is for dictionaries only."""
    return dim.withColumn("ordinal", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(by)) - 1).cast("long"))


def best_category(assignments: DataFrame, item: str = "item", depth: str = "depth", category: str = "category_id") -> DataFrame:
    """The deepest category of each item; of those the smallest id."""
    best = F.min(F.struct((-F.col(depth)).alias("d"), F.col(category).alias("c")))
    return assignments.groupBy(item).agg(best.alias("b")).select(item, F.col("b.c").alias(category), (-F.col("b.d")).alias(depth))


def merge_cards(cards: DataFrame, key: str, order: str) -> DataFrame:
    """One card a key: the first non-blank title and cover, the first count, the longest signal (first of equals)."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order)))
    longest = F.min_by("signal", F.struct(-F.length("signal"), F.col(order)))
    return cards.groupBy(key).agg(first("title").alias("title"), first("cover").alias("cover"), first("image_count").alias("image_count"), longest.alias("signal"))


def best_variants(images: DataFrame, item: str = "item") -> DataFrame:
    """item, group_key, full, display, thumb of images (item, pos, url, priority): the best address of each image for each
    purpose, the first of equal scores."""
    scored = images.withColumn("group_key", image_group_key(F.col("url"))).where("group_key is not null")
    best = lambda mode: F.max_by("url", F.struct(image_score(F.col("url"), F.col("priority"), mode), -F.col("pos")))
    out = scored.groupBy(item, "group_key").agg(best("full").alias("full"), best("display").alias("d"), best("thumb").alias("t"), F.min("pos").alias("pos"))
    return out.select(item, "group_key", "full", F.coalesce("d", "full").alias("display"), F.coalesce("t", "d", "full").alias("thumb"), "pos")


def last_by_hash(media: DataFrame, key: str, order: str) -> DataFrame:
    return latest_per_key(media, [key], [order])


def first_seen_order(items: DataFrame, key: str, order: str) -> DataFrame:
    return items.groupBy(key).agg(F.min(order).alias("first_seen"))


def top_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident candidate (id, confidence) of each key, ties by id."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("id")))
    return candidates.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.id").alias("id"), (-F.col("b.c")).alias("confidence"))


def dedupe_seasons(candidates: DataFrame, key: str) -> DataFrame:
    """The best confidence of each label, numbered by confidence, then by start."""
    best = candidates.groupBy(key, "label").agg(F.max("confidence").alias("confidence"))
    start = F.substring("label", 1, 4).cast("int")
    return best.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("confidence"), start, "label")))


def next_miss_count(status: Column, miss_count: Column, observed: Column) -> Column:
    """The miss counter after a run that may infer absence."""
    return F.when(observed, 0).when(status == "deleted", miss_count).otherwise(miss_count + 1)


def page(df: DataFrame, number: int = 1, limit: int = 15, order: tuple[str, ...] = ("sort_order", "product_id"), most: int = 30) -> DataFrame:
    """A page of df with total, total_pages, has_previous and has_more on each row; a top-k sort, not a full one.
    What page a request may ask for is limited where it is read (SearchQuery.normalise)."""
    number, limit = max(1, int(number)), max(1, min(int(limit), most))
    total = df.count()
    pages = max(1, -(-total // limit))
    rows = df.orderBy(*order).offset((number - 1) * limit).limit(limit)
    return rows.select("*", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("total_pages"), F.lit(number > 1).alias("has_previous"), F.lit(number < pages).alias("has_more"))


def scan_after(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows by key after a cursor; None starts from the beginning."""
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(n)


DIM_ORDER = {"category": ("depth", "sort_order", "name"), "league": ("sort_order", "name"), "team": ("-product_count", "name"), "facet": ("sort_order", "name")}


def order_dim(dim: DataFrame, kind: str) -> DataFrame:
    return dim.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in DIM_ORDER[kind]])


def global_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """A running number from 0 over all rows by a total order: range-sorted, numbered within parts, shifted by the parts before.

    The parts are stored, so that their bounds are the same for both reads; only a count for each part is gathered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id())
    dealt = stored(dealt, "positions")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_no").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a part
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_no") - F.col("_first") + F.col("_before")).drop("_part", "_no", "_first", "_before")
