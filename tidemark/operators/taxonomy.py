"""Category trees (id, name, parent_id): closures, trails, depths, used branches, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import fold
from tidemark.operators.ranking import global_positions
from tidemark.operators.tables import unique_names
from tidemark.sources.shared import stored

CAP = 8


def ancestors(tree: DataFrame, cap: int = CAP) -> DataFrame:
    """id, ancestor, distance: each node with itself (0) and all above it, up to cap; cycles end where they close.

    One join with the edges a level, in a chain whose plan grows by one join a level however often it is used.
    """
    edges = tree.select(F.col("id").alias("_c"), F.col("parent_id").alias("_p")).where("_p is not null")
    rows = tree.select("id", F.col("id").alias("_a0"))
    for d in range(1, cap + 1):
        rows = rows.join(edges.select(F.col("_c").alias(f"_c{d}"), F.col("_p").alias(f"_a{d}")), F.col(f"_a{d - 1}") == F.col(f"_c{d}"), "left").drop(f"_c{d}")
    chain = rows.select("id", F.array(*[f"_a{d}" for d in range(cap + 1)]).alias("_chain"))
    steps = chain.select("id", "_chain", F.posexplode("_chain").alias("distance", "ancestor"))
    seen = steps.where("ancestor is not null and array_position(_chain, ancestor) = distance + 1").select("id", "ancestor", "distance")
    return seen.join(tree.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", "distance")


def descendants(tree: DataFrame, cap: int = CAP) -> DataFrame:
    """id, descendant: the closure that rollups and subtree filters join with."""
    return ancestors(tree, cap).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"))


def trail(tree: DataFrame, cap: int = CAP) -> DataFrame:
    """id, path_ids from the root down to the node."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), F.col("ancestor").alias("a"))))
    return ancestors(tree, cap).groupBy("id").agg(F.transform(steps, lambda s: s["a"]).alias("path_ids"))


def depth(tree: DataFrame, cap: int = CAP) -> DataFrame:
    return ancestors(tree, cap).groupBy("id").agg(F.max("distance").alias("depth"))


def paths(tree: DataFrame) -> DataFrame:
    """id, path from the root down to the node, for trees of any depth.

    Each round doubles what is known of a path, so a tree of depth d takes log2(d) joins. A parent that isn't in the tree is none. A
    cycle is cut above its smallest id, which becomes a root.
    """
    known = tree.select(F.col("id").alias("_p")).distinct()
    edges = tree.groupBy("id").agg(F.min("parent_id").alias("_p")).join(known.withColumn("_in", F.lit(True)), "_p", "left")
    edges = stored(edges.select("id", F.when(F.col("_in"), F.col("_p")).alias("next")), "edges")
    rows = edges.select("id", F.array("id").alias("path"), "next")
    while True:
        # the farthest ancestor met again: from one place to the other the path is the whole cycle
        again = F.array_position(F.slice("path", 2, F.size("path")), F.get("path", F.lit(0))).cast("int")
        cut = rows.where(again > 0).select(F.array_min(F.slice("path", 1, again)).alias("id")).distinct()
        if not cut.isEmpty():
            cut = stored(cut.withColumn("_cut", F.lit(True)), "cut")
            edges = stored(edges.join(cut, "id", "left").select("id", F.when(F.col("_cut").isNull(), F.col("next")).alias("next")), "edges")
            rows = edges.select("id", F.array("id").alias("path"), "next")
        elif rows.where("next is not null").isEmpty():
            return rows.select("id", "path")
        above = rows.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("next").alias("_next"))
        joined = rows.join(above, F.col("next") == F.col("_id"), "left")
        rows = stored(joined.select("id", F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"), F.col("_next").alias("next")), "paths")


def intervals(tree: DataFrame) -> DataFrame:
    """id, pre, last, depth: the number of each node in a walk that meets parents before children, and that of the last node
    below it. Numbered once for a version of the tree; the subtree of a node is then pre..last."""
    rows = stored(paths(tree), "tree-paths")
    below = rows.select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("_n"))
    placed = global_positions(rows, ["path"], "pre")
    return placed.join(below, "id").select("id", "pre", (F.col("pre") + F.col("_n") - 1).alias("last"), (F.size("path") - 1).alias("depth"))


def rollup_by_intervals(numbered: DataFrame, direct: DataFrame, part: int = 100_000) -> DataFrame:
    """id, total: direct counts (id, n) summed over each node's subtree, as a difference of running sums; no closure.

    The running sums are made within parts of the walk, and shifted by the sums of the parts before.
    """
    each = numbered.join(direct.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", "pre", "last", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"pre div {part}").alias("_part"))
    sums = each.groupBy("_part").agg(F.sum("n").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(W.orderBy("_part")) - F.col("_s")).alias("_before"))  # a row a part
    inner = F.sum("n").over(W.partitionBy("_part").orderBy("pre"))
    running = each.withColumn("_inner", inner).join(F.broadcast(before), "_part").withColumn("upto", F.col("_inner") + F.col("_before"))
    ends = running.select(F.col("pre").alias("last"), F.col("upto").alias("_end"))
    return running.join(ends, "last").select("id", (F.col("_end") - F.col("upto") + F.col("n")).alias("total"))


def in_subtree(products: DataFrame, closure: DataFrame, category_id: str | None, path: str = "category_path_ids") -> DataFrame:
    """Products with a path id in the category's subtree; all for a blank one."""
    if not category_id:
        return products
    below = closure.where(F.col("id") == category_id).select(F.col("descendant").alias("_c"))
    hits = products.select("product_id", F.explode(path).alias("_c")).join(below, "_c", "left_semi").select("product_id").distinct()
    return products.join(hits, "product_id", "left_semi")


def child_categories(tree: DataFrame, counts: DataFrame, parent: str | None = None) -> DataFrame:
    """Children of a node (roots by default) that hold anything, most first."""
    level = tree.where(F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent)
    return level.join(counts, "id").where("total > 0").orderBy(F.desc("total"), "name", "id")


def used_taxonomy(tree: DataFrame, used: DataFrame, cap: int = CAP) -> DataFrame:
    """Nodes on the way to used ones (id), with depth, path_ids and child_ids (sorted, used ones only)."""
    keep = ancestors(tree, cap).join(used.select("id").distinct(), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    kept = tree.join(keep, "id", "left_semi")
    children = kept.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("child_ids"))
    out = kept.join(trail(tree, cap), "id").join(children, "id", "left")  # what is above a kept node is kept
    return out.select("id", "name", F.when(F.size("path_ids") > 1, F.col("parent_id")).alias("parent_id"), (F.size("path_ids") - 1).alias("depth"), "path_ids", F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))


def merge_category_entries(entries: DataFrame) -> DataFrame:
    """One entry an id of (id, pos, name, parent_id, url): a parent beats none, then the first filled value."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos"))).alias(c)
    return entries.groupBy("id").agg(first("name"), first("parent_id"), first("url"))


def resolve_category(products: DataFrame, source: DataFrame, tree: DataFrame) -> DataFrame:
    """product_id, category_id, how: the sourced category by id, else by a unique folded name (sourced, then public), else
    the category that the product has, else 'uncategorised'.

    products has product_id, category_id, category_name; source has product_id, source_id, source_name.
    """
    ids = tree.select(F.col("id").alias("by_id"))
    names = unique_names(tree, fold(F.col("name"))).select("folded", F.col("id").alias("by_name"))
    rows = products.join(source, "product_id", "left")
    rows = rows.join(ids, F.col("source_id") == F.col("by_id"), "left")
    for c, out in (("source_name", "by_source"), ("category_name", "by_public")):
        at = names.select(F.col("folded").alias(f"_{out}"), F.col("by_name").alias(out))
        rows = rows.join(at, fold(F.col(c)) == F.col(f"_{out}"), "left")
    has = rows.join(ids.select(F.col("by_id").alias("has")), F.col("category_id") == F.col("has"), "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_source").isNotNull(), "source name").when(F.col("by_public").isNotNull(), "name").when(F.col("has").isNotNull(), "kept").otherwise("uncategorised")
    return has.select("product_id", F.coalesce("by_id", "by_source", "by_public", "has", F.lit("uncategorised")).alias("category_id"), how.alias("how"))


def enrich_taxonomy(products: DataFrame, source: DataFrame, tree: DataFrame) -> DataFrame:
    """product_id, category_id, category_path_ids, how."""
    resolved = resolve_category(products, source, tree)
    paths = trail(tree).select(F.col("id").alias("category_id"), "path_ids")
    return resolved.join(paths, "category_id", "left").select("product_id", "category_id", F.coalesce("path_ids", F.array("category_id")).alias("category_path_ids"), "how")


def audit_taxonomy(tree: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """check, id of each fault in a tree with child_ids, depth and path_ids: the same id twice, a parent that isn't there,
    parents and children that don't name each other, depths and paths that don't follow from the parent."""
    parents = tree.select(F.col("id").alias("pid"), F.col("depth").alias("pdepth"), F.col("path_ids").alias("ppath"), F.col("child_ids").alias("pchildren"))
    up = tree.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("pid"), "left")
    down = tree.select(F.col("id").alias("of"), F.explode("child_ids").alias("cid")).join(tree.select("id", "parent_id"), F.col("cid") == F.col("id"), "left")
    faults = [
        ("duplicate_id", tree.groupBy("id").count().where("count > 1")),
        ("parent_missing", up.where("pid is null")),
        ("parent_does_not_list_child", up.where(F.col("pid").isNotNull() & ~F.array_contains("pchildren", F.col("id")))),
        ("child_has_other_parent", down.where(F.col("parent_id").isNull() | (F.col("parent_id") != F.col("of"))).select(F.col("cid").alias("id"))),
        ("depth", up.where("pid is not null and depth <> pdepth + 1").select("id").unionByName(tree.where("parent_id is null and depth <> 0").select("id"))),
        ("path_end", tree.where(F.col("id") != F.element_at("path_ids", -1))),
        ("path_chain", up.where(F.col("pid").isNotNull() & (F.col("path_ids") != F.concat("ppath", F.array("id"))))),
    ]
    if products is not None:
        at = products.select("product_id", F.explode("category_path_ids").alias("cid"))
        faults.append(("product_path", at.join(tree.select(F.col("id").alias("cid")), "cid", "left_anti").select(F.col("product_id").alias("id")).distinct()))
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("check"), F.col("id").cast("string").alias("id")) for k, d in faults])
