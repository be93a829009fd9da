"""Integrity battery, reconciliations, audits and gates of a catalog."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The count checks in their order. Those in METRICS describe a catalog and are no faults by themselves.
CHECKS = ("products", "states_current", "version_gap", "override_flag", "leaks", "category_missing", "primary_media_missing", "image_count", "media_orphans", "category_orphans", "facet_orphans", "category_count", "team_count", "league_count", "facet_count", "intelligence_current", "intelligence_gap", "intelligence_override_flag", "review_required", "research_required", "conflicts", "navigation_meta", "merchandising_meta")
METRICS = ("products", "states_current", "intelligence_current", "review_required", "research_required", "conflicts", "navigation_meta", "merchandising_meta")


def count_mismatches(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, stored, actual of each dimension row whose stored product_count isn't the number of its facts."""
    n = facts.groupBy(key).agg(F.count("*").alias("actual"))
    both = dim.select(key, F.col("product_count").alias("stored")).join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where("stored <> actual")


def version_gaps(products: DataFrame, state: DataFrame, overrides: DataFrame, version: str) -> DataFrame:
    """gap, k of products without a state of this version, and of states whose override flag disagrees."""
    current = state.where(F.col("version") == version)
    missing = products.select("k").join(current, "k", "left_anti").select(F.lit("version").alias("gap"), "k")
    flags = state.join(overrides.select("k", F.lit(True).alias("_has")).distinct(), "k", "left").where(F.col("override_applied") != F.coalesce("_has", F.lit(False)))
    return missing.unionByName(flags.select(F.lit("override_flag").alias("gap"), "k"))


def _meta_checks(meta: DataFrame, contract: int) -> dict[str, Column]:
    """Aggregates of a meta table (key, value): rows with a filled navigation array, and with valid merchandising data."""
    value = F.trim("value")
    valid = F.try_parse_json(value)
    number = lambda path: F.try_variant_get(valid, path, "int")  # noqa: E731  a text of a number counts as one
    navigation = (F.col("key") == "navigation") & valid.isNotNull() & value.startswith("[") & (value != "[]")
    merchandising = (F.col("key") == "merchandising") & (number("$.contractVersion") == contract) & (number("$.navigationItems") > 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return {"navigation_meta": count(navigation), "merchandising_meta": count(merchandising)}


def _leak(df: DataFrame, patterns: list[str]) -> Column:
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(x) for c in texts for x in patterns], F.lit(False))


def row_checks(t: dict[str, DataFrame], patterns: list[str], contract: int = 1) -> dict[str, dict[str, Column]]:
    """The checks of a battery that each row of a table answers by itself, as aggregates by table and name."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return {
        "products": {"products": F.count(F.lit(1)), "leaks": count(_leak(t["products"], patterns))},
        "intelligence": {"review_required": count(F.col("review_required")), "research_required": count(F.col("research_required")), "conflicts": count(F.col("conflict_count") > 0)},
        "meta": _meta_checks(t["meta"], contract),
    }


def write_checked(t: dict[str, DataFrame], root: str, patterns: list[str], contract: int = 1) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Write the tables of a battery below root and answer its row checks on the way, by observations of the writes: the tables
    as they are read again, and the totals by check. No table is read for them."""
    checks, totals, out = row_checks(t, patterns, contract), {}, {}
    for name, df in t.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}") if name in checks else None
        (df.observe(seen, *[c.alias(k) for k, c in checks[name].items()]) if seen else df).write.parquet(f"{root}/{name}")
        totals |= {k: int(v or 0) for k, v in seen.get.items()} if seen else {}
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
    return out, totals


def run_battery(t: dict[str, DataFrame], version: str, patterns: list[str], contract: int = 1, observed: dict[str, int] | None = None) -> DataFrame:
    """check_no, name, total of each count check, in the order of CHECKS.

    t: products (k, category_id, team_id, league_id, image_count, primary_media_id, text columns), categories, teams,
    leagues, facets, product_categories, product_facets, product_media, media, state (k, version, override_applied),
    intelligence (k, version, override_applied, review_required, research_required, conflict_count, state_json),
    overrides and meta (key, value). Each table is read for one aggregate, with its parents joined to it as flags. Totals in
    ``observed`` (of write_checked) are taken as they are, and what they alone need isn't read.
    """
    flag = lambda df, key, name: df.select(key, F.lit(True).alias(name)).distinct()
    p, m = t["products"], t["media"].where("active")
    has_override = flag(t["overrides"], "k", "_override")
    is_product, is_media = flag(p, "k", "_product"), flag(m, "media_id", "_media")
    leak = _leak(p, patterns)
    no = lambda c: F.coalesce(F.col(c), F.lit(False)) == F.lit(False)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    current = {"state": F.col("version") == version, "intelligence": (F.col("version") == version) & F.try_parse_json("state_json").isNotNull()}

    rows = p.withColumn("_leak", leak).join(flag(t["categories"], "category_id", "_category"), "category_id", "left")
    rows = rows.join(is_media.withColumnRenamed("media_id", "primary_media_id"), "primary_media_id", "left").join(t["product_media"].groupBy("k").agg(F.count("*").alias("_n")), "k", "left")
    for name, now in current.items():
        rows = rows.join(t[name].where(now).select("k", F.lit(True).alias(f"_{name}")).distinct(), "k", "left")
    aggregates = [rows.agg(
        F.count("*").alias("products"), count(F.col("_state")).alias("states_current"), count(no("_state")).alias("version_gap"), count(F.col("_leak")).alias("leaks"), count(no("_category")).alias("category_missing"),
        count((F.col("image_count") > 0) & no("_media")).alias("primary_media_missing"), count(F.col("image_count") != F.coalesce("_n", F.lit(0))).alias("image_count"),
        count(F.col("_intelligence")).alias("intelligence_current"), count(no("_intelligence")).alias("intelligence_gap"),
    )]
    mismatch = count(F.col("override_applied") == no("_override"))
    aggregates.append(t["state"].join(has_override, "k", "left").agg(mismatch.alias("override_flag")))
    aggregates.append(t["intelligence"].join(has_override, "k", "left").agg(mismatch.alias("intelligence_override_flag"), count(F.col("review_required")).alias("review_required"), count(F.col("research_required")).alias("research_required"), count(F.col("conflict_count") > 0).alias("conflicts")))
    bridges = (("media_orphans", t["product_media"], is_media, "media_id", "_media"), ("category_orphans", t["product_categories"], flag(t["categories"], "category_id", "_category"), "category_id", "_category"), ("facet_orphans", t["product_facets"], flag(t["facets"], "facet_id", "_facet"), "facet_id", "_facet"))
    for name, bridge, parent, key, has in bridges:
        aggregates.append(bridge.join(is_product, "k", "left").join(parent, key, "left").agg(count(no("_product") | no(has)).alias(name)))
    dims = (("category_count", t["categories"], t["product_categories"], "category_id"), ("team_count", t["teams"], p, "team_id"), ("league_count", t["leagues"], p, "league_id"), ("facet_count", t["facets"], t["product_facets"], "facet_id"))
    for name, dim, facts, key in dims:
        aggregates.append(count_mismatches(dim, facts, key).agg(F.count("*").alias(name)))
    aggregates.append(t["meta"].agg(*[c.alias(name) for name, c in _meta_checks(t["meta"], contract).items()]))
    listed = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(CHECKS.index(c)).alias("check_no"), F.lit(c).alias("name"), F.col(c).alias("total")) for c in df.columns])).alias("c")).select("c.*")
    given = observed or {}
    parts = [listed(df.drop(*given)) for df in aggregates if set(df.columns) - set(given)]
    if given:
        parts.append(p.sparkSession.createDataFrame([(CHECKS.index(k), k, v) for k, v in given.items()], "check_no int, name string, total long"))
    return reduce(DataFrame.unionByName, parts)


def findings(battery: DataFrame) -> DataFrame:
    """check_no, name, total of the checks that found a fault: counts that should be zero, an empty catalog, states or
    intelligence that aren't there for every product, and meta rows that aren't there once. One small table, one task."""
    total = lambda name: F.max(F.when(F.col("name") == name, F.col("total"))).over(W.partitionBy())
    fault = (
        F.when(F.col("name") == "products", F.col("total") < 1).when(F.col("name").isin("states_current", "intelligence_current"), F.col("total") != F.col("_products"))
        .when(F.col("name").isin("navigation_meta", "merchandising_meta"), F.col("total") != 1).when(F.col("name").isin(*METRICS), False).otherwise(F.col("total") > 0)
    )
    return battery.withColumn("_products", total("products")).where(fault).select("check_no", "name", "total")


def cap_findings(found: DataFrame, n: int = 32) -> DataFrame:
    """One row: the first findings in order, n at most."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("check_no", "name"))), lambda f: f["name"])
    return found.agg(F.slice(names, 1, n).alias("findings"))


def failure_code(found: DataFrame, prefix: str = "verification", n: int = 3) -> DataFrame:
    """One row: code of the first findings, null if there are none."""
    capped = cap_findings(found)
    return capped.select(F.when(F.size("findings") > 0, F.concat_ws("__", F.lit(prefix), F.slice("findings", 1, n))).alias("code"))


def finalize_gate(states: DataFrame, discovered: int, leaks: int, terminal: tuple[str, ...] = ("success", "skipped", "deferred", "failed")) -> DataFrame:
    """One row: terminal and gate (not_ready, invalid, leaking, ready) of an import."""
    n = states.agg(F.count_if(F.col("state").isin(*terminal)).alias("terminal"))
    gate = F.when(F.col("terminal") < discovered, "not_ready").when(F.col("terminal") > discovered, "invalid").when(F.lit(leaks > 0), "leaking").otherwise("ready")
    return n.withColumn("gate", gate)


def audit_media(products: DataFrame, manifest: DataFrame) -> DataFrame:
    """check, id of faults between products (product_id, images, media_ids) and a manifest (media_id, hash, refs)."""
    each = products.select("product_id", F.explode("media_ids").alias("media_id"))
    refs = each.groupBy("media_id").agg(F.count("*").alias("actual"))
    parts = (
        ("not_aligned", products.where(F.size("images") != F.size("media_ids")).select(F.col("product_id").alias("id"))),
        ("unknown_media", refs.join(manifest, "media_id", "left_anti").select(F.col("media_id").alias("id"))),
        ("id_is_not_hash", manifest.where(F.col("media_id") != F.concat(F.lit("m_"), F.substring("hash", 1, 20))).select(F.col("media_id").alias("id"))),
        ("ref_count", manifest.join(refs, "media_id", "left").where("refs <> coalesce(actual, 0)").select(F.col("media_id").alias("id"))),
    )
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("check"), F.col("id").cast("string").alias("id")) for k, d in parts])


def audit_ledger(members: DataFrame, state: DataFrame, kinds: DataFrame, allowed: tuple[str, ...] = ("category", "catalog", "source", "legacy")) -> DataFrame:
    """check, id of faults in a ledger: members that repeat or have no state, active items in no scope, unknown kinds."""
    parts = (
        ("duplicate_member", members.groupBy("scope_id", "public_id").count().where("count > 1").select(F.col("public_id").alias("id"))),
        ("member_without_state", members.select("public_id").distinct().join(state, "public_id", "left_anti").select(F.col("public_id").alias("id"))),
        ("active_without_scope", state.where("status = 'active'").select("public_id").join(members, "public_id", "left_anti").select(F.col("public_id").alias("id"))),
        ("unknown_kind", kinds.where(~F.col("kind").isin(*allowed)).select(F.col("scope_id").alias("id"))),
    )
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("check"), F.col("id").cast("string").alias("id")) for k, d in parts])


def publish_expectations(products: DataFrame, media_route: str, private: tuple[str, ...], tables: list[str]) -> DataFrame:
    """expectation, failed: media routes of the right form, no private table, no empty catalog."""
    routes = products.select(F.explode("media").alias("m")).agg(F.count_if(~F.col("m").rlike(media_route)).alias("failed")).select(F.lit("media_route").alias("expectation"), "failed")
    empty = products.agg((F.count("*") == 0).cast("long").alias("failed")).select(F.lit("not_empty").alias("expectation"), "failed")
    hidden = products.sparkSession.createDataFrame([("private_tables", sum(t in private for t in tables))], "expectation string, failed long")
    return routes.unionByName(empty).unionByName(hidden)
