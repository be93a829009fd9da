"""Incremental classification against full runs, over random deltas."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import classify
from tidemark.sources.shared import stored

NAMES = ["red bolt", "cold ring 24/25", "nothing", "bolt ring", "old cold bolt", "red", ""]


def test_random_deltas(spark):
    rng = random.Random(3)
    aliases = [("team", "bolt", "bolt", 0), ("team", "ring", "ring", 1), ("league", "la", "la", 0), ("facet", "cold", "cold", 0), ("facet", "old", "old", 1)]
    pack = classify.Pack(
        spark.createDataFrame([(*a, 0) for a in aliases], "kind string, id string, alias string, ordinal long, alias_ordinal int"),
        spark.createDataFrame([("bolt", "la", False), ("ring", None, False)], "id string, league_id string, national boolean"),
        spark.createDataFrame([("cold", "version", 0), ("old", "style", 1)], "id string, facet_type string, sort_order int"),
    )
    rest = {
        "categories": spark.createDataFrame([("c", "la"), ("d", "D")], "id string, name string"), "overrides": spark.createDataFrame([(3, '{"teamId":"ring"}')], "record long, json string"),
        "leagues": spark.createDataFrame([("la",)], "id string"), "teams": pack.teams.select("id"), "facets": pack.facets.select("id"),
    }
    frame = lambda items: {"products": spark.createDataFrame([(i, n, "x", [c]) for i, (n, c) in items.items()], "record long, name string, category string, category_path_ids array<string>")} | rest
    items = {i: (rng.choice(NAMES[:-1]), rng.choice("cd")) for i in range(30)}
    kept = lambda out: {k: stored(df, k) for k, df in out.items()}
    now = kept(classify.classify_catalog(frame(items), pack, "v1", "key"))
    for n in range(3):
        changed = rng.sample(sorted(items), 4)
        for i in changed:
            items[i] = (rng.choice(NAMES[:-1]), rng.choice("cd"))
        for i in rng.sample(sorted(set(items) - set(changed)), 2):
            del items[i]
        items[100 + n] = ("red bolt", "c")
        events = spark.createDataFrame([(i,) for i in changed], "record long")
        now = kept(classify.reclassify_catalog(frame(items), now, events, pack, "v1", "key"))
    full = classify.classify_catalog(frame(items), pack, "v1", "key")
    for name in full:
        columns = [F.to_json(F.struct(*sorted(full[name].columns))).alias("row")]
        assert sorted(r[0] for r in now[name].select(*columns).collect()) == sorted(r[0] for r in full[name].select(*columns).collect()), name
    same = classify.reclassify_catalog(frame(items), now, spark.createDataFrame([], "record long"), pack, "v1", "key")
    assert same["products"].count() == len(items)
