"""Long aliases by their rarest pair of words, against containment of each in each."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import classify


def pack_of(spark, aliases):
    rows = spark.createDataFrame([("x", str(i), a, i, 0) for i, a in enumerate(aliases)], "kind string, id string, alias string, ordinal long, alias_ordinal int")
    empty = spark.createDataFrame([], "id string, league_id string, national boolean, facet_type string, sort_order int")
    return classify.Pack(rows, empty, empty)


def test_long_aliases(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [(i, text(rng.randint(0, 30))) for i in range(120)] + [(500, "w1  W2, w3 w4"), (501, None), (502, "w1 w2 w3 w4")]
    aliases = sorted({text(rng.randint(1, 6)) for _ in range(80)} | {"w1 w2 w3 w4", "gone w1 w2 w3", "w1", "W1 w2-w3 w4"})
    got = classify.match_aliases(spark.createDataFrame(texts, "record long, text string"), pack_of(spark, aliases)).select("record", "id", "whole").collect()
    fold = lambda x: " ".join((x or "").lower().replace(",", " ").replace("-", " ").split())
    expected = {(r, str(i), fold(x) == fold(a)) for r, x in texts for i, a in enumerate(aliases) if f" {fold(a)} " in f" {fold(x)} "}
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 500


def test_rows_follow_the_hits(spark):
    """100,000 aliases of up to 12 words of a vocabulary that texts use as well."""
    n = 100_000
    word = lambda seed: F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3000)).cast("string"))
    made = spark.range(n).select("id", F.concat_ws(" ", *[F.when(F.col("id") % 12 >= i, word(i)) for i in range(12)]).alias("alias"))
    aliases = made.select(F.lit("x").alias("kind"), F.col("id").cast("string").alias("id"), "alias", F.col("id").alias("ordinal"), F.lit(0).alias("alias_ordinal")).where("id % 12 > 0")
    texts = spark.range(2000).select(F.col("id").alias("record"), (F.col("id") * 37).alias("id")).join(made, "id").select("record", F.concat_ws(" ", word(50), word(51), "alias", word(52), "alias", word(53)).alias("_folded"))
    dim = aliases.withColumn("token", F.col("alias"))
    candidates = classify.rare_gram_candidates(texts, dim).count()
    hits = classify.rare_gram_matches(texts, dim).count()
    assert hits > 1800 and candidates <= 3 * hits


def test_hits_of_a_small_file_are_found_by_many_tasks(spark):
    """Records of one partition are dealt out before their words are; the hits come from as many tasks as a shuffle has."""
    aliases = spark.createDataFrame([("team", "t", "bolt", 0, 0)], "kind string, id string, alias string, ordinal long, alias_ordinal int")
    empty = spark.createDataFrame([], "id string, league_id string, national boolean, facet_type string, sort_order int")
    records = spark.range(40).coalesce(1).selectExpr("id as record", "'red bolt' as name", "'c' as category", "array('p') as path")
    hits = classify.alias_hits(records, classify.Pack(aliases, empty, empty))
    assert hits.where("field = 'title'").count() == 40 and len(hits.inputFiles()) > 1
