"""Posting lists against containment, pages against a sort."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranking import page
from tidemark.operators.search import PagedTable, SearchIndex


def test_search(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{i}", "".join(rng.choice("abé ") for _ in range(rng.randint(0, 14)))) for i in range(300)] + [("none", None), ("long", "ab" * 5000 + "zzz"), ("twice", "abababab")]
    index = SearchIndex(spark, str(tmp_path / "index"), parts=8)
    index.build(spark.createDataFrame(rows, "product_id string, search_text string"))
    for q in ["aba", "b é", "abab", "zzz", "qqq", "a", "ab%ba", "aba_b", "é a%", "%"]:
        pattern = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in q), re.S)
        got = sorted(r["product_id"] for r in index.search(q).collect())
        assert got == sorted(k for k, x in rows if x is not None and pattern.search(x)), q
    plan = index.candidates("zzz")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part#\d+ = \d", plan), plan


@pytest.mark.parametrize("size", [7, 1000])
def test_pages(spark, tmp_path, size):
    df = spark.range(103).select((F.col("id") * 37 % 103).alias("sort_order"), F.col("id").cast("string").alias("product_id"))
    table = PagedTable(spark, str(tmp_path / "rows"))
    table.build(df, ["sort_order", "product_id"], size)
    for number in (1, 2, 5, 11, 12, 40):
        assert [tuple(r) for r in table.page(number, 10).collect()] == [tuple(r) for r in page(df, number, 10).collect()], number
    assert table.directory().count() == -(-103 // size)


def test_pages_beyond_the_hundred_thousandth(spark, tmp_path):
    df = spark.range(100_005).select(F.col("id").alias("sort_order"), F.col("id").cast("string").alias("product_id"))
    table = PagedTable(spark, str(tmp_path / "rows"))
    table.build(df, ["sort_order", "product_id"], 30_000)
    for found in (table.page(100_003, 1), page(df, 100_003, 1)):
        assert [tuple(r) for r in found.collect()] == [(100_002, "100002", 100_005, 100_005, True, True)]
