"""Stored structures for search and paging: trigram posting lists, and tables in order with a directory of their parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_positions
from tidemark.sources.shared import small

#: Characters of a gram, and the grams of a query that are intersected: its rarest.
GRAM, RAREST = 3, 4
#: Posting lists of one part of the index are written by so many tasks, so that a gram of nearly all texts is no single task's.
SALT = 16


def text_grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    at = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, GRAM)))


def query_grams(pattern: str) -> list[str]:
    """The grams that each text like %pattern% holds; % and _ stand for what isn't known."""
    return sorted({p[i : i + GRAM] for p in re.split("[%_]", pattern) for i in range(len(p) - GRAM + 1)})


class SearchIndex:
    """Posting lists below root, in ``parts`` partitions by gram; the texts beside them, in partitions by key."""

    def __init__(self, spark: SparkSession, root: str, key: str = "product_id", text: str = "search_text", parts: int = 64):
        self.spark, self.root, self.key, self.text, self.parts = spark, root, key, text, parts

    def _part(self, col: Column) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(self.parts)).cast("int")

    def build(self, products: DataFrame) -> None:
        """Keys should be unique; null texts are found by nothing."""
        rows = products.select(self.key, self.text).where(F.col(self.text).isNotNull())
        rows.withColumn("_part", self._part(F.col(self.key))).repartition("_part").sortWithinPartitions(self.key).write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/texts")
        lists = rows.select(self.key, F.explode(text_grams(F.col(self.text))).alias("gram")).withColumn("_part", self._part(F.col("gram")))
        dealt = lists.repartition("_part", F.pmod(F.xxhash64(self.key), F.lit(SALT))).sortWithinPartitions("gram", self.key)
        dealt.write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/postings")
        self.postings().groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.mode("overwrite").parquet(f"{self.root}/grams")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/texts")

    def candidates(self, pattern: str) -> DataFrame | None:
        """Keys of the texts that hold the rarest grams of a pattern; None if it has no gram. Only these grams' partitions are read."""
        grams = query_grams(pattern)
        if not grams:
            return None
        sizes = self.spark.read.parquet(f"{self.root}/grams").where(F.col("gram").isin(grams)).collect()  # a row a gram of the query
        lists = self.postings()
        if len(sizes) < len(grams):
            return lists.select(self.key).limit(0)
        rarest = [r["gram"] for r in sorted(sizes, key=lambda r: (r["n"], r["gram"]))[:RAREST]]
        where = self.spark.range(1).select(*[self._part(F.lit(g)).alias(f"p{i}") for i, g in enumerate(rarest)]).first()
        hits = lists.where(F.col("_part").isin(sorted(set(where))) & F.col("gram").isin(rarest))
        return hits.groupBy(self.key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(rarest)).select(self.key)

    def search(self, pattern: str) -> DataFrame:
        """key and text of the texts like %pattern%; patterns without a run of three known characters read all texts."""
        texts, found = self.texts(), self.candidates(pattern)
        if found is not None:
            hits = small(found.select(F.col(self.key).alias("_key")).withColumn("_in", self._part(F.col("_key"))))
            texts = texts.join(hits, (F.col("_part") == F.col("_in")) & (F.col(self.key) == F.col("_key")), "left_semi")
        return texts.where(F.col(self.text).like(f"%{pattern}%")).drop("_part")


class PagedTable:
    """A table in a total order below root: parts of so many rows each, and a directory of their first keys and row counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, df: DataFrame, order: list[str], rows: int = 100_000) -> None:
        placed = global_positions(df, order).withColumn("_part", F.expr(f"position div {rows}"))
        placed.write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/rows")
        stored = self.spark.read.parquet(f"{self.root}/rows")
        stored.groupBy("_part").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"), F.lit(rows).alias("size")).write.mode("overwrite").parquet(f"{self.root}/directory")

    def directory(self) -> DataFrame:
        """A row a part: _part, first (the smallest keys), n, size."""
        return self.spark.read.parquet(f"{self.root}/directory")

    def page(self, number: int = 1, limit: int = 15, most: int = 30) -> DataFrame:
        """What ranking.page gives, from the parts that hold the page alone; the total comes from the directory."""
        number, limit = max(1, int(number)), max(1, min(int(limit), most))
        on = self.directory().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("size"), F.lit(1)).alias("size")).first()
        total, begin = on["total"], (number - 1) * limit
        pages = max(1, -(-total // limit))
        parts = F.col("_part").between(begin // on["size"], (begin + limit - 1) // on["size"])
        rows = self.spark.read.parquet(f"{self.root}/rows").where(parts & F.col("position").between(begin, begin + limit - 1))
        return rows.orderBy("position").drop("_part", "position").select("*", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("total_pages"), F.lit(number > 1).alias("has_previous"), F.lit(number < pages).alias("has_more"))
