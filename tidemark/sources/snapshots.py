"""Snapshot documents, nested payloads, media files, contracts at the boundary; versioned publishing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import Conflict, commit, latest, remove
from tidemark.sources.shared import stored

SNAPSHOT = """taxonomy array<struct<id:string,name:string,parentId:string,childIds:array<string>,depth:int>>,
    products array<struct<id:string,name:string,category:string,categoryId:string,categoryPathIds:array<string>,description:string,images:array<string>,
    media:array<struct<url:string,thumb:string,download:string>>>>, generatedAt string"""


def read_catalog_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """products, taxonomy and meta of a snapshot document; one without products or taxonomy is refused."""
    doc = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    out = {name: doc.select(F.explode(name).alias("r")).select("r.*") for name in ("products", "taxonomy")}
    for name, df in out.items():
        if df.isEmpty():
            raise ValueError(f"the snapshot has no {name}")
    return out | {"meta": doc.select("generatedAt")}


def flatten_results(df: DataFrame, col: str = "payload") -> DataFrame:
    """value (JSON text) of each element of the results arrays of a JSON payload, however deep these are nested. Each level is
    stored once, so that a level costs what it holds."""
    inner = F.get_json_object("value", "$.results")
    now = df.select(F.col(col).alias("value"))
    out = [now.where(inner.isNull())]
    while True:
        now = stored(now.where(inner.isNotNull()).select(F.explode(F.from_json(inner, "array<string>")).alias("value")), "level")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(now.where(inner.isNull()))


def json_array_rows(df: DataFrame, key: str, col: str, schema: str = "array<string>") -> DataFrame:
    """key, pos, value of each element of a JSON array; a row of nulls for an empty or bad one."""
    return df.select(key, F.posexplode_outer(F.from_json(col, schema)).alias("pos", "value"))


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """media_id (m_ and 20 hex digits of the content), hash, bytes, path, format of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.concat(F.lit("m_"), F.substring(F.sha2("content", 256), 1, 20)).alias("media_id"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"), "path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"))


def unreferenced_media(files: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: number and bytes of stored files that nothing refers to; a report, nothing is deleted."""
    return files.join(refs.select("media_id"), "media_id", "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def detect_source(df: DataFrame, providers: dict[str, str], url: str = "url") -> DataFrame:
    """df with provider: that of the one rule (a pattern) that fits the address; null if none or several do."""
    hits = F.filter(F.array(*[F.when(F.col(url).rlike(p), F.lit(k)) for k, p in providers.items()]), lambda k: k.isNotNull())
    return df.withColumn("provider", F.when(F.size(hits) == 1, hits[0]))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule of each row that breaks a rule (a condition that should hold; null breaks it)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda k: k.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def check_observations(df: DataFrame) -> DataFrame:
    some = lambda c: F.trim(F.col(c)) != ""
    return violations(df, "source_id", {"source_id": some("source_id"), "fingerprint": F.col("fingerprint").rlike("^[a-f0-9]{64}$"), "category_path_ids": F.size("category_path_ids").between(0, 64)})


def check_details(df: DataFrame) -> DataFrame:
    return violations(df, "source_id", {"name": F.trim(F.col("name")) != "", "images": F.size("images") > 0, "kind": F.col("kind").isin("product", "navigation", "information")})


def publish_snapshot(tables: dict[str, DataFrame], root: str, run_id: str, after: int | None = None) -> int:
    """Write all tables below root/v=run_id, then commit a pointer to them, and return its number; an empty table is refused.

    Readers follow the last pointer (read_published), so they see the whole old or the whole new snapshot. Pointers are
    numbered, and a number is taken once, whatever the writers' clocks say. With ``after``, the number that this snapshot
    was made from, a pointer that came in between raises Conflict and the tables written go.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={run_id}/{name}")
        if spark.read.parquet(f"{root}/v={run_id}/{name}").isEmpty():
            raise ValueError(f"{name} is empty")
    while True:
        number = (latest(spark, root)[0] if after is None else after) + 1
        if commit(spark, root, number, {"run_id": run_id, "tables": list(tables)}):
            return number
        if after is not None:
            remove(spark, f"{root}/v={run_id}")
            raise Conflict(f"{number} is taken")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={latest(spark, root)[1]['run_id']}/{name}")
