"""Exact dedup against a persistent digest index, in DataFrame functions alone.

The index is a table bucketed and sorted by digest. New data meets it in a sort-merge anti-join to which only the new
side is shuffled, and what is new is appended to the same buckets. So the index outlives a session, and a batch costs a
scan of the index' digests, never a shuffle of it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, scratch, stored

#: Rows of the index a bucket holds at most when it is created for a known number of rows.
BUCKET_ROWS = 2_000_000
#: A digest of more than a HEAVY-th of all rows is joined by a broadcast: fewer than HEAVY digests can be so frequent.
HEAVY = 1000

COLUMNS = "digest binary, keep_id bigint, source string, row bigint"


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, row: a number that tells repeated rows apart; stored, so that it stays the same."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """Digests below root, one row a distinct text: digest, keep_id, and the row (source, row) that stays.

    root holds a folder a version, named v<version>b<buckets>; the highest complete one counts. ``buckets`` is only
    used where root holds none yet.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets, self.version = spark, root.rstrip("/"), buckets, 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            for s in fs.listStatus(path):
                found = re.fullmatch(r"v(\d+)b(\d+)", s.getPath().getName())
                complete = found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
                if complete and int(found[1]) >= self.version:
                    self.version, self.buckets = int(found[1]), int(found[2])
        self._open()

    def _open(self) -> None:
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {self.name} ({COLUMNS}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.root}/v{self.version}b{self.buckets}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame, source: str) -> None:
        """Add the digests of new (doc_id, digest, row) that the index lacks, each with its smallest doc_id (null ids come
        last). Appending the same rows again changes nothing."""
        first = new.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("row"))
        lacking = first.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        lacking.select("digest", "keep_id", F.lit(source).alias("source"), "row").write.insertInto(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Write the index anew with one sorted file a bucket, or with another number of buckets, as the next version."""
        old = self.table()
        self.version, self.buckets = self.version + 1, buckets or self.buckets
        self._open()
        old.repartition(self.buckets, "digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Forget the table; its files stay for the next session."""
        self.spark.sql(f"drop table if exists {self.name}")

    def assign(self, rows: DataFrame, source: str) -> DataFrame:
        """doc_id, keep_id, group_size (among rows), kept, text_sha256 of each of rows, whose digests are in the index."""
        total = rows.count()
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        index = self.table().withColumnsRenamed({"row": "keep_row"})
        groups = stored(sizes.hint("merge").join(index, "digest"), "groups")
        often = F.col("group_size") * HEAVY > total
        heavy = groups.where(often)  # fewer than HEAVY rows
        out = rows.join(F.broadcast(heavy), "digest")
        rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        out = out.unionByName(rest.hint("merge").join(groups.where(~often), "digest"))
        kept = (F.col("source") == source) & (F.col("row") == F.col("keep_row"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each of docs (doc_id, text).

    docs go into the index in ``batches`` parts by rising doc_id, so that of equal texts the smallest doc_id stays, unless the
    index had the text before: then none of docs is kept. Null texts count as empty; null doc_ids come after all others;
    of wholly repeated rows one is kept. Without an index a new one is made in the shared folder. An empty table gives an
    empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = digests(docs)
    if index is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = DigestIndex(spark, scratch(spark, "index"), max(least, -(-rows.count() // BUCKET_ROWS)))
    source = uuid.uuid4().hex
    cuts = [i / batches for i in range(1, batches)]
    ends = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts)).first()[0] or [])) if cuts else []
    part = sum((F.coalesce(F.col("doc_id") > e, F.lit(True)).cast("int") for e in ends), F.lit(0))
    for i in range(len(ends) + 1):
        index.append(rows.where(part == i), source)
    return index.assign(rows, source)


#: What deduplicate gives with a new index, over the view "documents".
SQL = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  row_number() over (partition by h order by doc_id nulls last) = 1 as kept, h as text_sha256 from n
"""
