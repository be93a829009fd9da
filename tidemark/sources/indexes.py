"""A listing index in hash buckets of its key, to which promotions add only what changed.

Rows lie in a bucketed table; each write adds its rows to their buckets, and the last committed write of a key counts. So
a promotion is one join, partition by partition, to which only the observations are shuffled, and it writes as much as
has changed. A compaction writes the buckets anew once there are many writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sync import change_of, promoted_row
from tidemark.sources.commits import Conflict, commit, latest

VALUES = "fingerprint string, category_id string, category_path_ids array<string>, detail_fingerprint string, status string, miss_count int, changed_at timestamp"
NAMES = [c.strip().split(" ")[0] for c in VALUES.split(",")]
#: Writes after which reading would merge too many versions of a key.
MOST_WRITES = 8
#: Labels that a commit remembers.
MOST_LABELS = 100


class ListingIndex:
    """An index below root: source_id and VALUES. ``buckets`` counts only when the first base is written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.number, self.names = -1, {}
        self.refresh()

    def refresh(self) -> None:
        """See what other writers have committed."""
        self.number, state = latest(self.spark, self.root)
        self.base, self.writes, self.buckets = state.get("base"), state.get("writes", []), state.get("buckets", self.buckets)
        self.labels = state.get("labels", [])

    def _opened(self, base: str) -> str:
        if base not in self.names:
            self.names[base] = f"listing_index_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self.names[base]} (source_id string, {VALUES}, _write string) using parquet clustered by (source_id) sorted by (source_id) into {self.buckets} buckets location '{self.root}/{base}'")
        self.spark.catalog.refreshTable(self.names[base])
        return self.names[base]

    def table(self) -> DataFrame:
        """The committed rows, the last write of each key; no shuffle."""
        if self.base is None:
            return self.spark.createDataFrame([], f"source_id string, {VALUES}")
        rows = self.spark.table(self._opened(self.base)).where(F.col("_write").isin(self.writes))
        if len(self.writes) == 1:
            return rows.drop("_write")
        order = F.array_position(F.array(*[F.lit(w) for w in self.writes]), F.col("_write"))
        return rows.groupBy("source_id").agg(F.max_by(F.struct(*NAMES), order).alias("r")).select("source_id", "r.*")

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        self.names = {}

    def _commit(self, base: str, writes: list[str], label: str | None = None) -> None:
        labels = [*self.labels, *([label] if label is not None else [])][-MOST_LABELS:]
        if not commit(self.spark, self.root, self.number + 1, {"base": base, "writes": writes, "buckets": self.buckets, "labels": labels}):
            raise Conflict("another writer has changed the index; refresh and try again")
        self.refresh()

    def _add(self, rows: DataFrame, label: str | None = None) -> None:
        """Append rows and commit them; rows of a write that fails or loses are never read."""
        write = uuid.uuid4().hex
        rows.select("source_id", *NAMES, F.lit(write).alias("_write")).write.insertInto(self._opened(self.base))
        self._commit(self.base, [*self.writes, write], label)
        if len(self.writes) > MOST_WRITES:
            self.rewrite(self.table())

    def rewrite(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Make rows the whole index, in buckets of their own."""
        base, write = f"base-{uuid.uuid4().hex}", uuid.uuid4().hex
        self.buckets = buckets or self.buckets
        rows.select("source_id", *NAMES, F.lit(write).alias("_write")).repartition(self.buckets, "source_id").write.insertInto(self._opened(base))
        self._commit(base, [write])

    def promote(self, observations: DataFrame, now: Column, threshold: int = 3, label: str | None = None) -> None:
        """What sync.promote does with the events of sync.plan_delta; only rows that differ from the index are written. The label, say a
        run's id, is committed with them."""
        if self.base is None:
            self.rewrite(self.table().limit(0))
        old = self.table().select("source_id", F.struct(*NAMES).alias("p"))
        new = observations.select("source_id", F.struct("fingerprint", "category_id", "category_path_ids").alias("c"))
        both = old.hint("merge").join(new, "source_id", "full_outer")
        kind, misses, _ = change_of(F.col("p"), F.col("c"), threshold)
        rows = both.select("source_id", "p", F.struct(*promoted_row(F.col("p"), F.col("c"), kind, misses, now)).alias("n"))
        self._add(rows.where(~F.col("n").eqNullSafe(F.col("p"))).select("source_id", "n.*"), label)

    def upsert(self, rows: DataFrame, columns: list[str]) -> None:
        """Set columns of the keys in rows (source_id and columns); other columns keep their values, new keys have null there."""
        old = self.table().select("source_id", F.struct(*NAMES).alias("p"))
        given = rows.select("source_id", F.struct(*columns).alias("g"))
        both = old.hint("merge").join(given, "source_id", "right")
        self._add(both.select("source_id", *[F.col(f"g.{c}" if c in columns else f"p.{c}").alias(c) for c in NAMES]))
