"""Hard-negative mining with segment summaries.

Each vector is stored with the mean and deviation of its segments, at several levels of ever shorter segments. For two
vectors the product of the means, plus or minus the product of the deviations, summed over the segments, bounds their
inner product (Cauchy-Schwarz on what is left of the means). A task goes through the levels from coarse to fine, keeps
the pairs whose bounds still reach into the window asked for, and scores only the last ones exactly.

Anchors go in blocks of a fixed size; each block meets all vectors where these lie, and only the best few of each task
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import forget, scratch, small_batches, stored
from tidemark.llm.vectors import common_width, entries, floored, matrix
from tidemark.operators.ranking import global_positions

#: Anchors a block: what is broadcast is bounded by it. Anchors and rows of one matrix of pairs.
BLOCK, ANCHORS, ROWS = 4096, 512, 2048
LONG = np.iinfo(np.int64)
#: Bounds are computed from summaries in single precision; so much of the lengths' product covers the rounding.
SLACK = 1e-5

VECTORS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.int64())), ("mean", pa.list_(pa.float32())), ("deviation", pa.list_(pa.float32()))])


def levels(width: int) -> list[np.ndarray]:
    """The starts of the segments of each level: one segment, then four times as many, down to two entries a segment."""
    out, n = [], 1
    while n == 1 or 2 * n <= width:
        out.append(np.arange(n) * width // n)
        n *= 4
    return out


def summaries(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean (times the root of the length) and deviation (root of the squares' sum) of each segment of each row."""
    lengths = np.diff([*starts, x.shape[1]])
    means = np.add.reduceat(x, starts, axis=1) / lengths
    off = x - np.repeat(means, lengths, axis=1)
    return means * np.sqrt(lengths), np.sqrt(np.add.reduceat(off**2, starts, axis=1))


def vector_table(embeddings: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id, label, x = floor(scale * entry) of each valid row, and its summaries at all levels one after the other."""
    starts = levels(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = matrix(b.column("vector"), width)
            x = floored(v, scale)
            found = [summaries(x.astype(np.float64), s) for s in starts]
            mean, deviation = (np.hstack([f[i] for f in found]).astype(np.float32) for i in (0, 1))
            ends = lambda m: np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
            lists = [pa.ListArray.from_arrays(ends(m), m.ravel()) for m in (x, mean, deviation)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), b.column("label").take(pa.array(at)), *lists], schema=VECTORS)

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), entries("embedding").alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    return stored(rows.mapInArrow(run, "vec_id long, label long, x array<long>, mean array<float>, deviation array<float>"), "vectors")


class Best:
    """The k best (score, id) of each slot, smaller ids first among equal scores; an id counts once, with its best score."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: What a score has to reach to matter to a slot.
        self.least = np.full(slots, LONG.min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((-score, ids, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.append(True, (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]))
        slot, score, ids = slot[first], score[first], ids[first]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("scores may not fit in a long")
    return a @ b.T


def _searched(block: Broadcast, width: int, k: int, same: bool):
    """Maps batches of the vector table to a task's k best rows of each slot of the block.

    The block has the anchors' vec_id, label, x and summaries, and slots: of[slot] is the slot's anchor, lo and hi are the ends of its
    window of scores. same asks for rows of the anchor's label, else for others; rows with the anchor's id don't count.
    """
    starts = levels(width)
    ends = np.cumsum([len(s) for s in starts])
    cuts = [slice(e - len(s), e) for s, e in zip(starts, ends, strict=True)]

    def stacked(col: pa.ListArray, size: int) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def pairs(b: dict, best: Best, part: slice, rows: dict) -> None:
        """Add the rows to the slots of the anchors in part."""
        slots = np.arange(*np.searchsorted(b["of"], [part.start, part.stop]))
        if not len(slots):
            return
        n = part.stop - part.start
        of, lo, hi = b["of"][slots] - part.start, np.maximum(b["lo"][slots], best.least[slots]), b["hi"][slots]
        lowest, highest = np.full(n, LONG.max), np.full(n, LONG.min)
        np.minimum.at(lowest, of, lo)
        np.maximum.at(highest, of, hi)
        alive = ((b["label"][part, None] == rows["label"]) == same) & (b["vec_id"][part, None] != rows["vec_id"])
        alive &= (lowest <= highest)[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        for cut in cuts:
            alive = alive[:, cols] if alive.shape[1] != len(cols) else alive
            means = b["mean"][part, cut] @ rows["mean"][cols, cut].T
            spread = b["deviation"][part, cut] @ rows["deviation"][cols, cut].T + b["slack"][part, None] * rows["length"][cols] + 0.5
            alive &= (means + spread >= lowest[:, None]) & (means - spread <= highest[:, None])
            left = alive.any(axis=0)
            alive, cols = alive[:, left], cols[left]
            if not len(cols):
                return
        score = exact_scores(b["x"][part], rows["x"][cols])
        at, col = np.nonzero(alive & (score >= lowest[:, None]) & (score <= highest[:, None]))
        found, ids = score[at, col], rows["vec_id"][cols[col]]
        begins, counts = np.searchsorted(of, at), np.bincount(of, minlength=n)[at]
        for i in range(counts.max(initial=0)):  # the slots of an anchor one after the other
            slot = np.minimum(begins + i, len(of) - 1)
            ok = (i < counts) & (found >= lo[slot]) & (found <= hi[slot])
            best.add(slots[slot[ok]], found[ok], ids[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best = Best(len(b["of"]), k)
        step = 64  # few rows first: they set what later ones have to reach
        for batch in batches:
            x, mean, deviation = stacked(batch.column("x"), width), stacked(batch.column("mean"), ends[-1]).astype(np.float64), stacked(batch.column("deviation"), ends[-1]).astype(np.float64)
            every = {"vec_id": batch.column("vec_id").to_numpy(), "label": batch.column("label").to_numpy(), "x": x, "mean": mean, "deviation": deviation, "length": np.hypot(mean[:, 0], deviation[:, 0])}
            begin = 0
            while begin < len(x):
                rows = {c: v[begin : begin + step] for c, v in every.items()}
                for first in range(0, len(b["vec_id"]), ANCHORS):
                    pairs(b, best, slice(first, min(first + ANCHORS, len(b["vec_id"]))), rows)
                begin, step = begin + step, min(4 * step, ROWS)
        of = b["of"][best.slot]
        yield pa.RecordBatch.from_pydict({"anchor_id": b["vec_id"][of], "base": b["base"][best.slot], "vec_id": best.id, "score": best.score})

    return run


def _block(rows: list, slots: list[tuple[int, int, int, int]]) -> dict:
    """Anchors (vec_id, label, x, mean, deviation) with slots (anchor's position, base, lo, hi) in order of the positions."""
    wide = lambda c, kind: np.array([r[c] for r in rows], kind)
    mean, deviation = wide("mean", np.float64), wide("deviation", np.float64)
    of, base, lo, hi = (np.array(c, np.int64) for c in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 4
    return {"vec_id": wide("vec_id", np.int64), "label": wide("label", np.int64), "x": wide("x", np.int64), "mean": mean, "deviation": deviation, "slack": SLACK * np.hypot(mean[:, 0], deviation[:, 0]), "of": of, "base": base, "lo": lo, "hi": hi}


def _best_of_tasks(vectors: DataFrame, block: dict, width: int, k: int, same: bool) -> DataFrame:
    """anchor_id, base, vec_id, score, rank: the k best rows of each slot over all vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(block)  # at most BLOCK anchors
    found = vectors.mapInArrow(_searched(sent, width, k, same), "anchor_id long, base long, vec_id long, score long")
    found = found.groupBy("anchor_id", "base", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("anchor_id", "base").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of embeddings (vec_id, label, embedding).

    Scores are inner products of floor(scale * entry). An anchor's positives are its best other rows of the same label; the
    negatives of each are the best rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    Equal scores go by the smaller vec_id.

    Rows with a null vec_id, label or vector take no part, nor do vectors with null or non-finite entries or of another
    length than the most frequent one. A vec_id that repeats counts once a slot, with its best score; as an anchor it is its
    smallest (label, vector). Windows below zero are empty. Entries beyond 2**40 / scale raise, as do scores that might not
    fit in a long. An empty table gives an empty result; further columns are ignored.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = common_width(embeddings, "embedding")
    if not width:
        return spark.createDataFrame([], columns)
    vectors = vector_table(embeddings, width, scale)
    one = vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x", "mean", "deviation")).alias("a")).select("vec_id", "a.*")
    anchors = stored(global_positions(one, ["vec_id"]), "anchors")
    out = scratch(spark, "negatives")
    n = anchors.count()
    for begin in range(0, n, block):
        rows = anchors.where(F.col("position").between(begin, begin + block - 1)).orderBy("position").collect()  # a block
        everything = [(i, 0, LONG.min, LONG.max) for i in range(len(rows))]
        found = _best_of_tasks(vectors, _block(rows, everything), width, positives, True).collect()  # a few rows an anchor
        at = {r["vec_id"]: i for i, r in enumerate(rows)}
        windows = [(at[r["anchor_id"]], r["vec_id"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in found]
        windows = sorted(w for w in windows if w[2] <= w[3])
        scores = spark.createDataFrame([(r["anchor_id"], r["vec_id"], r["score"]) for r in found], "anchor_id long, base long, positive_score long")
        best = _best_of_tasks(vectors, _block(rows, windows), width, negatives, False).join(F.broadcast(scores), ["anchor_id", "base"])
        best.select("anchor_id", F.col("base").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    forget(anchors)
    forget(vectors)
    return spark.read.schema(columns).parquet(out) if n else spark.createDataFrame([], columns)


#: What the query gives, over the view "embeddings".
SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c : cast(floor(256 * cast(c as double)) as bigint)) as x
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c : c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p : p[1] * p[2])) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from (
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
    from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score) where rank <= 5
"""
