"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits that go together in the corpus are grouped into the same partition. A dynamic program deals a
threshold to each partition, so that the estimated cost of signatures and candidates is least while the thresholds
plus one still sum up to the distance plus one: two fingerprints within the distance then agree within the
threshold in one partition at least. Fingerprints are probed by the masked signatures of their partitions and
verified by their distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, ascii_lower, cut, forget, small_batches, stored
from tidemark.llm.components import components

#: Up to so many fingerprints of a bucket are compared pair by pair; fuller buckets go by single-bit flips.
BUCKET = 8
#: Cost of a verified candidate in signatures.
CANDIDATE = 0.5
#: The largest threshold of a partition.
MOST = 2


# -- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, k: int, block: int = 65_536) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of a lower-cased text, repeats included, in blocks."""
    found = (m.group() for m in re.finditer(WORD, text))
    tail: list[str] = []
    first = True
    while True:
        got = list(islice(found, block))
        w = tail + got
        n = len(w) - k + 1
        if n <= 0 and first and not got and w:
            n, shingles = 1, [" ".join(w)]
        else:
            shingles = [" ".join(w[i : i + k]) for i in range(max(n, 0))]
        if shingles:
            first = False
            yield np.fromiter(map(xxhash.xxh64_intdigest, (s.encode() for s in shingles), [42] * len(shingles)), np.uint64, len(shingles))
        if not got:
            return
        tail = w[max(n, 0) :]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Further 64 bits of each hash (the finaliser of splitmix64)."""
    if not salt:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str, k: int) -> int:
    """A signed 64-bit number; a bit is set if it is in over half of the hashes of the shingles, repeats included."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        for i in range(0, len(h), 4096):
            ones += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (long) of each row of docs; null texts count as empty, a text without words has fingerprint zero."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t, k) for t in b["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def distance(a: Column, b: Column, longs: int) -> Column:
    total = F.lit(0)
    for s in range(longs):
        total = total + F.bit_count(a[s].bitwiseXOR(b[s]))
    return total


# -- partitions and thresholds --------------------------------------------------------------------------------------


def co_occurrence(fps: DataFrame, longs: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits in how many both are set.

    Each task adds up the matrix of its rows and passes it on by blocks of 64 bits; blocks are added up as they come. The
    driver sees one matrix.
    """
    n_bits = 64 * longs
    schema = "block int, n long, counts binary"

    def frame(n: int, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"block": range(longs), "n": n, "counts": [total[64 * i : 64 * i + 64].tobytes() for i in range(longs)]})

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((n_bits, n_bits), np.int64), 0
        for b in batches:
            if len(b):
                x = np.unpackbits(np.array(b["fp"].tolist(), dtype=">i8").view(np.uint8).reshape(len(b), -1), axis=1).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
                n += len(b)
        yield frame(n, total)

    def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for block, n, counts in zip(b["block"], b["n"], b["counts"], strict=True):
                held = sums.setdefault(block, [0, 0])
                held[0] += n
                held[1] = held[1] + np.frombuffer(counts, np.int64)
        yield pd.DataFrame([(k, n, c.tobytes()) for k, (n, c) in sums.items()], columns=["block", "n", "counts"])

    summed = fps.select("fp").mapInPandas(of_rows, schema).repartition(longs, "block").mapInPandas(of_blocks, schema).collect()
    both = np.zeros((n_bits, n_bits))
    for block, _, counts in summed:
        both[64 * block : 64 * block + 64] = np.frombuffer(counts, np.int64).reshape(64, n_bits)
    return summed[0]["n"] if summed else 0, both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of like size; each part starts from a free bit and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, found = list(range(len(p))), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        at = [free[0]]
        while len(at) < size:
            rest = [b for b in free if b not in at]
            at.append(max(rest, key=lambda b: (round(float(corr[b, at].mean()), 9), -b)))
        found.append(sorted(at))
        free = [b for b in free if b not in at]
    return found


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated shares of pairs that differ in 0, 0..1, ... 0..most of bits; the bits as a chain, each depending on the one before."""
    f = both / max(n, 1)
    p = np.diag(f)

    def joint(a: int, b: int) -> np.ndarray:
        """Chance that two rows differ (1) or not (0) in bits a and b."""
        t = np.clip(np.array([[1 - p[a] - p[b] + f[a, b], p[b] - f[a, b]], [p[a] - f[a, b], f[a, b]]]), 0, 1)
        return np.array([[(t * t).sum(), (t * t[:, ::-1]).sum()], [(t * t[::-1]).sum(), (t * t[::-1, ::-1]).sum()]])

    q = 2 * p * (1 - p)
    state = np.zeros((2, most + 2))
    state[0, 0], state[1, 1] = 1 - q[bits[0]], q[bits[0]]
    for a, b in zip(bits, bits[1:], strict=False):
        j, new = joint(a, b), np.zeros_like(state)
        for x in (0, 1):
            given = j[x] / max(j[x].sum(), 1e-12)
            new[0] += state[x] * given[0]
            new[1, 1:] += state[x, :-1] * given[1]
        state = new
    return np.cumsum(state.sum(0))[: most + 1].tolist()


@dataclass(frozen=True)
class Plan:
    parts: list[list[int]]
    thresholds: list[int]  # -1: the partition isn't probed
    cost: float


def allocate(n: int, both: np.ndarray, tau: int, numbers: Iterable[int] | None = None) -> Plan:
    """The cheapest of some numbers of partitions and of all thresholds t_i with sum(t_i + 1) = tau + 1, by dynamic programming."""
    best = None
    for m in numbers or range(1, tau + 2):
        parts = grouped_bits(n, both, m)
        price = []
        for bits in parts:
            near = within(n, both, bits, MOST)
            price.append([0.0] + [n * comb(len(bits), t) + CANDIDATE * n * n / 2 * near[t] if t <= min(MOST, len(bits)) else np.inf for t in range(tau + 1)])
        table: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (tau + 1)
        for row in price:
            table = [min(((table[u - x][0] + row[x], [*table[u - x][1], x - 1]) for x in range(u + 1)), key=lambda y: y[0]) for u in range(tau + 2)]
        cost, thresholds = table[tau + 1]
        if best is None or cost < best.cost:
            best = Plan(parts, thresholds, cost)
    return best


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def signatures(fp: Column, plan: Plan) -> Column:
    """An array of (sig, value): the fingerprint under a mask of a partition without the bits that may differ."""
    masks = [sum(1 << (63 - b) for b in set(bits) - set(away)) for bits, t in zip(plan.parts, plan.thresholds, strict=True) if t >= 0 for away in combinations(bits, t)]
    return F.array(*[F.struct(F.lit(i).alias("sig"), fp.bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for i, m in enumerate(masks)])


def links(fps: DataFrame, tau: int) -> DataFrame:
    """Edges (a, b) that connect just the distinct 64-bit fingerprints (fp: long) that reach each other by steps of tau bits at most.

    Buckets of up to BUCKET fingerprints are verified pair by pair. Members of fuller buckets (tau = 2) are linked by the
    keys one flip away: two of them differ in two bits at most just if they share such a key, and a key has 65 members
    at most, so that no group is large however many copies it holds.
    """
    n, both = co_occurrence(fps.select(F.array("fp").alias("fp")), 1)
    plan = allocate(n, both, tau)
    sigs = fps.select("fp", F.explode(signatures(F.col("fp"), plan)).alias("s")).select("fp", "s.*")
    sizes = cut(sigs.groupBy("sig", "value").agg(F.count("*").alias("size")).where("size > 1"))
    met = stored(sigs.join(sizes, ["sig", "value"]), "buckets")
    small = met.where(F.col("size") <= BUCKET).groupBy("sig", "value").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.expr(f"slice(fps, i + 2, {BUCKET})")).alias("b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    full = met.where(F.col("size") > BUCKET).select("fp").distinct()
    if tau == 2:
        keys = [0] + [signed(1 << i) for i in range(64)]
        flips = full.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(k).cast("long")) for k in keys])).alias("key"))
        star = flips.groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        near = near.unionByName(star.where("a != b"))
    else:
        x, y = met.where(F.col("size") > BUCKET).alias("x"), met.alias("y")
        wide = x.join(y, ["sig", "value"]).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).where("a < b")
        near = near.unionByName(wide.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau))
    return near.distinct()


def near_duplicates(docs: DataFrame, k: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text, ...).

    component_id is the smallest non-null id reachable by links of tau bits at most. Null texts count as empty; texts
    without words have fingerprint zero and are linked like any other. Repeated rows and ids give a row each, with the
    same component. An empty table gives an empty result; further columns are ignored.
    """
    fps = stored(fingerprints(docs, k), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), tau))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.join(classes, "root").select(F.col("fp").alias("of"), "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(by_fp, fps["fp"] == by_fp["of"]).select("doc_id", hexed, "component_id")


# -- near copies by shingles ----------------------------------------------------------------------------------------

#: Near copies are looked for by fingerprints of so many longs over the distinct words of a text, in so many
#: partitions, and verified up to this share of differing bits (0.067 are expected where a 5-word Jaccard of 0.8
#: leaves 0.96 of the words).
LONGS, PARTS, DIFFERING = 4, 12, 0.17
#: Words of which a task remembers the hash.
MEMO = 50_000


class WordHashes(dict):
    """XXH3 of words, remembered until there are MEMO of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def word_hashes(text: str, known: WordHashes, block: int = 65_536) -> np.ndarray:
    """The hash of each word of a text, in order; its words are taken in blocks."""
    found = (m.group() for m in re.finditer(WORD, text))
    parts = []
    while w := [*islice(found, block)]:
        parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_ids(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct identifiers of the k-word shingles of a text; of fewer words, of the whole sequence."""
    if not len(words):
        return np.zeros(0, np.int64)
    k = min(k, len(words))
    n = len(words) - k + 1
    ids = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[i : i + n]
        ids = (ids ^ (ids >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        ids ^= ids >> np.uint64(29)
    return np.unique(ids.view(np.int64))


def word_fingerprint(words: np.ndarray, longs: int, block: int = 8192) -> list[int]:
    """longs signed 64-bit numbers over the distinct word hashes of a text; a bit is set if it is in over half of them."""
    distinct = np.unique(words)
    if not len(distinct):
        return [0] * longs
    ones = np.zeros(64 * longs, np.int64)
    for i in range(0, len(distinct), block):
        part = np.stack([_mix(distinct[i : i + block], s) for s in range(longs)], 1)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(distinct)).view(">i8").astype(np.int64).tolist()


def bucket_keys(fps: DataFrame, plan: Plan) -> DataFrame:
    """h, key: the number of a partition (and of the bits left out of it) over its bits, for each text (h, fp).

    Made in numpy, as a column for each of some dozens of wide masks makes plans and generated code that drivers keep.
    """
    masks = [(bits, away) for bits, t in zip(plan.parts, plan.thresholds, strict=True) if t >= 0 for away in combinations(bits, t)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.unpackbits(np.array(b["fp"].tolist(), dtype=">i8").view(np.uint8).reshape(len(b), -1), axis=1)
            for i, (bits, away) in enumerate(masks):
                kept = [c for c in bits if c not in away]
                value = x[:, kept].astype(np.int64) @ (np.int64(1) << np.arange(len(kept), dtype=np.int64))
                yield pd.DataFrame({"h": b["h"], "key": value + (np.int64(i) << np.int64(40))})

    return fps.mapInPandas(run, "h long, key long")


def candidate_links(fps: DataFrame, plan: Plan, longs: int, most: int) -> DataFrame:
    """Pairs (a, b) of texts (h, fp) that share a bucket and differ in at most ``most`` bits: of each text the
    closest found, and two by a hash, which texts of one group mostly have in common.

    Buckets of up to BUCKET texts give all their pairs. Each text of a fuller bucket is paired with its centre (the
    smallest by a hash, the same in buckets of the same texts), so that the number of pairs is in proportion to the
    texts. What this leaves apart is found by the prefix filter.
    """
    sigs = stored(bucket_keys(fps, plan), "keys")
    centre = F.min(F.struct(F.xxhash64("h", F.lit(0)).alias("o"), F.col("h").alias("v")))["v"].alias("centre")
    sizes = stored(sigs.groupBy("key").agg(F.count("*").alias("size"), centre).where("size > 1"), "sizes")
    met = stored(sigs.join(sizes, "key"), "met")
    forget(sigs)
    small = met.where(F.col("size") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    pairs = small.select("hs", F.posexplode("hs").alias("i", "a")).select("a", F.explode(F.expr(f"slice(hs, i + 2, {BUCKET})")).alias("b"))
    stars = met.where(F.col("size") > BUCKET).select(F.col("h").alias("a"), F.col("centre").alias("b")).where("a != b")
    edges = pairs.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    x, y = fps.select(F.col("h").alias("a"), F.col("fp").alias("x")), fps.select(F.col("h").alias("b"), F.col("fp").alias("y"))
    near = edges.join(x, "a").join(y, "b").select("a", "b", distance(F.col("x"), F.col("y"), longs).alias("bits")).where(F.col("bits") <= most)
    ways = near.select(F.explode(F.array(F.struct("a", "b", "bits"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))).alias("e")).select("e.*")
    by = [F.struct("bits", "b"), *[F.struct(F.xxhash64("b", F.lit(i)).alias("o"), "b") for i in range(2)]]
    best = ways.groupBy("a").agg(F.array(*[F.min(o)["b"] for o in by]).alias("bs")).select("a", F.explode(F.array_distinct("bs")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -- pairs that buckets leave apart ---------------------------------------------------------------------------------

#: Shingles found in so many sampled texts at least go to the end of the order of shingles, the most frequent last; of
#: these, so many at most are known to tasks. The sample has SAMPLED texts or a tenth of all, whichever is more. Both only
#: make the order better or worse: any order is a right one.
COMMON, MOST_COMMON, SAMPLED = 2, 400_000, 5_000
#: Texts of a shingle that one task pairs with all others of it.
SALT = 256
#: Tables of one or two longs a row are broadcast up to so many rows.
BROADCAST = 2_000_000


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """h, shingles (sorted, distinct) of texts (h, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            for i in range(0, len(b), 250):
                part = b.iloc[i : i + 250]
                yield pd.DataFrame({"h": part["h"], "shingles": [shingle_ids(word_hashes(t, known), k) for t in part["text"]]})

    return texts.mapInPandas(run, "h long, shingles array<long>")


def common_shingles(texts: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of texts (h, text; n different h), sorted, and the number of texts of each."""
    scale = 1_000_000
    share = min(scale, -(-scale * max(SAMPLED, n // 10) // max(n, 1)))
    sample = texts.where(F.pmod(F.xxhash64("h"), F.lit(scale)) < share).groupBy("h").agg(F.first("text").alias("text"))
    each = shingle_sets(sample, k).select(F.explode("shingles").alias("s"))
    top = each.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    s, c = (np.array(top[i], np.int64) for i in ("s", "n"))
    by = np.argsort(s)
    return s[by], c[by].astype(np.int32)


def prefixes(texts: DataFrame, k: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, n (distinct shingles), at, key: the first n - ceil(similarity * n) + 1 shingles of each text, with their place.

    Shingles are ordered by their frequency in a sample, then by their hash. Any order that is the same for all texts
    lets no pair of this similarity miss each other's prefix; this one keeps frequent shingles out of it.
    """
    known, counts = common

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            held: list[tuple] = []
            size = 0
            for h, t in zip(b["h"], b["text"], strict=True):
                s = shingle_ids(word_hashes(t, words), k)
                n = len(s)
                if not n:
                    continue
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[i] == s, counts[i], 0), kind="stable")]
                held.append((h, n, s[: n - int(np.ceil(similarity * n - 1e-9)) + 1]))
                size += len(held[-1][2])
                if size >= 50_000:
                    yield _prefix_rows(held)
                    held, size = [], 0
            if held:
                yield _prefix_rows(held)

    return texts.mapInPandas(run, "h long, n int, at int, key long")


def _prefix_rows(held: list[tuple]) -> pd.DataFrame:
    sizes = [len(s) for *_, s in held]
    at = np.concatenate([np.arange(m) for m in sizes])
    return pd.DataFrame({"h": np.repeat([h for h, *_ in held], sizes), "n": np.repeat([n for _, n, _ in held], sizes), "at": at, "key": np.concatenate([s for *_, s in held])})


def _may_reach(similarity: float, a: str, b: str) -> Column:
    """Whether two texts that share a shingle at their places in the order may have so many shingles in common."""
    least = F.lit(similarity / (1 + similarity)) * (F.col(f"n_{a}") + F.col(f"n_{b}")) - 1e-6
    most = F.least(f"at_{a}", f"at_{b}") + F.least(F.col(f"n_{a}") - F.col(f"at_{a}"), F.col(f"n_{b}") - F.col(f"at_{b}"))
    return most >= least


def _likely(pairs: DataFrame, similarity: float, share: float = 1.0) -> DataFrame:
    """Of rows (h_x, n_x, h_y, n_y), one a shared shingle, the pairs (a, b) with so many of them that the similarity is possible.

    One of two similar texts has all its shared shingles up to the end of its prefix in the other's prefix. share: of the
    number needed, for rows that don't have all shared shingles.
    """
    first = F.col("h_x") < F.col("h_y")
    sides = [F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b"), F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b")]
    found = pairs.select(*sides).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    rest = lambda c: F.ceil(F.lit(similarity) * F.col(c) - 1e-9) - 1
    least = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    return found.where(F.col("shared") >= F.lit(share) * (least - F.greatest(rest("n_a"), rest("n_b")))).select("a", "b")


def prefix_stars(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of prefix shingles with two centres of each, if they meet in a third of the shingles they need.

    Centres are the smallest texts by two hashes, so a group of copies has the same ones in most of its shingles. The rows
    are in proportion to the texts; what this leaves apart, prefix_pairs finds.
    """
    row = F.struct("h", "n", "at")
    centres = shared.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("h", F.lit(i)).alias("o"), row.alias("v")))["v"].alias(f"c{i}") for i in range(2)])
    met = shared.join(stored(centres, "centres"), "key").select(F.col("h").alias("h_x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.explode(F.array_distinct(F.array("c0", "c1"))).alias("c"))
    met = met.select("h_x", "n_x", "at_x", F.col("c.h").alias("h_y"), F.col("c.n").alias("n_y"), F.col("c.at").alias("at_y"))
    return _likely(met.where("h_x != h_y").where(_may_reach(similarity, "x", "y")), similarity, 1 / 3)


def prefix_pairs(shared: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of different groups (groups: node, root, family), all of this Jaccard similarity among them.

    shared has the prefix rows (h, n, at, key) of shingles that several texts have. Two similar texts share one of them.
    Texts of a group (the same root) or of a family, whose pairs family_pairs has, needn't meet, so the texts of a
    shingle's largest family only meet those outside of it, and these each other, in blocks of SALT. Pairs are left out
    only where sizes, places in the order or the number of shared prefix shingles rule the similarity out.
    """
    root = F.coalesce("root", "h")
    rooted = shared.join(groups, F.col("h") == F.col("node"), "left").select("key", "h", "n", "at", root.alias("root"), F.coalesce("family", root).alias("family"))
    rooted = stored(rooted, "rooted")
    counts = rooted.groupBy("key", "family").agg(F.count("*").alias("m"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("families"), F.sum("m").alias("size"), F.max("m").alias("largest"), F.max_by("family", F.struct("m", "family")).alias("main")).where("families > 1")
    salts = F.ceil((F.col("size") - F.col("largest")) / SALT).cast("int").alias("salts")
    met = stored(rooted.join(stored(mixed.select("key", "main", salts), "mixed"), "key"), "mixed-prefixes")
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("h", "n", "at", "root", "family")]
    x = met.where("family != main").select("key", F.pmod(F.xxhash64("h"), F.col("salts")).cast("int").alias("salt"), *named("x"))
    y = met.select("key", "main", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *named("y"))
    once = (F.col("family_y") == F.col("main")) | (F.col("h_x") < F.col("h_y"))
    apart = (F.col("root_x") != F.col("root_y")) & (F.col("family_x") != F.col("family_y"))
    pairs = x.join(y, ["key", "salt"]).where(apart & once & _may_reach(similarity, "x", "y"))
    return _likely(pairs, similarity)


# -- families of texts that are similar, but not enough ---------------------------------------------------------------

#: Groups with a pair of texts of this similarity may be one family. It only makes families, and so the work, larger or smaller.
LOOSE = 0.5
#: A family is taken apart from the other texts if so many of its texts at least are outside of its largest group; its shape is
#: drawn from about so many of its texts.
FAMILY, SHAPED = 4, 64


def family_members(compared: DataFrame, roots: DataFrame) -> DataFrame:
    """h, root, family, size (texts of the family) of the texts of families of several groups (roots: node, root).

    A group joins its largest neighbour among the compared pairs (a, b, similarity), this one its own, and so on, in at
    most eight steps. Any choice is a right one.
    """
    known = roots.withColumnsRenamed({"node": "h"})
    of = lambda side: known.select(F.col("h").alias(side), F.col("root").alias(f"root_{side}"))
    loose = compared.where(F.col("similarity") >= LOOSE).select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    loose = stored(loose.select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x != y"), "loose")
    single = loose.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("x").alias("root")), F.struct(F.col("b").alias("h"), F.col("y").alias("root")))).alias("e")).select("e.*")
    texts = stored(known.unionByName(single).distinct(), "family-texts")
    sizes = stored(texts.groupBy("root").agg(F.count("*").alias("m")), "sizes")
    ways = loose.select("x", "y").unionByName(loose.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    rank = lambda c: sizes.select(F.col("root").alias(c), F.struct("m", "root").alias(f"rank_{c}"))
    up = ways.join(rank("x"), "x").join(rank("y"), "y").where("rank_y > rank_x").groupBy("x").agg(F.max("rank_y")["root"].alias("up"))
    for _ in range(3):
        up = stored(up, "up")
        far = up.select(F.col("x").alias("_x"), F.col("up").alias("_up"))
        up = up.join(far, F.col("up") == F.col("_x"), "left").select("x", F.coalesce("_up", "up").alias("up"))
    named = sizes.join(stored(up, "up"), F.col("root") == F.col("x"), "left").select("root", "m", F.coalesce("up", "root").alias("family"))
    large = named.groupBy("family").agg(F.sum("m").alias("size"), F.max("m").alias("largest")).where(F.col("size") - F.col("largest") >= FAMILY)
    named = stored(named.join(large.select("family", "size"), "family").select("root", "family", "size"), "families")
    return texts.join(_sent(named), "root").select("h", "root", "family", "size")


def family_shapes(members: DataFrame) -> DataFrame:
    """family, known (shingles that several of its texts have, sorted), inside (whether over half have it), rarity of each.

    members has h, family, size and shingles. A shape may be any set of shingles; this one is close to most texts.
    """
    some = members.where(F.pmod(F.xxhash64("h", F.lit(5)), F.col("size")) < SHAPED)
    some = stored(some.select("h", "family", F.explode("shingles").alias("s")), "shaped")
    taken = some.groupBy("family", "h").agg(F.lit(1).alias("one")).groupBy("family").agg(F.count("*").alias("taken"))
    counts = some.groupBy("family", "s").agg(F.count("*").alias("m")).join(stored(taken, "taken"), "family").where("2 * m > taken or m > 1")
    each = F.struct("s", (2 * F.col("m") > F.col("taken")).alias("inside"), F.least("m", F.col("taken") - F.col("m")).cast("int").alias("rarity"))
    shapes = counts.groupBy("family").agg(F.sort_array(F.collect_list(each)).alias("e"))
    return stored(shapes.select("family", F.col("e.s").alias("known"), F.col("e.inside").alias("inside"), F.col("e.rarity").alias("rarity")), "shapes")


def differences(members: DataFrame) -> DataFrame:
    """h, root, family, n, d, delta: the d shingles in which a text (of n) and its family's shape differ, rare ones first.

    Texts that differ in over half of their number are left out: they don't fit the family.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, root, family, s, known, inside, rarity in zip(b["h"], b["root"], b["family"], b["shingles"], b["known"], b["inside"], b["rarity"], strict=True):
                delta = np.setxor1d(s, known[inside.astype(bool)], assume_unique=True)
                if 2 * len(delta) <= len(s):
                    if len(known):
                        i = np.minimum(np.searchsorted(known, delta), len(known) - 1)
                        delta = delta[np.argsort(np.where(known[i] == delta, rarity[i], 0), kind="stable")]
                    out.append((h, root, family, len(s), len(delta), delta))
            yield pd.DataFrame(out, columns=["h", "root", "family", "n", "d", "delta"])

    return members.mapInPandas(run, "h long, root long, family long, n int, d int, delta array<long>")


def family_pairs(near: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of a family (near: what differences gives) that connect all groups which similar pairs in it connect.

    Two texts of n and m shingles are similar just if they differ in at most r * (n + m) of them, r being (1 - similarity) / (1 +
    similarity). Let x be d - r * n: they differ in at most both d, so texts with x <= -x' are similar to the one with the
    least x, x', and are paired with it. Others are similar to a text only if both differ from the shape in (x + x_other)
    / 2 of the same shingles at least, so two such texts share one in prefixes of their differences (shorter ones if neither is
    paired with the centre). These are mostly what a text has of its own, while prefixes of whole texts hold what all
    texts of a family have.
    """
    r = (1 - similarity) / (1 + similarity)
    near = near.withColumn("x", F.col("d") - F.lit(r) * F.col("n"))
    least = near.groupBy("family").agg(F.min(F.struct("x", "h", "root")).alias("centre"))
    least = stored(least.select(F.col("family").alias("of"), F.col("centre.x").alias("least"), F.col("centre.h").alias("centre"), F.col("centre.root").alias("centre_root")), "centres")
    placed = stored(near.join(_sent(least), F.col("family") == F.col("of")).withColumn("far", F.col("x") + F.col("least") > 1e-6).drop("of"), "placed")
    stars = placed.where("not far and h != centre and root != centre_root").select(F.least("h", "centre").alias("a"), F.greatest("h", "centre").alias("b"))
    edge = stored(placed.where("far").groupBy("family").agg(F.min("x").alias("edge")).select(F.col("family").alias("of"), "edge"), "edges-of-families")
    both = placed.join(_sent(edge), F.col("family") == F.col("of"))
    prefix = lambda other: F.greatest(F.lit(0), F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("x") + other) / 2 - 1e-6)) + 1).cast("int")
    rows = both.withColumn("short", prefix(F.col("edge"))).withColumn("prefix", F.when(F.col("far"), prefix(F.col("least"))).otherwise(F.col("short")))
    rows = rows.select("family", "h", "root", "d", "x", "far", "short", F.posexplode(F.expr("slice(delta, 1, prefix)")).alias("at", "key"))
    rows = stored(rows.withColumn("short", F.col("at") < F.col("short")), "differences")
    named = lambda df, side: df.select("family", "key", *[F.col(c).alias(f"{c}_{side}") for c in ("h", "root", "d", "x", "at")])
    meet = lambda x, y: named(x, "x").join(named(y, "y"), ["family", "key"])
    far = rows.where("far and short")
    # the first shingle that two texts have in common leaves so many for each after it
    common = F.ceil((F.col("x_x") + F.col("x_y")) / 2 - 1e-6)
    fits = (F.col("root_x") != F.col("root_y")) & (F.col("at_x") + common <= F.col("d_x")) & (F.col("at_y") + common <= F.col("d_y"))
    met = meet(rows.where("far"), rows.where("not far")).where(fits).unionByName(meet(far, far).where(fits & (F.col("h_x") < F.col("h_y"))))
    return stars.unionByName(met.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b"))).distinct()


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of the texts of edges (a, b); that of texts without shingles is 1."""
    x, y = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return edges.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.when(union == 0, 1.0).otherwise(shared / union).alias("similarity"))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts have this Jaccard similarity; sets has h and shingles of each."""
    return compared(edges, sets).where(F.col("similarity") >= similarity - 1e-9).select("a", "b")


def _sent(df: DataFrame) -> DataFrame:
    """A stored table of one long a row, to be broadcast behind a count."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def near_groups(texts: DataFrame, fps: DataFrame, k: int, similarity: float) -> DataFrame:
    """(node, root) of the texts (h, text) that are near copies of another; fps has h and fp of each different text.

    Candidates come from SimHash buckets and from stars of prefix shingles; then those within families of groups that
    are similar, but not enough, by what their texts have apart from the rest; then all pairs between the groups and
    families found so far that the prefix filter can't rule out. Each link is verified on the shingles.
    """
    n, both = co_occurrence(fps, LONGS)
    near = candidate_links(fps, allocate(n, both, PARTS - 1, [PARTS]), LONGS, int(DIFFERING * 64 * LONGS))
    keys = stored(prefixes(texts, k, similarity, common_shingles(texts, n, k)), "prefixes")
    several = keys.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x != y").select("key")
    shared = stored(keys.join(_sent(stored(several, "several")), "key", "left_semi").distinct(), "shared")
    forget(keys)
    edges = stored(near.unionByName(prefix_stars(shared, similarity)).distinct(), "edges")
    # texts without words are one group
    bare = fps.where(F.col("empty")).select("h")
    bare = bare.crossJoin(F.broadcast(bare.agg(F.min("h").alias("b")))).select(F.col("h").alias("a"), "b").where("a != b")
    sets = _sets_of(edges, texts, k)
    held = stored(compared(edges, sets), "compared")
    links = cut(held.where(F.col("similarity") >= similarity - 1e-9).select("a", "b").unionByName(bare))
    roots = components(links)
    members = stored(family_members(held, roots).join(sets, "h"), "members")
    shapes = family_shapes(members)
    sent = F.broadcast(shapes) if (shapes.agg(F.sum(F.size("known"))).first()[0] or 0) <= BROADCAST // 4 else shapes
    near = stored(differences(members.drop("size").join(sent, "family")), "near")
    within = stored(family_pairs(near, similarity), "within")
    more = cut(verified(within, sets, similarity))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    families = near.select("h", F.bitwise_not("family").alias("family"))  # never the number of a group
    groups = roots.join(families, F.col("node") == F.col("h"), "full").select(F.coalesce("node", "h").alias("node"), F.coalesce("root", "h").alias("root"), "family")
    others = stored(prefix_pairs(shared, stored(groups, "groups"), similarity), "others")
    if others.isEmpty():
        return roots
    more = cut(verified(others, _sets_of(others, texts, k), similarity))
    return roots if more.isEmpty() else components(links.unionByName(more))


def _sets_of(edges: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """h, shingles of the texts (h, text) that edges name."""
    ends = stored(edges.select(F.explode(F.array("a", "b")).alias("of")).distinct(), "ends")
    named = texts.join(_sent(ends), F.col("h") == F.col("of"), "left_semi")
    return stored(shingle_sets(named.groupBy("h").agg(F.first("text").alias("text")), k), "shingles")


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: all its columns, the row with the smallest doc_id.

    Texts (A-Z lower-cased) are near copies if the Jaccard similarity of their distinct k-word shingles is at least
    ``similarity``; groups are the connected components. Equal texts are one group, null counts as empty, and texts
    without words are near copies of each other. Null ids come last and ties are broken by the text's hash; repeated
    rows leave one. An empty table stays empty. Texts are known by 128 bits: one that shares 64 of them with another
    text keeps its row, as do its equals, apart from all groups.
    """
    small_batches(docs.sparkSession)
    given = F.coalesce("text", F.lit(""))
    lowered = ascii_lower(given)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(given).alias("own"), F.xxhash64(lowered).alias("h"), F.xxhash64(F.lit(1), lowered).alias("h2"), lowered.alias("text"))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            words = [word_hashes(t, known) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "own": b["own"], "h": b["h"], "h2": b["h2"], "empty": [not len(w) for w in words], "fp": [word_fingerprint(w, LONGS) for w in words]})

    rows = stored(keyed.select("id", "own", "h", "h2", "text").mapInPandas(prints, "id long, own long, h long, h2 long, empty boolean, fp array<long>"), "prints")
    fps = stored(rows.groupBy("h").agg(F.first("fp").alias("fp"), F.first("empty").alias("empty"), F.min("h2").alias("h2"), F.max("h2").alias("other")), "fps")
    twice = stored(fps.where("h2 != other").select(F.col("h").alias("_h"), F.col("h2").alias("_h2")), "twice")
    texts = keyed.select("h", "h2", "text")
    if not twice.isEmpty():
        texts = texts.join(twice, F.col("h") == F.col("_h"), "left").where(F.col("_h").isNull() | (F.col("h2") == F.col("_h2")))
    groups = near_groups(texts.select("h", "text"), fps, k, similarity)
    # the row that stays of each group
    named = rows.join(groups, rows["h"] == groups["node"], "left").join(twice, F.col("h") == F.col("_h"), "left")
    apart = F.col("_h").isNotNull() & (F.col("h2") != F.col("_h2"))
    named = named.select("id", "own", F.when(apart, F.col("h")).otherwise(F.coalesce("root", "h")).alias("root"), F.when(apart, F.col("h2")).alias("of"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("own").alias("own")))
    stay = stored(named.groupBy("root", "of").agg(first.alias("s")).select(F.col("s.id").alias("stay_id"), F.col("s.own").alias("stay_own")), "stay")
    return _of_pairs(keyed.select("row", "id", "own"), rows, stay).select("row.*")


def _of_pairs(keyed: DataFrame, rows: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of keyed (row, id, own) for each pair of stay (stay_id, stay_own); rows has the pairs of all rows.

    Where few pairs go and few repeat, these are broadcast and no text is shuffled.
    """
    same = lambda other: keyed["id"].eqNullSafe(other["of_id"]) & (keyed["own"] == other["of_own"])
    pairs = rows.groupBy(F.col("id").alias("of_id"), F.col("own").alias("of_own")).agg(F.count("*").alias("n"))
    both = pairs.join(stay, F.col("of_id").eqNullSafe(F.col("stay_id")) & (F.col("of_own") == F.col("stay_own")), "left")
    odd = stored(both.select("of_id", "of_own", F.col("stay_own").isNull().alias("goes"), (F.col("n") > 1).alias("repeats")).where("goes or repeats"), "odd-pairs")
    if odd.count() <= BROADCAST:
        few = F.broadcast(odd)
        twice = F.broadcast(odd.where("not goes").select("of_id", "of_own"))
        return keyed.join(few, same(few), "left_anti").unionByName(keyed.join(twice, same(twice)).dropDuplicates(["id", "own"]).select("row", "id", "own"))
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("own") == F.col("stay_own")))
    return kept.dropDuplicates(["stay_id", "stay_own"]).select("row", "id", "own")
