"""Quality rules: document statistics, and gradient-boosted trees over them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, small_batches

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Texts of more words count repeated windows in numpy arrays, which takes less memory and more time.
LONG = 50_000

#: Features of the trees, and the sign of the effect that each may have on the odds of good quality (0: any).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": 0, "digit_share": -1, "words_per_line": 0, "stop_share": 0, "digit_word_share": 0}


def repeated_words(w: list[str], k: int = WINDOW) -> int:
    """Words in k-word windows that are found twice or more in w."""
    n = len(w) - k + 1
    if n < 2:
        return 0
    if len(w) <= LONG:
        grams = [*zip(*(w[i:] for i in range(k)), strict=False)]
        if len(set(grams)) == n:
            return 0
        counts = Counter(grams)
        twice = np.fromiter((counts[g] > 1 for g in grams), bool, n)
    else:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
        rank = ids
        for i in range(1, k):
            rank = np.unique(rank[: len(w) - i] * (len(number) + 1) + ids[i:], return_inverse=True)[1]
        twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of a text, and its features for the trees."""
    w = re.findall(WORD, text)
    n = len(w)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(w)
    some = max(n, 1)
    counts = Counter(w)
    upper = sum(map(str.isupper, counts)) / max(len(counts), 1)
    digits = sum(map(text.count, "0123456789"))
    short = sum(c for x, c in counts.items() if len(x) <= 3 and x.isalpha())
    numeric = sum(any(c.isdigit() for c in x) for x in counts) / max(len(counts), 1) if digits else 0.0
    features = [np.log1p(n), chars / some, symbols / some, dup / max(len(lines), 1), repeat / some, len(counts) / some, upper, digits / max(chars, 1), n / max(len(lines), 1), short / some, numeric]
    return [n, chars, symbols, dup, repeat], [float(f) for f in features]


# -- trees ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; the children of a leaf are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x, all trees at a time."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0) -> Trees:
    """Logistic boosting on quantile bins. A split on a signed feature must order the values of its sides by the sign, and
    what lies below keeps to its side of their middle."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    bias = float(np.log(p / (1 - p)))
    f = np.full(len(y), bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1) if len(y) else np.zeros(x.shape, int)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        leaf = float(np.clip(g.sum() / (h.sum() + ridge), low, high))
        at = len(nodes)
        nodes.append([0, 0.0, at, at, rate * leaf])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, v, len(c) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            lv, rv = np.clip(gs / (hs + ridge), low, high), np.clip((g.sum() - gs) / (h.sum() - hs + ridge), low, high)
            gain = lv * gs - lv**2 * (hs + ridge) / 2 + rv * (g.sum() - gs) - rv**2 * (h.sum() - hs + ridge) / 2 - (leaf * g.sum() - leaf**2 * (h.sum() + ridge) / 2)
            gain[(ns < least) | (len(rows) - ns < least) | (signs[j] * (rv - lv) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, lv[k], rv[k]))
        if best[1] is None:
            return at
        j, k, lv, rv = best[1]
        goes = binned[rows, j] <= k
        mid = (lv + rv) / 2
        bound_left = (low, min(high, mid)) if signs[j] > 0 else (max(low, mid), high) if signs[j] < 0 else (low, high)
        bound_right = (max(low, mid), high) if signs[j] > 0 else (low, min(high, mid)) if signs[j] < 0 else (low, high)
        nodes[at][:2] = [j, float(cuts[j][k])]
        nodes[at][2] = grow(rows[goes], level + 1, *bound_left)
        nodes[at][3] = grow(rows[~goes], level + 1, *bound_right)
        return at

    for _ in range(trees if len(y) else 0):
        q = 1 / (1 + np.exp(-f))
        grad, hess = y - q, q * (1 - q)
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        tree = _flat(nodes, [first], depth, 0.0)
        f = f + tree.score(x)
    return _flat(nodes, roots, depth, bias)


def _flat(nodes: list[list], roots: list[int], depth: int, bias: float) -> Trees:
    columns = [np.array(c) for c in zip(*nodes, strict=True)] if nodes else [np.zeros(0)] * 5
    return Trees(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4], np.array(roots, np.int64), depth, bias)


# -- on tables ------------------------------------------------------------------------------------------------------


def _stats(model: Trees | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [statistics(t) for t in b["text"]]
            out = pd.DataFrame([s for s, _ in both], columns=[c.split()[0] for c in BASE.split(", ")])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            if model is None:
                out["features"] = [f for _, f in both]
            else:
                x = np.array([f for _, f in both]).reshape(len(both), len(FEATURES))
                out["score"] = np.concatenate([model.score(x[i : i + 1024]) for i in range(0, len(x), 1024)] or [np.zeros(0)])
            yield out

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> Trees:
    """Trees from the labelled rows of docs: those of the ``most`` labelled ids with the smallest hashes, a bounded sample.

    Labels (doc_id, quality) of a repeated id count by their mean; null ids or qualities are ignored. Of the rows of a
    repeated id, that with the smallest features counts. Without any labelled row, the trees are empty and everything
    scores as even odds.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # most ids at most
    got = rows.select("doc_id", "text").mapInPandas(_stats(None), f"doc_id long, {BASE}, features array<double>").join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("r.*", "doc_id").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r["quality"] >= 0.5) for r in got]), [*FEATURES.values()])


def judge(docs: DataFrame, model: Trees, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for each row of docs.

    Null texts have no words and fail, as do empty ones. Repeated rows and null ids are judged row by row; an empty
    table gives an empty result; further columns are ignored. kept: the base rules hold and the log odds of the trees
    are at least the threshold.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(_stats(model), f"doc_id long, {BASE}, score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def kept_rows(docs: DataFrame, model: Trees, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.0) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns: null and empty texts go, repeated rows and null ids are
    judged row by row, an empty table stays empty."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            x = np.array([f for _, f in both]).reshape(len(both), len(FEATURES))
            fine = [n >= least_words and 100 * repeat <= most_repeat * n for (n, *_, repeat), _ in both]
            yield b.filter(pa.array(np.array(fine, bool) & (model.score(x) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
