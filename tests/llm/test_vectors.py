from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import Best, hard_negatives, levels, summaries
from tidemark.llm.slicing import count_above, leading
from tidemark.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n string, whitened string"


def vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 3, "clash", "clash")[:5] if len(r) == 2 else r for r in rows], schema)


@pytest.mark.parametrize("seed", range(40))
def test_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (9, 9)).astype(float)
    a = a + a.T
    for s in rng.standard_normal(5):
        assert count_above(a, s) == (np.linalg.eigvalsh(a) > s).sum()


@pytest.mark.parametrize("spectrum", [[5.0, 5, 5, 3, 3, 1, 0, 0], [10.0] * 5 + [10 + 1e-9] * 3 + [7] * 20 + [1e-9] * 12, list(10.0 ** -np.arange(12)), [0.0] * 4, [2.0]])
def test_leading(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    a = (q * spectrum) @ q.T
    e, v = leading(a, 32)
    k = min(d, 32)
    assert np.allclose(e, sorted(spectrum, reverse=True)[:k], atol=1e-12 * max(spectrum)) and np.allclose(v.T @ v, np.eye(k), atol=1e-12)
    assert np.allclose(a @ v, v * e, atol=1e-12 * max(spectrum + [1e-300]))


def expected(rows, k):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in kept], float)
    n, s = len(x), [sum(v[j] for _, v in kept) for j in range(len(kept[0][1]))]
    d = x - x.mean(axis=0)
    e, q = np.linalg.eigh(d.T @ d / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in kept}, e, d @ q, (d**2).sum() / n


def test_whitening(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((12, 12))
    good = [(i, (rng.standard_normal(12) @ mix).tolist()) for i in range(400)]
    good += [(400 + i, good[0][1]) for i in range(60)]  # copies
    odd = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    got = whiten(vectors(spark, good + odd).repartition(5), 8).toPandas().sort_values(["vec_id", "component"])
    n, deviation, e, projected, trace = expected(good, 8)
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 460 * 8 and set(got["n"]) == {460} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert [deviation[i] for i in got["vec_id"]] == got["deviation"].tolist()
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8), e / trace, rtol=1e-9)
    w = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.allclose(np.abs(w), np.abs(projected / np.sqrt(e)), atol=1e-8) and np.allclose(w.T @ w / n, np.eye(8), atol=1e-9)


def test_whitening_without_variance(spark):
    got = whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    got = whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])])).collect()  # one component has all
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in got) == [(i, c, 1.0 if c == 1 else None, 1.0 if c == 1 else 0.0) for i in (1, 2) for c in (1, 2, 3)]
    assert got[0]["identity_error"] < 1e-12
    assert whiten(vectors(spark, [])).count() == 0 and whiten(vectors(spark, [(1, None)])).count() == 0 and whiten(vectors(spark, [(1, [])])).count() == 0


def test_whitening_of_large_entries(spark):
    got = whiten(vectors(spark, [(1, [2.0**33]), (2, [-(2.0**33)]), (3, [0.5])])).toPandas()
    assert got["deviation"].isna().tolist() == [True, True, False]
    with pytest.raises(Exception, match="larger than"):
        whiten(vectors(spark, [(1, [2.0**40]), (2, [1.0])])).collect()


@pytest.mark.parametrize("width", [1, 2, 7, 8, 64])
def test_bounds(width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-200, 200, (60, width)).astype(float) + 90 * i for i in range(2))
    a[0] = 0
    score, before = a @ b.T, None
    for starts in levels(width):
        (m, d), (n, e) = summaries(a, starts), summaries(b, starts)
        low, high = m @ n.T - d @ e.T, m @ n.T + d @ e.T
        assert (low <= score + 1e-6).all() and (score <= high + 1e-6).all()
        before = high if before is None else before


def test_best():
    rng = np.random.default_rng(1)
    best, held = Best(5, 3), collections.defaultdict(dict)
    for _ in range(20):
        rows = rng.integers(0, [5, 30, 40], (50, 3))
        for s, score, i in rows:
            held[s][i] = max(score, held[s].get(i, -1))
        ok = rows[:, 1] >= best.least[rows[:, 0]]
        best.add(*rows[ok].T)
    expected = [(s, score, i) for s in range(5) for i, score in sorted(held[s].items(), key=lambda x: (-x[1], x[0]))[:3]]
    assert list(zip(best.slot, best.score, best.id, strict=True)) == expected


def brute_force(rows, every):
    v = [(i, label, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, label in rows if x is not None and i is not None and label is not None and all(c is not None and math.isfinite(c) for c in x) and len(x) == 8]
    out = set()
    anchors = {}
    for i, label, x in sorted(v):
        if i % every == 0:
            anchors.setdefault(i, (label, x))
    for i, (label, x) in anchors.items():
        same, other = {}, {}
        for j, m, y in v:
            if i != j:
                s = sum(a * b for a, b in zip(x, y, strict=True))
                side = same if m == label else other
                side[j] = max(s, side.get(j, s))
        for p, ps in sorted(same.items(), key=lambda e: (-e[1], e[0]))[:5]:
            fit = [(j, s) for j, s in other.items() if 80 * ps <= 100 * s <= 100 * ps]
            for r, (j, s) in enumerate(sorted(fit, key=lambda e: (-e[1], e[0]))[:5], 1):
                out.add((i, p, r, j, ps, s))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 2) for i in range(40)] + rows[:20]  # ties and repeated rows
    rows += [(10, (2 * centres[0]).tolist(), 2), (500, None, 1), (510, [1.0] * 8, None), (None, [1.0] * 8, 1), (520, [float("nan")] * 8, 1), (530, [1.0] * 7 + [None], 1), (540, [1.0], 1), (550, [0.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<float>, label int, x string, mean string").repartition(5)
    got = list(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0, block=block).collect()))
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, 10) and len(got) > 300


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, None, 1)], [(0, [], 1)]):
        assert hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0).count() == 0
