from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, suffix_dedup
from tidemark.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, doc string"


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") * r.randint(1, 4) + r.choice(["x", "y", "é", ""]) for _ in range(n))


def grouped(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_components(spark):
    texts = [None, "", "a", "A b", "a", prose(300, 1), prose(300, 1) + " tail", prose(300, 1).upper(), prose(400, 2), " \t\n"]
    rows = [(None if i == 4 else i, t, "clash") for i, t in enumerate(texts)]

    def fp(t):
        w = words(t)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    root = grouped(len(f), lambda i, j: bin(f[i] ^ f[j]).count("1") <= 2)
    least = {r: min(rows[i][0] for i in range(len(f)) if root[i] == r and rows[i][0] is not None) for r in root}
    expected = sorted(((rows[i][0], f"{f[i]:016x}", least[root[i]]) for i in range(len(f))), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == expected
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tau", [2, 3])
def test_links_of_dense_groups(spark, tau):
    r = random.Random(tau)
    found = set()
    for _ in range(30):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            found.add(x)
    fps = sorted(found)
    root = grouped(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= tau)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {a: b for a, b in components(simhash.links(df, tau)).collect()}
    of = [got.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    assert len(set(zip(root, of, strict=True))) == len(set(root)) == len(set(of))


def test_thresholds_sum_up():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 64)) < 0.5).astype(float)
    for n in (1e3, 1e6, 1e10):
        plan = simhash.allocate(int(n), x.T @ x / 2000 * n, 2)
        assert sum(t + 1 for t in plan.thresholds) == 3 and sorted(b for p in plan.parts for b in p) == [*range(64)]


@pytest.mark.parametrize("most", [simhash.BROADCAST, 0])
def test_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST", most)
    base = [prose(200, s) for s in range(12)]
    rows = [(i, t, "c") for i, t in enumerate(base)] + [(100 + i, re.sub("[a-z]", lambda m: m[0].upper(), t.replace(" ", " zz ", 1)), "c") for i, t in enumerate(base[:6])] + [(None, base[0], "c"), (3, base[3], "c"), (900, None, "c"), (901, "", "c")]
    got = sorted(r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [*range(12), 900]
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "doc"]


def kept_by_brute_force(texts, k=5, similarity=0.8):
    """The smallest number of each group of near copies."""
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for t in texts]
    alike = lambda x, y: (not x and not y) or len(x & y) >= similarity * len(x | y) - 1e-9
    root = grouped(len(sets), lambda i, j: alike(sets[i], sets[j]))
    return sorted({min(i for i in range(len(sets)) if root[i] == r) for r in set(root)})


def edited(text, seed, share):
    w, r = text.split(), random.Random(seed)
    for i in r.sample(range(len(w)), max(1, round(share * len(w)))):
        w[i] = f"{w[i]}{seed}"
    return " ".join(w)


def test_near_copies_of_a_hub(spark):
    hub = prose(400, 77)
    texts = [edited(hub, s, 0.02) for s in range(150)] + [hub] + [edited(hub, 1000 + s, 0.021) for s in range(150)]
    texts += [" ".join([prose(120, 78), prose(60, 2000 + s)]) for s in range(60)] + ["", " \t\n", None]
    expected = kept_by_brute_force(texts)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.near_copies(df).collect()) == expected


def test_near_copies_of_a_family(spark, monkeypatch):
    """Edited copies that mostly stay below 0.8 with each other don't meet pair by pair, and no link is lost."""
    base = prose(150, 91)
    half = " ".join([prose(20, 92), *base.split()[20:]])
    texts = [edited(half if s % 3 else base, 5000 + s, 0.004 * (1 + s % 16)) for s in range(320)]
    texts += [f"{edited(base, 7000 + s, 0.01)} {prose(24 + s % 9, 8000 + s)}" for s in range(60)]
    expected = kept_by_brute_force(texts)
    rows = []
    for name, at in (("_likely", 1.0), ("verified", None)):
        was = getattr(simhash, name)

        def spy(pairs, *more, was=was, at=at):
            if at is None or len(more) == 1:  # not the stars
                rows.append(pairs.count())
            return was(pairs, *more)

        monkeypatch.setattr(simhash, name, spy)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.near_copies(df).collect()) == expected
    assert len(expected) > 20
    assert max(rows) < 20 * len(texts)


def test_short_near_copies(spark):
    r = random.Random(8)
    texts = []
    for n, more in [(8, 1), (10, 1), (12, 1), (15, 1), (20, 3), (30, 3), (24, 7)] * 40:
        w = [f"{r.choice('abcdef')}{r.randint(0, 5000)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w + [f"t{r.randint(0, 5000)}" for _ in range(more)])]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in simhash.near_copies(df).collect()) == kept_by_brute_force(texts)


def brute(texts, length):
    """Bytes removed, runs and what is left of each text, by a table of all windows."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(c for c, g in zip(t, gone, strict=False) if not g)))
    return out


def test_repeats(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [some(r.choice([100, 399, 401, 500, 900])) for _ in range(12)]
    texts = [None, "", "a" * 400, "b" * 401, "ab" * 300, "z" * 2000] + ["".join(r.choice([some(r.randint(0, 300)), r.choice(shared)[r.randint(0, 60) :]]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    texts += texts[10:14]
    rows = [(None if i % 17 == 0 else i % 50, t, "clash") for i, t in enumerate(texts)]
    data = [(t or "").encode() for t in texts]
    expected = sorted(((x[0], len(b), *o) for x, b, o in zip(rows, data, brute(data, 400), strict=True)), key=str)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((*x[:4], bytes(x[4])) for x in suffix_dedup.without_repeats(df).collect()), key=str)
    assert got == expected
    stripped = suffix_dedup.strip_repeats(df.withColumn("n_chars", F.char_length("text"))).collect()
    assert sorted(x["text"] for x in stripped) == sorted(o[2].decode("utf-8", "ignore") for o in brute(data, 400))
    assert all(x["n_chars"] == len(x["text"]) for x in stripped) and suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_repeated_words(spark):
    r = random.Random(9)
    some = lambda n: [r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(n)]
    shared = [some(n) for n in (50, 51, 52, 60, 130)]
    texts = [sum((r.choice([some(r.randint(1, 60)), r.choice(shared)]) for _ in range(r.randint(0, 5))), []) for _ in range(50)]
    texts += [["x"] * 51, ["y"] * 52, some(500)]
    seen = collections.Counter(tuple(w[i : i + 51]) for w in texts for i in range(len(w) - 50))
    expected = []
    for w in texts:
        gone = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        expected.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    # white space differs between the copies; no string of 400 bytes is there twice
    rows = [(i, "".join(x + r.choice([" ", "\n", "\t", "  "]) for x in w), "c") for i, w in enumerate(texts)]
    got = suffix_dedup.strip_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), n_words=51).collect()
    assert [" ".join(W.findall(x["text"])) for x in sorted(got)] == expected
    texts_left = suffix_dedup.digests(suffix_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), n_words=51)).collect()
    assert [" ".join(W.findall(x["text"])) for x in sorted(texts_left, key=lambda x: x["doc_id"])] == expected
    assert all(x["n_removed"] == 0 == x["n_spans"] and x["n_bytes"] == len(rows[x["doc_id"]][1]) for x in texts_left)


def test_only_repeating_texts_go_to_python(spark, capsys):
    rows = [(1, prose(300, 1), ""), (2, prose(300, 1), ""), (3, prose(300, 2), "")]
    cut = suffix_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA))
    cut.explain()
    assert "cut(CASE WHEN" in capsys.readouterr().out
    assert [(r["n_removed"], r["text"] == rows[i][1]) for i, r in enumerate(cut.orderBy("doc_id").collect())] == [(len(rows[0][1].encode()), False)] * 2 + [(0, True)]


def test_windows_of_bytes_and_words_share_their_steps(spark, monkeypatch):
    """A text is read for anchors once, and what is removed fits a mask of the bytes."""
    names = []
    was = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: names.append(name) or was(df, name))
    rows = [(1, f"{prose(60, 1)} {prose(120, 2)}", ""), (2, f"{prose(60, 3)} {prose(120, 2)}", ""), (3, prose(40, 4), "")]
    out = suffix_dedup.strip_repeats(spark.createDataFrame(rows, SCHEMA), n_words=51).collect()
    assert names.count("anchors") == 1 and [len(W.findall(x["text"])) for x in sorted(out)] == [60, 60, 40]
    r = np.random.default_rng(3)
    for n in range(40):
        data = r.integers(97, 123, 60, np.uint8).tobytes()
        starts = r.integers(0, 50, n % 7)
        stops = starts + r.integers(1, 11, len(starts))
        gone = np.zeros(61, bool)
        for a, z in zip(starts, stops, strict=True):
            gone[a:z] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert suffix_dedup._without(data, starts, stops) == (int(gone.sum()), runs, bytes(c for c, g in zip(data, gone, strict=False) if not g))


def test_anchors_of_texts_in_frames():
    """Each anchor with its own id, text hash, window identifiers and q-gram, the frames of long columns alone; a null id stays null."""
    texts = [prose(4000, 1), "short", prose(300, 2), prose(300, 2)]
    b = pd.DataFrame({"doc_id": pd.array([5, 6, None, 8], "Int64"), "h": [1, 2, 3, 4], "text": texts})
    got = pd.concat(suffix_dedup._anchored(400, suffix_dedup.OF_BYTES)(iter([b])))
    assert {str(t) for t in got.dtypes} == {"Int64", "int64"}
    of = dict(zip(b["h"], texts, strict=True))
    for doc_id, h, x, lo, hi, _, f1, f2 in got.itertuples(index=False):
        d = xxhash.xxh3_128_intdigest(of[h].encode()[x - hi : x - lo + 400])
        assert (f1 % 2**64, f2 % 2**64) == (d >> 64, d % 2**64) and (doc_id is pd.NA) == (h == 3)
    by = {h: g.drop(columns=["doc_id", "h"]).values.tolist() for h, g in got.groupby("h")}
    assert set(by) == {1, 3, 4} and by[3] == by[4]


def test_pipeline_passage_of_51_words(spark):
    passage = " ".join(f"p{i:03}" for i in range(51))
    rows = [(i, f"{prose(80, 300 + i)} {passage} {prose(80, 400 + i)}", "c") for i in range(2)]
    got = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert [W.findall(x["text"]) for x in sorted(got)] == [W.findall(t.replace(passage, "")) for _, t, _ in rows]
