"""Walks through random trees against their closure, with cycles, lost parents and long chains."""

from __future__ import annotations

import random

from tidemark.operators import taxonomy


def walk(parents):
    """The path of each node, cycles cut above their smallest id."""
    cut = set()
    for start in parents:
        seen, at = [], start
        while at is not None and at in parents and at not in seen:
            seen.append(at)
            at = parents[at]
        if at in seen:
            cut.add(min(seen[seen.index(at) :]))
    out = {}
    for start in parents:
        path, at = [start], start
        while at not in cut and parents[at] in parents:
            at = parents[at]
            path.append(at)
        out[start] = path[::-1]
    return out


def test_intervals(spark):
    for seed, n in ((1, 40), (2, 12), (3, 3)):
        rng = random.Random(seed)
        ids = [f"n{i}" for i in range(n)]
        parents = {i: rng.choice([None, "gone", *ids, *ids, *ids]) for i in ids}
        if seed == 1:
            parents |= {f"c{i}": f"c{i - 1}" if i else None for i in range(30)} | {f"d{i}": f"d{(i + 1) % 5}" for i in range(5)} | {"self": "self"}
        paths = walk(parents)
        tree = spark.createDataFrame([*parents.items()], "id string, parent_id string")
        assert {r["id"]: r["path"] for r in taxonomy.paths(tree).collect()} == paths
        numbered = taxonomy.stored(taxonomy.intervals(tree), "intervals")
        rows = {r["id"]: r for r in numbered.collect()}
        assert sorted(r["pre"] for r in rows.values()) == list(range(len(parents))) and all(rows[i]["depth"] == len(p) - 1 for i, p in paths.items())
        direct = [(i, rng.randint(0, 5)) for i in rng.sample(sorted(parents), len(parents) // 2)] + [("unknown", 9)]
        total = {i: sum(k for j, k in direct if j in paths and i in paths[j]) for i in parents}
        for part in (4, 1000):
            got = taxonomy.rollup_by_intervals(numbered, spark.createDataFrame(direct, "id string, n long"), part)
            assert {r["id"]: r["total"] for r in got.collect()} == total
    assert taxonomy.intervals(tree.limit(0)).count() == 0
