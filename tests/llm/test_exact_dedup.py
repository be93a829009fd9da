from __future__ import annotations

import collections
import hashlib
import random
import re

from tidemark.llm.common import scratch
from tidemark.llm.exact_dedup import DigestIndex, deduplicate, digests

SCHEMA = "doc_id long, text string, row string, digest string, keep_id string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def held(got):
    return sorted(map(tuple, got.collect()), key=str)


def test_exact_dedup(spark):
    random.seed(2)
    rows = [(i, random.choice(["a b", "a \t\nb", " a b", "", None, "é", "b", "x" * 200_000]) if i % 3 else "hot  text") for i in range(400)]
    rows += [(7, "once"), (7, "once"), (None, "once"), (None, "none"), (None, "none"), (500, " "), (501, "\t\x0b"), (502, "\x1f"), (503, "\xa0")]
    random.shuffle(rows)
    got = held(deduplicate(frame(spark, rows).repartition(6)))
    groups = collections.defaultdict(list)
    for i, x in rows:
        groups[sha(x)].append(i)
    expected = []
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        expected += [(i, ids[0], len(ids), at == 0, h) for at, i in enumerate(ids)]
    assert got == sorted(expected, key=str)


def test_index_persists(spark):
    root = scratch(spark, "test-index")
    first = DigestIndex(spark, root, 4)
    assert held(deduplicate(frame(spark, [(1, "a"), (2, "b"), (3, "a")]), first, 1)) == [(1, 1, 2, True, sha("a")), (2, 2, 1, True, sha("b")), (3, 1, 2, False, sha("a"))]
    first.drop()
    again = DigestIndex(spark, root, 99)
    assert again.buckets == 4 and again.table().count() == 2
    assert held(deduplicate(frame(spark, [(0, "a"), (5, "c")]), again)) == [(0, 1, 1, False, sha("a")), (5, 5, 1, True, sha("c"))]
    rows = digests(frame(spark, [(9, "c"), (8, "d")]))
    for _ in range(2):  # a driver that tries again
        again.append(rows, "s")
    assert again.table().count() == 4
    again.compact(2)
    assert again.table().count() == 4 and DigestIndex(spark, root, 9).buckets == 2


def test_plan_of_the_anti_join(spark):
    index = DigestIndex(spark, scratch(spark, "test-index"), 8)
    new = digests(frame(spark, [(1, "a")])).groupBy("digest").count()
    plan = new.hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_empty(spark):
    assert deduplicate(frame(spark, [])).count() == 0
