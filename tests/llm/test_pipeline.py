from __future__ import annotations

import random

import corpus_pipeline

from tidemark.llm import quality

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == before
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] == sizes[3] and sizes[-1] > 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["amber", "birch", "cliff", "delta"]) + r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(10, 99)) + r.choice(["", "."]) for _ in range(n))


SCHEMA = "doc_id long, text string, row string, h string, n_chars long"


def test_odd_documents(spark):
    """Null and empty texts go with the quality rules; repeated rows leave one; null ids, ties and clashing columns stay as they are."""
    texts = [prose(120, i) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3] + " end"), (None, prose(90, 50)), (50, None), (51, ""), (52, " \n "), (7, prose(150, 51)), (60, prose(30_000, 52))]
    docs = spark.createDataFrame([(i, t, "clash", "clash", len(t or "")) for i, t in rows], SCHEMA)
    columns = docs.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        got[name] = docs.collect()
        docs = spark.createDataFrame(got[name], docs.schema)
        assert name == "packing" or docs.columns == columns
    assert not {50, 51, 52} & {r["doc_id"] for r in got["quality rules"]}
    kept = got["SimHash near-dedup"]
    wanted = {r["text"] for r in got["quality rules"]} - {texts[3] + " end"}
    assert sorted(r["text"] for r in kept) == sorted(wanted) and all(r["row"] == "clash" for r in kept)
    assert sorted(str(r["doc_id"]) for r in got["packing"] if r["start"] == 0) == sorted(str(r["doc_id"]) for r in got["benchmark decontamination"])


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0 and (name == "packing" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")])


def test_quality_stage_is_the_verdict(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    verdict = quality.judge(docs, quality.train(docs, labels)).where("kept").select("doc_id").collect()
    assert sorted(corpus_pipeline.quality_rules(spark, docs, FOLDER).select("doc_id").collect()) == sorted(verdict)
