"""Exact token counts of whole texts by a public tokenizer, with overlap resynchronisation for huge texts.

A huge text is cut into overlapping chunks that are dealt to different tasks. Each chunk is encoded with
offsets. Two neighbours are spliced at a proven stable boundary, which is a position in their overlap where

* both encodings start a new pre-token (the pre-tokenizer is a forward scan without look-behind, so two scans
  that both start a match at a position go on alike from there),
* the left chunk goes on for at least ``MARGIN`` more characters (longer than any look-ahead or special string),
* the right chunk has at least ``MARGIN`` characters before it, and the character before is white space, or the
  character itself is ASCII (normalisation then can't reach across it).

Texts in which a pair of neighbours has no such position are done again with wider overlaps, until one chunk
holds the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches

MARGIN = 64
MEMO = 500_000


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_batch(path: str, texts: list[str], memo: dict[str, int], block: int = 200_000) -> list[int]:
    """Token counts; a space is a stable boundary of this vocabulary, so each distinct piece between spaces is encoded once.

    Texts are taken in blocks of about ``block`` characters. memo is kept between blocks and emptied when it holds MEMO
    pieces; results don't depend on it.
    """
    counts: list[int] = []
    begin = size = 0
    for end, t in enumerate(texts, 1):
        size += len(t)
        if size < block and end < len(texts):
            continue
        if len(memo) > MEMO:
            memo.clear()
        pieces = [t.split(" ") for t in texts[begin:end]]
        new = list({w for p in pieces for w in p if w not in memo})
        memo.update(zip(new, map(len, tokenizer(path).encode_batch_fast(new, add_special_tokens=False)), strict=True))
        counts += [sum(map(memo.__getitem__, p)) for p in pieces]
        begin, size = end, 0
    return counts


#: A pattern of pre-tokens none of which holds white space, and normalisers that keep a space where it is.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KEEPS_SPACE = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})


@cache
def space_is_stable(path: str) -> bool:
    """Whether texts can be cut at any space, by what the tokenizer file says.

    So it is where the normalisers neither move a space nor join what is around it, the first pre-tokenizer throws away
    white space and its pattern looks at nothing beside its match, no later step cuts by a pattern, and no added token
    holds white space or takes that beside it.
    """
    spec = json.load(open(path))
    steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])
    first, *later = (spec["pre_tokenizer"] or {}).get("pretokenizers", [None])
    split = {"type": "Split", "pattern": {"Regex": SPACELESS}, "behavior": "Removed", "invert": True}
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].split() == [t["content"]] for t in spec["added_tokens"])
    return added and first == split and all(s in KEEPS_SPACE for s in steps) and all(t["type"] == "ByteLevel" and not t["use_regex"] and not t["add_prefix_space"] for t in later)


def boundaries(path: str, chunk: str, at: int, first: bool, last: bool, overlap: int) -> tuple[list[int], list[int], list[int], list[int], int]:
    """Of a chunk that starts at position ``at`` of its text: stable positions in its left and right overlap with the
    number of the chunk's tokens before each, and the number of all its tokens."""
    e = tokenizer(path).encode(chunk, add_special_tokens=False)
    found: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
    before = None
    for k, ((start, _), word) in enumerate(zip(e.offsets, e.word_ids, strict=True)):
        fresh, before = word is None or word != before, word
        if not fresh or not (chunk[start].isascii() or chunk[start - 1].isspace()):
            continue
        if not first and MARGIN <= start < overlap:
            found[0].append(at + start)
            found[1].append(k)
        if not last and len(chunk) - overlap <= start <= len(chunk) - MARGIN:
            found[2].append(at + start)
            found[3].append(k)
    return *found, len(e.ids)


def _encode_short(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        stable = space_is_stable(path)
        for b in batches:
            texts = b["text"].tolist()
            counts = count_batch(path, texts, memo) if stable else [len(e) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": counts})

    return run


def _cut_up(size: int, overlap: int, block: int = 64):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, text in zip(b["row"], b["text"], strict=True):
                starts = range(0, max(len(text) - overlap, 1), size - overlap)
                for k in range(0, len(starts), block):
                    at = starts[k : k + block]
                    yield pd.DataFrame({"row": [row] * len(at), "at": at, "n": len(text), "chunk": [text[i : i + size] for i in at]})

    return run


def _encode_chunks(path: str, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [boundaries(path, c, at, at == 0, at + len(c) >= n, overlap) for c, at, n in zip(b["chunk"], b["at"], b["n"], strict=True)]
            yield pd.DataFrame({"row": b["row"], "at": b["at"], **dict(zip(("left_pos", "left_k", "right_pos", "right_k", "total"), zip(*out, strict=True), strict=True))})

    return run


def _spliced(docs: DataFrame, path: str, size: int, overlap: int, parts: int) -> DataFrame:
    """(row, n_tokens) of docs (row, text); n_tokens is null where neighbours share no stable position."""
    step = size - overlap
    row = "row struct<id:bigint,h:bigint>"
    chunks = docs.select("row", "text").mapInPandas(_cut_up(size, overlap), f"{row}, at long, n long, chunk string")
    longs = "array<long>"
    coded = chunks.repartition(parts, "row", "at").mapInPandas(_encode_chunks(path, overlap), f"{row}, at long, left_pos {longs}, left_k {longs}, right_pos {longs}, right_k {longs}, total long")
    # one row a chunk: each neighbour's boundaries meet under the number of the pair
    pairs = coded.select("row", F.explode(F.array(
        F.struct((F.col("at") / step).cast("long").alias("pair"), F.lit(None).cast(longs).alias("lp"), F.lit(None).cast(longs).alias("lk"), F.col("right_pos").alias("rp"), F.col("right_k").alias("rk"), F.col("total").alias("total")),
        F.struct(((F.col("at") / step).cast("long") - 1).alias("pair"), F.col("left_pos").alias("lp"), F.col("left_k").alias("lk"), F.lit(None).cast(longs).alias("rp"), F.lit(None).cast(longs).alias("rk"), F.lit(0).cast("long").alias("total")),
    )).alias("x")).select("row", "x.*")
    met = pairs.groupBy("row", "pair").agg(*[F.max(c).alias(c) for c in ("lp", "lk", "rp", "rk")], F.sum("total").alias("total"), F.count("*").alias("sides"))
    met = met.withColumn("cut", F.array_min(F.array_intersect("lp", "rp")))
    # the left chunk counts up to the cut, the right one from there on
    drop = F.expr("total - element_at(rk, cast(array_position(rp, cut) as int))") + F.expr("element_at(lk, cast(array_position(lp, cut) as int))")
    one_sided = (F.col("pair") < 0) | (F.col("sides") == 1)
    return met.groupBy("row").agg(
        F.when(F.bool_or(~one_sided & F.col("cut").isNull()), None).otherwise(F.sum("total") - F.sum(F.when(one_sided, 0).otherwise(drop))).alias("n_tokens")
    )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = 32_768, size: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text, ...).

    Null text counts as empty; empty texts have no tokens. Rows are kept as they come: repeated rows and null or
    repeated ids each give a row. Further columns are ignored. Texts of over ``huge`` characters go by chunks of
    ``size`` characters that overlap by ``overlap``; where splicing fails, both grow eightfold.
    """
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    is_huge = F.char_length("text") > huge
    counts = rows.where(~is_huge).mapInPandas(_encode_short(path), "doc_id long, n_bytes long, n_tokens long")
    # with its hash, a text is told apart from others of a repeated or null id
    long = rows.where(is_huge).withColumn("row", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    todo = long.select("row", "text").dropDuplicates(["row"])
    while True:
        got = cut(_spliced(todo, path, size, overlap, parts))
        done = got.where("n_tokens is not null")
        counts = counts.unionByName(long.select("doc_id", "n_bytes", "row").join(done, long["row"].eqNullSafe(done["row"])).select("doc_id", "n_bytes", "n_tokens"))
        failed = got.where("n_tokens is null").select(F.col("row").alias("failed"))
        if failed.isEmpty():
            break
        todo = todo.join(failed, todo["row"].eqNullSafe(failed["failed"]), "left_semi")
        size, overlap = size * 8, overlap * 8
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
