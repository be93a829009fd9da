"""Bounded-space online packing of token ids into sequences.

Each partition streams its documents: full sequences of a document go out at once, its rest goes to the open window
where it fits best. At most ``open_windows`` windows are open; when a rest fits in none, the fullest goes out. The
windows still open at the end of the partitions are merged by groups of partitions, until one group is left.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, stored

END = 1  # the id after each document
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
#: A single space between two other characters starts a token of the byte-level pattern, whatever stands around.
SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


@cache
def encoder(path: str):
    """Ids of a text by the tokenizers file at path. Its merges are run by tiktoken where the two libraries can't
    differ (byte-level BPE with the plain pattern, no character beyond Latin), otherwise by tokenizers."""
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.load(open(path))
    plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    ranks_at = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if plain and os.path.exists(ranks_at):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_at, "rb"))}
        fast = tiktoken.Encoding("tidemark", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
    beyond = re.compile("[^\x00-ɏ]")
    long_run = re.compile(r"[^\s]{20000}|\s{20000}")

    def encode(text: str) -> np.ndarray:
        if fast is not None and not beyond.search(text) and not long_run.search(text):
            return fast.encode_to_numpy(text, allowed_special="all")
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode, plain


def token_blocks(text: str, path: str, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The ids of a text, in blocks that are cut where a token begins in any case."""
    encode, plain = encoder(path)
    at = 0
    while plain and len(text) - at > block and (m := SAFE.search(text, at + block)):
        yield encode(text[at : m.start()])
        at = m.start()
    yield encode(text[at:])


class Windows:
    """The open windows of a partition: pieces of each and the space left."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.left: list[tuple[int, int]] = []  # (space left, window), sorted
        self.pieces: dict[int, list[tuple]] = {}

    def place(self, piece: tuple) -> list[tuple]:
        """Put a piece (its length is item 2) in a window; the rows of the window that goes out, if one does."""
        n, out = piece[2], []
        if n == self.size:  # goes out at once and takes no slot
            self.next_id += 1
            return [(*piece[:5], self.next_id - 1, 0, False)]
        at = bisect_left(self.left, (n, -1))
        if at < len(self.left):
            space, window = self.left.pop(at)
        else:
            if len(self.left) == self.most:
                out = self.close(self.left.pop(0)[1], False)
            space, window = self.size, self.next_id
            self.next_id += 1
        self.pieces.setdefault(window, []).append(piece)
        if space == n:
            out += self.close(window, False)
        else:
            insort(self.left, (space - n, window))
        return out

    def close(self, window: int, still_open: bool) -> list[tuple]:
        rows, offset = [], 0
        for p in self.pieces.pop(window):
            rows.append((*p[:5], window, offset, still_open))
            offset += p[2]
        return rows

    def finish(self, still_open: bool) -> list[tuple]:
        return [r for _, w in self.left for r in self.close(w, still_open)]


def _first_id(level: int, part: int) -> int:
    return (level << 56) + (part << 32)


def _packed(path: str, size: int, most: int):
    def pieces(doc_id, text: str) -> Iterator[tuple]:
        """(doc_id, start, length, crc, tokens): cut at each full sequence."""
        found, total, held = [], 0, []
        count = 0
        for ids in chain(token_blocks(text, path), [np.array([END], np.uint32)]):
            held.append(ids)
            count += len(ids)
            if count >= size:
                ids = np.concatenate(held)
                full = len(ids) // size * size
                for i in range(0, full, size):
                    found.append((total + i, size, crc32(ids[i : i + size].astype("<u4").tobytes())))
                total += full
                held, count = [ids[full:]], len(ids) - full
        if count:
            found.append((total, count, crc32(np.concatenate(held).astype("<u4").tobytes())))
        return ((doc_id, *f, total + count) for f in found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        windows = Windows(size, most, _first_id(0, part))
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                for p in pieces(None if pd.isna(doc_id) else int(doc_id), text):
                    rows += windows.place(p)
            yield _frame(rows, part)
        yield _frame(windows.finish(True), part)

    return run


def _frame(rows: list[tuple], part: int) -> pd.DataFrame:
    return pd.DataFrame([(*r, part) for r in rows], columns=COLUMNS).astype({"doc_id": "Int64"})


def _merged(size: int, most: int, level: int, last: bool):
    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(size, most, _first_id(level, int(key[0])))
        rows: list[tuple] = []
        for p in left.sort_values(["length", "doc_id", "start", "part", "sequence_id", "offset"], ascending=[False] + [True] * 5)[COLUMNS[:5]].itertuples(index=False):
            rows += windows.place((None if pd.isna(p[0]) else int(p[0]), *map(int, p[1:])))
        return _frame(rows + windows.finish(not last), int(key[0]))

    return run


def pack(docs: DataFrame, path: str, size: int = 2048, open_windows: int = 64, fan_in: int = 64) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids, without special tokens added, then END. Null and empty texts are that one id. Documents are
    cut at each full sequence only; repeated rows and null ids are packed row by row. An empty table gives an empty
    result; further columns are ignored. The merge of leftovers takes fan_in partitions' windows at a time: a bounded
    number of tokens a group.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # written: which partition a piece was packed in must not change when an executor is lost
    pieces = stored(rows.mapInPandas(_packed(path, size, open_windows), PIECE), "pieces")
    out, level = pieces.where("not open"), 0
    left = pieces.where("open")
    while True:
        level += 1
        top = left.agg(F.max("part")).first()[0] or 0
        last = top < fan_in
        merged = left.withColumn("group", F.expr(f"part div {fan_in}")).groupBy("group").applyInPandas(_merged(size, open_windows, level, last), PIECE)
        merged = stored(merged, "merged")
        out = out.unionByName(merged.where("not open"))
        if last:
            return out.select(COLUMNS[:7])
        left = merged.where("open")
