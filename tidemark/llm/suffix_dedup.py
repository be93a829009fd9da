"""Removal of long repeated substrings by bucket-pointer refinement over anchored suffixes.

A byte is removed if it is covered by a string of ``length`` bytes that starts anywhere else too. Two such windows are
equal just if their anchors are: the anchor of a window is its leftmost smallest q-gram (by hash), so equal windows hold
it at the same place. The initial buckets are those q-grams; an anchor speaks for the windows that start ``d`` bytes
before it, for d in an interval. Buckets are then refined from the identifiers of the strings at earlier and later
offsets around the same anchor: the identifier of a longer string is made of those of its parts, an interval of d is
split into smaller ones (whose windows have more bytes in common), and each step only goes on with the buckets that
still hold several anchors and aren't known to be equal throughout. The last step has single windows, so the result is
exact but for collisions of 128-bit identifiers.

Nothing is compared pair by pair: each step counts identifiers, so a passage may have any number of copies.

The same is done with words for bytes, each word being the eight bytes of its hash, for passages of so many words; both
kinds of windows go through the same steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, small_batches, stored

#: Bytes of text taken at a time, so that memory stays bounded for texts of any length.
BLOCK = 1 << 19
SHIFT = 20  # low bits of a sort key that hold the place within a block

ANCHOR = "doc_id long, h long, x long, lo int, hi int, q long, f1 long, f2 long"


def _table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTES = _table()
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Unit:
    """What windows are counted in: size bytes of what data gives of a text."""

    size: int
    q: int
    widths: tuple[int, ...]

    def data(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        if self.size == 1:
            return data
        found = data.split()  # at ASCII white space
        return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).tobytes()


OF_BYTES, OF_WORDS = Unit(1, 64, (35, 5, 1)), Unit(8, 16, (12, 4, 1))
#: Lengths of windows, with their units; a window's kind is its place in this list.
Kinds = list[tuple[int, Unit]]


def bucket_ids(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q-grams of data: those of 2k bytes (or words) are made of the identifiers at a place and k later."""
    ids, k = BYTES[data] if data.dtype == np.uint8 else data, 1
    level = 0
    whole, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q >> level & 1:
                n = len(data) - done - k + 1
                part = ids[done : done + n] if done else ids
                whole = part if whole is None else whole[:n] * MULTIPLIERS[32 + level] + part
                done += k
            if 2 * k > q:
                break
            ids = ids[:-k] * MULTIPLIERS[level] + ids[k:]
            ids ^= ids >> np.uint64(29)
            k *= 2
            level += 1
        whole = whole * np.uint64(0x9E3779B97F4A7C15)
        return whole ^ (whole >> np.uint64(32))


def anchors(data: bytes, length: int, q: int, size: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, least and greatest d and q-gram identifier of each anchor of a text: the windows at x - d, for d from lo to hi, have their anchor at x."""
    span = length - q + 1  # q-grams of a window
    units = np.frombuffer(data, np.uint8 if size == 1 else np.uint64)
    n = len(units) - length + 1  # windows
    xs, los, his, grams = [], [], [], []
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        part = units[at : at + count + length - 1]
        ids = bucket_ids(part, q)
        key = ids >> np.uint64(SHIFT) << np.uint64(SHIFT) | np.arange(len(part) - q + 1, dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            key = np.minimum(key[:-k], key[k:])
            k *= 2
        key = np.minimum(key[:count], key[span - k : span - k + count])
        x = (key & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        last = np.r_[first[1:] - 1, count - 1]
        xs.append(x[first] + at)
        his.append(x[first] - first)
        los.append(x[first] - last)
        grams.append(ids[x[first]].view(np.int64))
    if not xs:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    return np.concatenate(xs), np.concatenate(los), np.concatenate(his), np.concatenate(grams)


def idents(strings: Iterable[bytes]) -> np.ndarray:
    """The 128-bit identifier of each string, as a row of two signed numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), ">i8").astype(np.int64).reshape(-1, 2)


def _anchored(length: int, unit: Unit):
    q, u = unit.q, unit.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, held, size = [], [], 0
            for i, text in enumerate(b["text"]):
                data = unit.data(text)
                x, lo, hi, grams = anchors(data, length, q, u)
                for j in range(0, len(x), 20_000):
                    some = slice(j, j + 20_000)
                    starts, ends = (u * (x[some] - hi[some])).tolist(), (u * (x[some] - lo[some] + length)).tolist()
                    whole = idents(data[start:end] for start, end in zip(starts, ends, strict=True))
                    held.append(np.column_stack([x[some], lo[some], hi[some], grams[some], whole]))
                    at.append(i)
                    size += len(whole)
                    if size >= 20_000:
                        yield _anchor_rows(b, at, held)
                        at, held, size = [], [], 0
            if held:
                yield _anchor_rows(b, at, held)

    return run


def _all_anchored(kinds: Kinds):
    """The anchors of all kinds of windows, with the kind; a text goes to Python once."""
    runs = [_anchored(length, unit) for length, unit in kinds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for kind, anchored in enumerate(runs):
                for rows in anchored(iter([b])):
                    yield rows.assign(kind=kind)

    return run


def _anchor_rows(b: pd.DataFrame, at: list[int], held: list[np.ndarray]) -> pd.DataFrame:
    of = np.repeat(at, [len(r) for r in held])
    names = [c.split()[0] for c in ANCHOR.split(", ")[2:]]
    return pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array[of], "h": b["h"].to_numpy()[of], **dict(zip(names, np.concatenate(held).T, strict=True))})


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})


# -- refinement -----------------------------------------------------------------------------------------------------

#: A part of an anchor's windows: d from lo to hi, within the cell [cell, cell + width) of the step's grid. c1, c2
#: identify the string that all windows of the cell have in common, f1, f2 all that the windows from lo to hi cover.
PART = "doc_id long, h long, kind int, x long, lo int, hi int, cell int, c1 long, c2 long, f1 long, f2 long, around binary"
WINDOW = ["doc_id", "h", "kind", "x", "lo", "hi"]
AROUND = "doc_id long, h long, kind int, x long, lo int, hi int, around binary"


def _split(step: int, kinds: Kinds):
    """Parts of a step. around holds the bytes from the start of the first window to the end of the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, strings = [], []
            for doc_id, h, kind, x, lo, hi, around in zip(*[b[c] for c in WINDOW], b["around"], strict=True):
                length, u, width = kinds[kind][0], kinds[kind][1].size, kinds[kind][1].widths[step]
                # byte p of the text is around[p - x + hi]; a word has u bytes
                for cell in range(lo // width * width, hi + 1, width):
                    a, z = max(lo, cell), min(hi, cell + width - 1)
                    far = cell + width - 1  # the common string starts cell bytes before x and ends where a window at far does
                    common = around[u * (hi - cell) : u * (hi - far + length)]
                    whole = around[u * (hi - z) : u * (hi - a + length)]
                    rows.append((doc_id, h, kind, x, a, z, cell, whole))
                    strings += [common, whole]
                if len(rows) >= 2_000:
                    yield _part_rows(rows, strings)
                    rows, strings = [], []
            if rows:
                yield _part_rows(rows, strings)

    return run


def _part_rows(rows: list[tuple], strings: list[bytes]) -> pd.DataFrame:
    out = _frame(rows, "doc_id long, h long, kind int, x long, lo int, hi int, cell int, around binary")
    out[["c1", "c2", "f1", "f2"]] = idents(strings).reshape(-1, 4)
    return out[[c.split()[0] for c in PART.split(", ")]]


def _several(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that occur more than once, written, so that a join with them may split a key of very many rows."""
    return stored(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), name)


def _marks(windows: DataFrame) -> DataFrame:
    return windows.groupBy("doc_id", "h").agg(F.collect_set(F.struct(*WINDOW[2:])).alias("at"))


def _around(rows: DataFrame, windows: DataFrame, kinds: Kinds) -> DataFrame:
    """doc_id, h, kind, x, lo, hi, around for windows (doc_id, h, kind, x, lo, hi) of rows (doc_id, h, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, h, text, *at in zip(b["doc_id"], b["h"], b["text"], *[b[c] for c in WINDOW[2:]], strict=True):
                data: dict[int, bytes] = {}
                for kind, x, lo, hi in zip(*[c.tolist() for c in at], strict=True):
                    length, unit = kinds[kind]
                    if kind not in data:
                        data[kind] = unit.data(text)
                    out.append((doc_id, h, kind, x, lo, hi, data[kind][unit.size * (x - hi) : unit.size * (x - lo + length)]))
                    if len(out) >= 2_000:
                        yield _frame(out, AROUND)
                        out = []
            yield _frame(out, AROUND)

    # a column for each field: numbers come as arrays, not as an object for each window
    return _with(rows, _marks(windows)).select("doc_id", "h", "text", *[F.col(f"at.{c}").alias(c) for c in WINDOW[2:]]).mapInPandas(run, AROUND)


def _with(rows: DataFrame, marks: DataFrame, how: str = "inner") -> DataFrame:
    other = marks.withColumnsRenamed({"doc_id": "of_id", "h": "of_h"})
    return rows.join(other, rows["doc_id"].eqNullSafe(other["of_id"]) & (rows["h"] == other["of_h"]), how).drop("of_id", "of_h")


def repeated_windows(rows: DataFrame, kinds: Kinds) -> DataFrame:
    """(doc_id, h, kind, x, lo, hi): the windows at x - hi to x - lo of these texts are those of the kind's length, in bytes or words, that start elsewhere too.

    rows has doc_id, h (a hash of the text; tells rows of a repeated id apart) and text without nulls. Each of a unit's
    widths divides the one before; the last is 1. All kinds are refined in the same steps, so they have as many widths.
    """
    spans, whole_key = WINDOW, ["kind", "f1", "f2", "lo", "hi"]
    found = stored(rows.mapInPandas(_all_anchored(kinds), f"{ANCHOR}, kind int"), "anchors")
    alike = stored(found.join(_several(found, ["q"], "grams"), "q", "left_semi"), "alike")
    forget(found)
    decided, todo, parts = [], None, None
    steps = len(kinds[0][1].widths)
    for step in range(-1, steps):
        if step < 0:
            keys, bucket = alike, ["q"]  # two kinds may share one: it only opens buckets
        else:
            source = _around(rows, todo, kinds) if parts is None else _semi(parts.select(*spans, "around"), todo, spans)
            before, parts = parts, stored(source.mapInPandas(_split(step, kinds), PART), "parts")
            if before is not None:
                forget(before)
            keys, bucket = parts.drop("around"), ["kind", "cell", "c1", "c2"]
            keys = keys.join(_several(keys, bucket, "buckets"), bucket, "left_semi")
        if step == steps - 1:
            decided.append(stored(keys.select(*spans), "decided"))
            forget(parts)
            break
        whole = _several(keys, whole_key, "whole").withColumn("same", F.lit(True))
        flagged = stored(keys.join(whole, whole_key, "left"), "flagged")
        if step < 0:
            forget(alike)
        same, rest = flagged.where("same"), flagged.where("same is null")
        decided.append(same.select(*spans))
        # a part of an undecided anchor may equal one of a decided class, for which one member speaks
        by = list(dict.fromkeys([*whole_key, *bucket]))
        members = same.groupBy(*by).agg(F.first(F.struct("doc_id", "h", "x")).alias("m")).select("m.*", *by)
        speak = members.join(stored(rest.select(*bucket).distinct(), "open"), bucket, "left_semi")
        todo = rest.select(*spans).unionByName(speak.select(*spans))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def _semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key, nulls included, is in other."""
    other = other.select(*[F.col(c).alias(f"of_{c}") for c in on])
    fits = F.lit(True)
    for c in on:
        fits = fits & df[c].eqNullSafe(other[f"of_{c}"])
    return df.join(other, fits, "left_semi")


CUT = "n_bytes long, n_removed long, n_spans long, kept binary, text string"


def _spans(data: bytes, kind: int, kinds: Kinds, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (from, to) of runs of windows of a kind, which may overlap; at has kind, x, lo and hi of each."""
    own, length = at[0] == kind, kinds[kind][0]
    x, lo, hi = (c[own].astype(np.int64) for c in at[1:])
    starts, stops = x - hi, x - lo + length  # windows from one start to another cover all to the end of the last
    if kinds[kind][1].size == 1 or not len(x):
        return starts, stops
    ends = np.array([m.span() for m in re.finditer(rb"\S+", data)], np.int64)
    return ends[starts, 0], ends[stops - 1, 1]


def _without(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes left by taking spans, which may overlap, out of data."""
    if not len(starts):
        return 0, 0, data
    by = np.argsort(starts, kind="stable")
    starts, stops = starts[by], np.maximum.accumulate(stops[by])
    first = np.flatnonzero(np.r_[True, starts[1:] > stops[:-1]])
    starts, stops = starts[first], stops[np.r_[first[1:] - 1, len(stops) - 1]]
    kept = b"".join(data[a:z] for a, z in zip([0, *stops.tolist()], [*starts.tolist(), len(data)], strict=True))
    return len(data) - len(kept), len(first), kept


def _cut(kinds: Kinds):
    """Of a text and its repeated windows (kind, x, lo and hi of each): the number of its bytes, of those that the windows
    of bytes remove and of the removed runs, the bytes that these leave, and the text that all windows leave. A null text
    gives nothing."""

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, kind: pd.Series, x: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for text, *at in zip(texts, kind, x, lo, hi, strict=True):
            if text is None:
                out.append((0, 0, 0, b"", ""))
                continue
            data = text.encode("utf-8", "surrogatepass")
            spans = [_spans(data, k, kinds, at) for k in range(len(kinds))]
            removed, runs, left = _without(data, *spans[0])
            kept = left
            if any(len(starts) for starts, _ in spans[1:]):
                left = _without(data, *map(np.concatenate, zip(*spans, strict=True)))[2]
            out.append((len(data), removed, runs, kept, left.decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])

    return cut(F.expr(REPEATING), *[F.col(f"at.{c}") for c in WINDOW[2:]])


def _kinds(length: int, n_words: int) -> Kinds:
    return [(length, OF_BYTES), *([(n_words, OF_WORDS)] if n_words else [])]


def _marked(docs: DataFrame, kinds: Kinds) -> DataFrame:
    """docs with h, a text without nulls, and at: its repeated windows, or null."""
    small_batches(docs.sparkSession)
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "h", "text")
    return _with(rows, _marks(repeated_windows(texts, kinds)), "left")


#: Whether a text has repeated windows, and the text if so: only such texts are sent to Python.
REPEATS = "at is not null"
REPEATING = f"case when {REPEATS} then text end"


def without_repeats(docs: DataFrame, length: int = 400, n_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), text for each row of docs (doc_id, text, ...).

    Texts are taken as UTF-8; null counts as empty. Repeated rows are texts of their own, so each covers the other; null
    and repeated ids are allowed. Strings are judged on the input; overlapping occurrences count. An empty table gives
    an empty result; further columns are ignored. The four columns after doc_id are about strings of ``length`` bytes
    alone. text is the readable rest: with n_words, what is covered by so many words that start anywhere else too is
    out of it besides (see strip_repeats).
    """
    kinds = _kinds(length, n_words)
    marked = _marked(docs.select("doc_id", "text"), kinds)
    marked = marked.select("doc_id", "text", F.expr(REPEATS).alias("repeats"), _cut(kinds).alias("cut"))
    whole = {"n_bytes": F.octet_length("text").cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": F.col("text").cast("binary"), "text": F.col("text")}
    return marked.select("doc_id", *[F.when(F.col("repeats"), F.col(f"cut.{c}")).otherwise(v).alias(c) for c, v in whole.items()])


def strip_repeats(docs: DataFrame, length: int = 400, n_words: int = 0) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars (if there is one) counted anew; all rows and columns stay.

    As without_repeats, and with n_words also what is covered by so many words that start anywhere else too, from the
    first to the last, whatever ASCII white space is between them. Both are judged on the input. A character of which
    only a part is removed is removed as a whole.
    """
    given = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    kinds = _kinds(length, n_words)
    new = _cut(kinds)["text"]
    out = _marked(given, kinds).select("row", F.when(F.expr(REPEATS), new).otherwise(F.col("text")).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of what without_repeats gives."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")
