"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A benchmark item is contained in a document if at least ``share`` of its distinct word shingles are in it. Items are
partitioned by their number of shingles; a partition's sketch size follows from its largest item: of n shingles, any
n - ceil(share * n) + 1 must include one that a containing document holds, so the sketch of that many smallest hashes
(the bottom of the MinHash order) can miss no document, however long it is. The hits of the sketches are verified by
exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, words

#: Item tables of up to so many shingles are broadcast (some 100 bytes each); larger ones are joined by a shuffle, of which
#: a bitmap of the sketches with so many bits (a row for each 64 of them) holds off what they can't hold.
BROADCAST, BITS = 200_000, 1 << 25
#: Up to so many ids of candidate documents are broadcast.
FOUND = 100_000
#: Upper bounds of the size partitions grow by this factor.
GROWTH = 2.0


def shingle_rows(df: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """A row (key, shingle) for each k-word shingle, repeats included; the whole sequence where there are fewer words."""
    w = df.select(F.col(key), words(ascii_lower(F.col(text))).alias("w")).where(F.size("w") > 0)
    columns = [F.slice("w", i + 1, F.greatest(F.size("w") - k + 1, F.lit(1))) for i in range(k)]
    zipped = w.select(key, F.inline(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(columns)])))
    return zipped.select(key, F.concat_ws(" ", *[f"`{c}`" for c in zipped.columns[1:]]).alias("shingle"))


def _size_class(n: Column) -> Column:
    return F.ceil(F.log(GROWTH, n.cast("double"))).cast("int")


def item_index(items: DataFrame, k: int, share: float) -> DataFrame:
    """item_id, shingle, n (the item's distinct shingles), in_sketch."""
    each = shingle_rows(items.select("item_id", "text"), "item_id", k).distinct()
    n = F.count("*").over(W.partitionBy("item_id"))
    at = F.row_number().over(W.partitionBy("item_id").orderBy(F.xxhash64("shingle"), "shingle"))
    ranked = each.withColumn("n", n).withColumn("at", at).withColumn("part", _size_class(F.col("n")))
    # the same for all items of a partition: what its largest possible item may miss, but no more than the item has
    largest = F.pow(F.lit(GROWTH), F.col("part"))
    size = F.floor(largest * (1 - share) + 1e-9) + 1
    return ranked.select("item_id", "shingle", "n", (F.col("at") <= size).alias("in_sketch"))


def maybe_held(rows: DataFrame, held: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose shingle may be in held: its bit is set in a bitmap of at most ``bits`` / 64 rows, which is broadcast."""
    at = F.pmod(F.xxhash64("shingle"), F.lit(bits))
    word, bit = F.floor(at / 64), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(shingle), {bits}), 64) as int))")
    bitmap = held.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return rows.join(F.broadcast(bitmap), hit, "left_semi")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8, runs: bool = False) -> DataFrame:
    """doc_id, item_id, n_shingles (distinct, of the item), n_shared, containment: a row for each item contained in a document.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null and empty texts contain nothing and are
    contained in nothing; an item of fewer than k words is one shingle and only found as such, or with runs, wherever a
    document has these words in a row. Documents of the same
    doc_id are judged together, as are items of the same item_id. Null ids are ignored, as they name nothing. Empty
    tables give an empty result; further columns are ignored.
    """
    index = cut(item_index(items.where("item_id is not null"), k, share))
    bounded = index.count() <= BROADCAST
    sent = F.broadcast if bounded else (lambda df: df)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    n_words = F.size(words(F.col("text")))
    short = [r["k"] for r in items.select(n_words.alias("k")).where(F.col("k").between(1, k - 1)).distinct().collect()] if runs else []

    def all_rows(df: DataFrame, held: DataFrame) -> DataFrame:
        out = shingle_rows(df, "doc_id", k)
        for fewer in short:
            out = out.unionByName(shingle_rows(df, "doc_id", fewer))
        return out if bounded else maybe_held(out, held)

    sketch = index.where("in_sketch").select("shingle").distinct()
    # first the documents that hold anything of a sketch, then the exact containment of these
    found = cut(all_rows(docs, sketch).join(sent(sketch), "shingle", "left_semi").select("doc_id").distinct())
    again = docs.join(F.broadcast(found) if found.count() <= FOUND else found, "doc_id", "left_semi")
    every = index.select("item_id", "shingle", "n")
    shared = all_rows(again, every).join(sent(every), "shingle").groupBy("doc_id", "item_id", "n").agg(F.countDistinct("shingle").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(share) - 1e-9)).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


#: What contained_items gives with its defaults, over views "documents" and "benchmark".
SQL = r"""
with lowered as (
  select 0 as kind, doc_id as id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') as w from documents
  union all
  select 1, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') from benchmark),
shingles as (
  select distinct kind, id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i : array_to_string(w[i:i + 4], ' '))) as shingle
  from lowered where len(w) > 0 and id is not null),
sizes as (select id, count(*) as n from shingles where kind = 1 group by id)
select d.id as doc_id, i.id as item_id, any_value(s.n) as n_shingles, count(*) as n_shared, count(*) / any_value(s.n) as containment
from shingles d join shingles i on d.shingle = i.shingle and d.kind = 0 and i.kind = 1 join sizes s on s.id = i.id
group by 1, 2 having count(*) >= ceil(any_value(s.n) * 0.8 - 1e-9)
"""
