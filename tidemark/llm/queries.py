"""The thin registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, exact_dedup, hard_negatives, quality, suffix_dedup, warc
from tidemark.llm.common import scratch, table
from tidemark.llm.html_extract import extract_text
from tidemark.llm.packing import pack
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.token_counts import token_counts
from tidemark.llm.url_filter import judge_urls
from tidemark.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; null texts have none."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents; null texts have fingerprint zero."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of all pages; a null url has an empty host and path."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: A conversation that the query adds: its texts hold marks of the template.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all formatted conversations and one whose texts hold marks of the template."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(given.unionByName(added)))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; null html has an empty one."""
    return extract_text(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents contain, over all documents."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, as they are read back from the archives."""
    out = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of all documents; null texts fail the base rules."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a null text is its end id."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: the rest without passages of over 50 words that repeat, which mostly have fewer than 400 bytes."""
    return suffix_dedup.digests(suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), n_words=51))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of all valid embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays for each of all documents; null texts are empty ones."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose vec_id is divisible by 100; labels of ids divisible by 7 move on by one."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(given, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash_near_dedup, op3_url_filter, op4_chat_format, op5_html_extract, op6_decontaminate, op7_warc, op8_quality, op9_packing, op10_suffix_dedup, op11_whitening, op12_exact_dedup, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    marked = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in MARKED)
    turns = f"turns as (select conv_id, turn, role, text from conversations union all select * from (values {marked}) v(conv_id, turn, role, text)),"
    return {"op4_chat_format": chat.SQL.replace("with ", f"with {turns} ", 1), "op6_decontaminate": decontaminate.SQL, "op7_warc": warc.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_hard_negatives": hard_negatives.SQL}
