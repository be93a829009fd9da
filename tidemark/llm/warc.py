"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are range-sorted by page_id and payload digest into shards whose bounds follow from the table alone: sizes are
summed up along a Spark sort, and a shard starts where the sum passes its share. A task streams one shard into gzip
files (one member a record) and rolls a file at a compressed size. Files get temporary names of their own
attempt; the manifest, written by Spark, names the files of the attempts that counted, and only then they are moved
to their final names. A lost executor thus leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, stored

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100  # bytes of a payload that is worth a revisit
#: Bytes that a record counts besides its payload; shards of a table at most.
HEAD, MOST_SHARDS = 512, 20_000
MANIFEST = "shard long, part long, temp string, name string, records long, bytes long, sha256 string"


def filesystem(uri: str):
    """The file system and path of a folder that driver and executors share (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# -- records --------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _safe(url: str) -> str:
    """A header value: control characters and the percent sign before them are written as %XX."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: the whole payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _safe(url) if url else f"urn:page:{page_id}",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


class _File:
    """An archive under a temporary name."""

    def __init__(self, fs, folder: str, shard: int, part: int):
        self.shard, self.part = shard, part
        self.temp, self.name = f"_temporary/{uuid.uuid4().hex}", f"part-{shard:06d}-{part:05d}.warc.gz"
        self.out, self.hash, self.bytes, self.records = fs.open_output_stream(f"{folder}/{self.temp}", compression=None), hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temp, self.name, self.records, self.bytes, self.hash.hexdigest()


def _write(out_dir: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = filesystem(out_dir)
        now: _File | None = None
        ref: tuple = ()
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        for b in batches:
            ended = []
            for shard, page_id, digest, kind, url, payload, first in b.itertuples(index=False):
                page_id = None if pd.isna(page_id) else int(page_id)
                if kind == 0:
                    ref = (page_id, digest, int(first))
                    continue
                if now is None or now.shard != shard or now.bytes >= roll:
                    part = 0 if now is None or now.shard != shard else now.part + 1
                    if now is not None:
                        ended.append(now.close())
                    now = _File(fs, folder, int(shard), part)
                now.add(record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, ref[2] if ref[:2] == (page_id, digest) else None))
            if ended:
                yield pd.DataFrame(ended, columns=columns)
        if now is not None:
            yield pd.DataFrame([now.close()], columns=columns)

    return run


def _moved(out_dir: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, folder = filesystem(out_dir)
        for b in batches:
            for temp, name in zip(b["temp"], b["name"], strict=True):
                if fs.get_file_info(f"{folder}/{temp}").type == FileType.File:  # else an earlier attempt has moved it
                    fs.move(f"{folder}/{temp}", f"{folder}/{name}")
            yield b

    return run


def _key() -> list[Column]:
    """What records are sorted by: page_id, nulls first, then the first 16 digits of the digest."""
    return [F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0).cast("long")).alias("id"), F.substring("digest", 1, 16).alias("tie")]


def shard_spans(keys: DataFrame, most: int, least: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """First key of each shard, sorted, and its numbers (one, or a span of shards for a key that fills several).

    keys has page_id, digest and payload_bytes. Shards are of about a 64th of all bytes, within ``least`` and ``most``,
    or larger where there would be over MOST_SHARDS; the driver sees a row for each, that many at most.
    """
    each = stored(keys.select(*_key(), "payload_bytes").groupBy("has", "id", "tie").agg(F.sum(F.col("payload_bytes") + HEAD).alias("size")), "warc-sizes")
    total = each.agg(F.sum("size")).first()[0] or 0
    target = max(1, total // MOST_SHARDS + 1, min(most, max(least, total // 64)))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(each.repartitionByRange(parts, "has", "id", "tie").withColumn("part", F.spark_partition_id()), "warc-ranges")
    before = dealt.groupBy("part").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).drop("n")  # a row a part
    start = F.col("before") + F.sum("size").over(W.partitionBy("part").orderBy("has", "id", "tie")) - F.col("size")
    at = dealt.join(F.broadcast(before), "part").select("has", "id", "tie", F.floor(start / target).alias("shard"), (F.floor((start + F.col("size") - 1) / target)).alias("last"))
    spans = at.groupBy("shard").agg(F.min(F.struct("has", "id", "tie")).alias("first"), F.max(F.when(F.col("last") > F.col("shard") + 1, F.struct("has", "id", "tie", "last"))).alias("wide")).collect()
    found = {}
    for r in spans:
        found[tuple(r["first"])] = (r["shard"], r["shard"])
        if r["wide"] is not None:  # a key of over a shard's size gets the shards that it fills alone
            *key, last = r["wide"]
            found[tuple(key)] = (r["shard"] + 1, last - 1)
    firsts = sorted(found)
    spans = [found[k] for k in firsts]
    return firsts, spans


def _spans_of(firsts: list[tuple], spans: list[tuple[int, int]]):
    """The span of shards of each record's key."""

    @F.pandas_udf("first long, last long")
    def span(has: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        at = [spans[max(0, bisect_right(firsts, k) - 1)] for k in zip(has, ids, ties, strict=True)]
        return pd.DataFrame(at, columns=["first", "last"], dtype="int64")

    return span


def write_warc(pages: DataFrame, out_dir: str, roll: int = 64 << 20, shard: int = 64 << 20, least: int = 4 << 20) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html, ...) to out_dir, and return the manifest.

    A null html is an empty payload. Of records with equal payloads of at least LEAST bytes, that with the smallest
    page_id is a response (all such rows if the id repeats) and the others revisit it; null ids never are revisited or
    revisit, and sort first. Repeated rows give a record each. An empty table gives an empty manifest and no file;
    further columns are ignored. Files roll at ``roll`` compressed bytes, shards are of ``least`` to ``shard`` payload
    bytes (see shard_spans). The same rows give the same files; only the records of one id and payload that fill several
    shards are dealt to these by their place in the input.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = stored(rows.select("page_id", "digest", "payload_bytes"), "warc-keys")
    known = keys.where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull())
    firsts = stored(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select("digest", "first"), "warc-firsts")
    revisits = known.join(firsts, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    starts, spans = shard_spans(keys, shard, least)
    span = _spans_of(starts, spans or [(0, 0)])(*_key())
    null = F.lit(None).cast("string")
    every = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"), span.alias("s"))
    every = every.withColumn("shard", F.col("s.first") + F.pmod(F.monotonically_increasing_id(), F.col("s.last") - F.col("s.first") + 1))
    refs = revisits.select("page_id", "digest", F.lit(0).alias("kind"), null.alias("url"), null.alias("payload"), "first", span.alias("s"))
    refs = refs.withColumn("shard", F.explode(F.sequence("s.first", "s.last")))
    columns = ["shard", "page_id", "digest", "kind", "url", "payload", "first"]
    n = max((last for _, last in spans), default=0) + 1
    dealt = every.select(columns).unionByName(refs.select(columns)).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    fs, folder = filesystem(out_dir)
    fs.create_dir(f"{folder}/_temporary", recursive=True)
    manifest = stored(dealt.mapInPandas(_write(out_dir, roll), MANIFEST), "warc-manifest")
    done = manifest.repartition("name").mapInPandas(_moved(out_dir), MANIFEST)
    done.write.parquet(f"{out_dir}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/_manifest")


# -- reading --------------------------------------------------------------------------------------------------------


class _Members(io.RawIOBase):
    """The unpacked bytes of a file of gzip members, as they come."""

    def __init__(self, source, block: int = 1 << 20):
        self.source, self.block, self.z, self.rest, self.ready = source, block, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.ready:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.source.read(self.block)
            self.rest = b""
            if not data:
                return 0
            self.ready = self.z.decompress(data, self.block)
            if not self.z.eof:
                self.rest = self.z.unconsumed_tail
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of an open archive."""
    stream = io.BufferedReader(_Members(source), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            head[k.lower()] = v
        yield head, stream.read(int(head["content-length"]))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(out_dir: str, payloads: bool, rows_at_once: int = 256):
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * payloads

    def parsed(head: dict[str, str], block: bytes) -> tuple:
        digest, n, payload = head["warc-payload-digest"].partition(":")[2], int(head["x-payload-length"]), None
        if head["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
                raise ValueError(f"damaged record {head['warc-record-id']}")
        first = head.get("x-refers-to-page-id")
        return (int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"], n, digest, head["warc-type"], int(first) if first else None) + (payload,) * payloads

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = filesystem(out_dir)
        for b in batches:
            for name in b["name"]:
                rows: list[tuple] = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    for head, block in records(source):
                        rows.append(parsed(head, block))
                        if len(rows) == rows_at_once:
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    return run


def read_warc(spark: SparkSession, out_dir: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives that the manifest in out_dir names, with the payload (null for revisits) on demand.

    Digests and lengths of responses are checked against their payload; a damaged one fails the job.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{out_dir}/_manifest").select("name")
    return manifest.repartition(max(1, min(manifest.count(), MOST_SHARDS))).mapInPandas(_read(out_dir, payloads), READ + ", payload binary" * payloads)


#: What op7_warc gives, over a view "pages".
SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, cast(strlen(payload) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, d.payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type, case when first < page_id then first end as refers_to
from d left join f on f.payload_digest = d.payload_digest
"""
