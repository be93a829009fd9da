"""Identifiers, fingerprints, and columns made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import clean_ws

#: Namespaces that identifiers are hashed in; callers that share ids with another store pass theirs.
PUBLIC_ID = "tidemark:public-id:v1"
SCOPE_ID = "tidemark:scope-id:v1"


def digest20(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 20)


def opaque_id(prefix: str, source_id: Column, provider: Column | str, namespace: str = PUBLIC_ID) -> Column:
    """prefix, underscore and 20 hex digits; equal source ids share digits whatever their prefix."""
    provider = F.lit(provider) if isinstance(provider, str) else provider
    return F.concat(F.lit(f"{prefix}_"), digest20(F.concat_ws("|", F.lit(namespace), F.lower(clean_ws(provider)), clean_ws(source_id))))


def stable_id(prefix: str, seed: Column) -> Column:
    return digest20(F.concat(F.lit(f"{prefix}:"), seed))


def is_opaque(col: Column, prefix: str) -> Column:
    return F.coalesce(col.rlike(f"^{prefix}_[a-f0-9]{{20}}$"), F.lit(False))


def _json_digest(namespace: str, payload: Column) -> Column:
    text = F.to_json(payload, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"{namespace}|"), text) if namespace else text, 256)


def _clean(col: Column) -> Column:
    return clean_ws(F.coalesce(col, F.lit("")))


def listing_fingerprint(title: Column, cover: Column, signal: Column, image_count: Column, version: str = "listing:v1") -> Column:
    """Of what a listing shows; the category is left out, so that a move isn't a change. A null count stays null."""
    return _json_digest("", F.struct(F.lit(version).alias("v"), _clean(title).alias("title"), _clean(cover).alias("cover"), _clean(signal).alias("signal"), image_count.alias("imageCountHint")))


def content_fingerprint(name: Column, category: Column, description: Column, images: Column, namespace: str = "tidemark:content:v1") -> Column:
    kept = F.filter(F.transform(F.coalesce(images, F.array().cast("array<string>")), _clean), lambda x: x != "")
    return _json_digest(namespace, F.struct(_clean(name).alias("name"), _clean(category).alias("category"), _clean(description).alias("description"), kept.alias("sourceImages")))


def detail_fingerprint(name: Column, description: Column, images: Column, namespace: str = "tidemark:detail:v1") -> Column:
    return _json_digest(namespace, F.struct(_clean(name).alias("name"), _clean(description).alias("description"), images.alias("images")))


def media_descriptor(media_id: Column, root: str = "/media") -> Column:
    at = lambda variant: F.concat(F.lit(f"{root}/"), media_id, F.lit(f"/{variant}"))
    return F.struct(at("full").alias("url"), at("thumb").alias("thumb"), F.concat(at("full"), F.lit("?download=1")).alias("download"))


def source_for_variant(thumb: Column, display: Column, source: Column, variant: str) -> Column:
    """The address to serve a variant from: the next larger one stands in for one that is missing."""
    ladder = {"thumb": (thumb, display, source), "display": (display, source), "full": (source,)}[variant]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ladder])
