"""Address columns: scopes, pages, image groups, allowed hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ids import SCOPE_ID, opaque_id

#: Query parameters that say how a list is shown, not what it lists; callers pass those of their source.
TRANSIENT = ("page", "sort", "view")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def scope_key(url: Column, transient: tuple[str, ...] = TRANSIENT) -> Column:
    """Host and path in one form, with the lasting parameters sorted."""
    path = F.regexp_replace(path_of(url), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).when(path == "", "/").otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    kept = F.array_sort(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*transient)))
    query = F.array_join(kept, "&")
    return F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def scope_kind(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/{2,}", "/"), "/+$", "")
    return F.when(path.rlike(r"(?i)/categories/\d+$"), "category").when(path.rlike(r"(?i)/albums$"), "catalog").otherwise("source")


def scope_identity(url: Column, provider: str, transient: tuple[str, ...] = TRANSIENT) -> Column:
    return F.struct(opaque_id("s", scope_key(url, transient), provider, SCOPE_ID).alias("id"), scope_kind(url).alias("kind"))


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from base; null for a blank one."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", None)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(F.when(folder.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://$"), F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def page_url(base: Column, page: Column, tab: str = "gallery") -> Column:
    """The address of a page of a list; the first page has no number."""
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    kept = F.filter(F.split(query_of(base), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != "page"))
    has_tab = F.exists(kept, lambda p: F.substring_index(p, "=", 1) == "tab")
    paged = F.concat(kept, F.when(has_tab, F.array().cast("array<string>")).otherwise(F.array(F.lit(f"tab={tab}"))), F.array(F.concat(F.lit("page="), page.cast("string"))))
    query = F.array_join(F.when(page <= 1, kept).otherwise(paged), "&")
    return F.concat(bare, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def image_group_key(url: Column) -> Column:
    """Host and path without the file name: the variants of one image share it; null for shallow paths."""
    key = F.concat(host_of(url), F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/[^/]*$", ""))
    return F.when(F.size(F.split(key, "/")) >= 3, key)


#: The score of a file name's kind for each purpose, over which an attribute's priority is added.
IMAGE_SCORES = {
    "full": {"original": 1200, "big": 1000, "medium": 800, "small": 500, "other": 300},
    "display": {"big": 1200, "medium": 1100, "original": 1000, "small": 700, "other": 400},
    "thumb": {"small": 1200, "medium": 1100, "square": 1000, "tiny": 950, "big": 700, "original": 500, "other": 400},
}
#: Where a picture's address is looked for, and what each place is worth.
ATTRIBUTE_PRIORITY = {"data-origin-src": 100, "data-original": 90, "data-src": 70, "data-lazy": 60, "src": 20}


def image_kind(url: Column) -> Column:
    name = F.lower(F.regexp_extract(path_of(url), r"([^/]*)$", 1))
    kind = F.regexp_extract(name, r"^(small|medium|big|square|thumb|thumbnail|tiny)\.[a-z0-9]+$", 1)
    return F.when(kind == "", "original").when(kind.isin("thumb", "thumbnail", "tiny"), "tiny").otherwise(kind)


def image_score(url: Column, priority: Column, mode: str) -> Column:
    scores, kind = IMAGE_SCORES[mode], image_kind(url)
    ladder = F.lit(scores["other"])
    for name, value in scores.items():
        if name != "other":
            ladder = F.when(kind == name, value).otherwise(ladder)
    return priority + ladder


def allowed_host(url: Column, rules: tuple[str, ...]) -> Column:
    """https, and a host that is in rules or below one of them that starts with '*.'."""
    host = host_of(url)
    fits = F.lit(False)
    for r in rules:
        fits = fits | (host.endswith(r[1:]) if r.startswith("*.") else host == r)
    return F.coalesce(F.lower(url).startswith("https://") & fits, F.lit(False))
