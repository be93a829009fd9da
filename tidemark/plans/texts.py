"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids, scoring, text, urls
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Tables

FOLD = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[’''`´]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
CLEAN = r"trim(regexp_replace({0}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query(f"select doc_id, sha256({FOLD.format('text')}) as folded, sha256(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) as normal from documents")
def fold_text(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.sha2(text.fold(c), 256).alias("folded"), F.sha2(text.search_norm(c), 256).alias("normal"))


@query(f"select k, {CLEAN.format('title')} as cleaned, substr({CLEAN.format('title')}, 1, 240) as title from titles", ("titles",))
def clean_titles(t: Tables) -> DataFrame:
    return t.titles.select("k", text.clean_ws(F.col("title")).alias("cleaned"), text.clean_title(F.concat("title", F.lit(" | album | shop x")), trailers=(r" \| album .*$",)).alias("title"))


@query(r"""with c as (select doc_id, trim(regexp_replace(raw, '[\s\x{00A0}]+', ' ', 'g')) as a from texts),
    b as (select doc_id, regexp_replace(a, '[a-z][a-z0-9+.-]*://[^ ]*', '', 'gi') as a from c),
    e as (select doc_id, trim(regexp_replace(a, '\b(?:whatsapp|signal|mail)\b *[:=]? *[^ ]+', '', 'gi')) as a from b)
    select doc_id, sha256(case when contains(lower(a), 'license') then '' else substr(a, 1, 600) end) as description from e""", ("texts",))
def safe_descriptions(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", F.sha2(text.safe_description(F.col("raw"), ("license",)), 256).alias("description"))


@query(r"""select k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\bhot\b', 'Heated', 'gi'), '\blarge\b', 'XL', 'gi'), '\bsmall\b', 'Mini', 'gi'), '\bring\b', 'Ring Set', 'gi')) as name from titles""", ("titles",))
def display_names(t: Tables) -> DataFrame:
    return t.titles.select("k", text.display_name(F.col("title")).alias("name"))


@query(f"""select k, case when k % 3 = 0 then split_part(p_name, ' ', 2) when k % 7 = 0 then p_type when k % 5 = 0 then 'Others' when k % 2 = 0 then split_part(p_name, ' ', 1) else p_brand end as shown,
    array_to_string(list_distinct_ordered, ' ') as search_text from (select *, list_filter(list_transform([title, p_type, p_brand, p_name], lambda x : {FOLD.format('x')}), lambda x, i : x <> '' and list_position(list_transform([title, p_type, p_brand, p_name], lambda y : {FOLD.format('y')}), x) = i) as list_distinct_ordered from titles)""", ("titles",))
def shown_categories(t: Tables) -> DataFrame:
    k = F.col("k")
    noun, adj = F.split("p_name", " ")[1], F.split("p_name", " ")[0]
    shown = text.display_category(F.when(k % 3 == 0, noun), F.when(k % 7 == 0, F.col("p_type")), F.when(k % 5 == 0, "Uncategorised").otherwise(F.col("p_brand")), F.when(k % 2 == 0, adj))
    return t.titles.select("k", shown.alias("shown"), text.search_text(F.array("title", "p_type", "p_brand", "p_name")).alias("search_text"))


@query("select product_id, 'c_' || substr(product_id, 3) as category_id, substr(sha256('imp:' || k), 1, 20) as stable, sha256('{\"v\":\"listing:v1\",\"title\":\"' || source_name || '\",\"cover\":\"\",\"signal\":\"s' || k || '\",\"imageCountHint\":' || case when k % 4 = 0 then 'null' else cast(k % 10 as varchar) end || '}') as listing from products", ("products",))
def opaque_ids(t: Tables) -> DataFrame:
    k = F.col("k").cast("string")
    oid = lambda p: ids.opaque_id(p, k, "part", "fixture:id:v1")
    hint = F.when(F.col("k") % 4 != 0, F.col("k") % 10).cast("int")
    listing = ids.listing_fingerprint(F.col("source_name"), F.lit(None).cast("string"), F.concat(F.lit("s"), k), hint)
    return t.products.select(oid("p").alias("product_id"), oid("c").alias("category_id"), ids.stable_id("imp", k).alias("stable"), listing.alias("listing"))


@query("""select k, sha256('tidemark:content:v1|{"name":"' || title || '","category":"' || p_type || '","description":"","sourceImages":["a' || k || '","b"]}') as content,
    sha256('tidemark:detail:v1|{"name":"' || title || '","description":"' || p_brand || '","images":["a' || k || '"]}') as detail,
    '/media/m' || k || '/thumb' as thumb, case when k % 3 = 0 then 'display' || k else 'source' || k end as served from titles""", ("titles",))
def content_fingerprints(t: Tables) -> DataFrame:
    k = F.col("k").cast("string")
    images = F.array(F.concat(F.lit(" a"), k), F.lit(" "), F.lit("b"), F.lit(None))
    content = ids.content_fingerprint(F.col("title"), F.col("p_type"), F.lit(None).cast("string"), images)
    detail = ids.detail_fingerprint(F.col("title"), F.col("p_brand"), F.array(F.concat(F.lit("a"), k)))
    served = ids.source_for_variant(F.lit(""), F.when(F.col("k") % 3 == 0, F.concat(F.lit("display"), k)), F.concat(F.lit("source"), k), "thumb")
    return t.titles.select("k", content.alias("content"), detail.alias("detail"), ids.media_descriptor(F.concat(F.lit("m"), k))["thumb"].alias("thumb"), served.alias("served"))


@query(r"""with u as (select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as q from pages),
    n as (select *, regexp_replace(path, '/+', '/', 'g') as p, list_sort(list_filter(string_split(q, '&'), lambda x : x <> '' and split_part(x, '=', 1) not in ('page', 'sort', 'view'))) as kept from u),
    m as (select *, host || case when length(p) > 1 then coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') when p = '' then '/' else p end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as key from n)
    select page_id, key, 's_' || substr(sha256('tidemark:scope-id:v1|web|' || key), 1, 20) as scope_id, case when regexp_matches(regexp_replace(p, '/+$', ''), '(?i)/categories/\d+$') then 'category' when regexp_matches(regexp_replace(p, '/+$', ''), '(?i)/albums$') then 'catalog' else 'source' end as kind from m""")
def scope_identity(t: Tables) -> DataFrame:
    u = F.col("url")
    scope = urls.scope_identity(u, "web")
    return t.pages.select("page_id", urls.scope_key(u).alias("key"), scope["id"].alias("scope_id"), scope["kind"].alias("kind"))


@query(r"""with u as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as bare, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x : x <> '' and split_part(x, '=', 1) <> 'page') as kept from pages)
    select page_id, bare || '?' || array_to_string(kept || ['tab=gallery', 'page=3'], '&') as third, bare || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as first,
    regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/x' as rooted, starts_with(lower(url), 'https://') and (ends_with(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '.example.net')) as allowed from u""")
def page_addresses(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", urls.page_url(u, F.lit(3)).alias("third"), urls.page_url(u, F.lit(1)).alias("first"), urls.absolute_url(u, F.lit("/x")).alias("rooted"), urls.allowed_host(u, ("*.example.net",)).alias("allowed"))


@query("""with c as (select k, case when k % 12 = 0 then ['2025/26', '2024/25'] when k % 4 = 0 then ['2024/25'] else [] end as labels from titles)
    select k, array_to_string(labels, ',') as seasons from c""", ("titles",))
def season_labels(t: Tables) -> DataFrame:
    return t.titles.select("k", F.array_join(scoring.season_candidates(F.col("title")), ",").alias("seasons"))


@query("""select k, case when k % 10 = 0 then 'CONFLICT' when k % 11 = 0 then 'STALE' when k % 13 = 0 then 'UNKNOWN' when s >= 0.95 then 'VERIFIED' when s >= 0.85 then 'KNOWN' when s >= 0.65 then 'UNCERTAIN' else 'UNKNOWN' end as state,
    case k % 5 when 0 then case when k % 2 = 0 then 0.35 else 0.35 end when 1 then case when k % 2 = 0 then 0.63 else 0.51 end when 2 then case when k % 2 = 0 then 0.79 else 0.67 end when 3 then case when k % 2 = 0 then 0.95 else 0.83 end else 0.99 end as confidence from (select k, (k % 100) / 100.0 as s from titles)""", ("titles",))
def knowledge_states(t: Tables) -> DataFrame:
    k = F.col("k")
    state = scoring.knowledge_state((k % 100) / 100, k % 10 == 0, k % 11 == 0, F.when(k % 13 == 0, "unknown"))
    return t.titles.select("k", state.alias("state"), scoring.base_confidence(k % 5, k % 2 == 0).alias("confidence"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as integer) as k, cast(case when event_id % 2 = 0 then json_extract_string(props, '$.k') end as integer) as text_k,
    ts + interval 10 minute as later, cast(greatest(least(value, 50.0), 5.0) as double) as clamped, regexp_matches(event_type, '^[a-z0-9][a-z0-9_]{0,63}$') as safe from events""")
def json_fields(t: Tables) -> DataFrame:
    as_text = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).otherwise("{bad")
    return t.events.select("event_id", scoring.json_int(F.col("props"), "$.k").alias("k"), scoring.json_int(as_text, "$.k").alias("text_k"), scoring.minutes_after(F.col("ts"), 10).alias("later"), text.clamp(F.col("value"), 5.0, 50.0).alias("clamped"), text.safe_code(F.col("event_type")).alias("safe"))


@query("""select k, cast(case when k % 3 = 0 then k % 1000 when k % 3 = 1 then k % 100 else null end as integer) as hint from titles""", ("titles",))
def image_hints(t: Tables) -> DataFrame:
    k = F.col("k")
    words = F.when(k % 3 == 0, F.concat(F.lit("photos: "), (k % 1000).cast("string"))).when(k % 3 == 1, F.concat((k % 100).cast("string"), F.lit(" images"))).otherwise(F.col("title"))
    return t.titles.select("k", text.image_count_hint(words, F.lit(None).cast("string")).alias("hint"))
