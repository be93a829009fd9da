"""Classification of records against user-supplied dictionaries: matches, candidates, conflicts, confidence, overrides, state."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import base_confidence, is_json, knowledge_state, season_candidates
from tidemark.functions.text import clean_ws, fold
from tidemark.operators.counts import aggregate_matches, dim_counts
from tidemark.operators.ranking import dedupe_seasons, first_per_key
from tidemark.operators.tables import is_navigation_category, meta_rows, prune_zero, resolve_path
from tidemark.sources.shared import small, spread, stored


@dataclass(frozen=True)
class Pack:
    """A knowledge pack: dictionaries as small tables.

    aliases: kind (league, team, facet), id, alias, ordinal, alias_ordinal; teams: id, league_id, national; facets: id,
    facet_type, sort_order. Aliases of facets in implies bring in base_facet. navigation: id, name, kind, sort_order.
    """

    aliases: DataFrame
    teams: DataFrame
    facets: DataFrame
    priority: tuple[tuple[str, str], ...] = ()
    generic: tuple[str, ...] = ()
    implies: tuple[str, ...] = ()
    base_facet: str | None = None
    national_league: str | None = None
    keywords: tuple[str, ...] = ()
    not_navigation: tuple[str, ...] = ()
    thresholds: dict[str, float] = field(default_factory=lambda: {"needsReview": 0.51})
    key: str = "pack"
    domain: str = "domain"
    version: int = 1
    navigation: DataFrame | None = None


#: Dictionaries of up to so many phrases are broadcast; larger ones are joined by a shuffle.
BROADCAST = 100_000


def phrases(pack: Pack, kind: str | None = None) -> tuple[DataFrame, int]:
    """The folded aliases of a pack, and the number of words of the longest."""
    rows = pack.aliases if kind is None else pack.aliases.where(F.col("kind") == kind)
    rows = rows.withColumn("token", fold(F.col("alias"))).where("token <> ''")
    n, longest = rows.agg(F.count("*"), F.max(F.size(F.split("token", " ")))).first()
    return (F.broadcast(rows) if n <= BROADCAST else rows), longest or 1


def match_aliases(texts: DataFrame, pack: Pack, kind: str | None = None, min_len: int = 0) -> DataFrame:
    """texts' columns with kind, id, token, ordinal, whole: each alias that a text contains as whole words.

    A folded text has its words one space apart, so containment is equality with a run of words. Dictionaries of short
    aliases are met by an equi-join on all runs of up to their words; longer ones by their rarest pair of words (rare_gram_matches). No
    text is compared with each alias.
    """
    dim, longest = phrases(pack, kind)
    rows = texts.withColumn("_folded", fold(F.coalesce("text", F.lit("")))).where("_folded <> ''")
    if longest > SHORT:
        found = rare_gram_matches(rows, dim)
    else:
        w = F.split("_folded", " ")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w))), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
        found = rows.withColumn("token", F.explode(F.array_distinct(runs))).join(dim, "token")
    return found.where(F.length("token") >= min_len).withColumn("whole", F.col("token") == F.col("_folded")).drop("_folded")


#: Aliases of up to so many words are found among all runs of words; that makes at most so many rows a word.
SHORT = 3


def grams(folded: Column) -> Column:
    """The distinct words and pairs of neighbouring words of a folded text."""
    w = F.split(folded, " ")
    return F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))


def rare_gram_candidates(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """rows (with _folded) with the aliases of dim (token, ...) whose rarest gram they hold.

    An alias is looked for by one gram: its word, or of several words the pair that the fewest texts hold, counted in one pass
    over the texts. Aliases with a pair that no text holds are out at once. So the rows follow the hits, not the number of
    aliases or their words.
    """
    several = F.col("token").contains(" ")
    own = dim.select("token").distinct().withColumn("gram", F.explode(F.filter(grams(F.col("token")), lambda g: ~several | g.contains(" "))))
    wanted = small(stored(own, "grams"))
    held = rows.select(F.explode(grams(F.col("_folded"))).alias("gram")).join(small(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    ranked = wanted.join(held, "gram", "left").groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unseen"))
    anchors = dim.join(small(stored(ranked.where("unseen = 0").select("token", "gram"), "anchors")), "token")
    return rows.withColumn("gram", F.explode(grams(F.col("_folded")))).join(small(anchors), "gram").drop("gram")


def rare_gram_matches(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """rare_gram_candidates, verified."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return rare_gram_candidates(rows, dim).where(padded(F.col("_folded")).contains(padded(F.col("token"))))


def record_fields(records: DataFrame) -> DataFrame:
    """record, field, source, pos, text of records (record, name, category, path): one row a field. Path elements are
    path[0], path[1], ...; context is the category and its path together, whole that and the name."""
    context = F.concat_ws(" ", "category", F.array_join("path", " "))
    row = lambda field, source, pos, text: F.struct(field.alias("field"), F.lit(source).alias("source"), pos.cast("int").alias("pos"), text.alias("text"))
    fixed = [row(F.lit(f), f, F.lit(0), c) for f, c in (("title", F.col("name")), ("category", F.col("category")), ("context", context), ("whole", F.concat_ws(" ", "name", context)))]
    path = F.transform("path", lambda p, i: row(F.concat(F.lit("path["), i.cast("string"), F.lit("]")), "path", i + 1, p))
    return records.select("record", F.explode(F.concat(F.array(*fixed), F.coalesce(path, F.array().cast("array<struct<field:string,source:string,pos:int,text:string>>")))).alias("f")).select("record", "f.*")


def alias_hits(records: DataFrame, pack: Pack) -> DataFrame:
    """record, field, source, pos, kind, id, token, ordinal, whole of all aliases in all fields of records, found in one pass
    and stored: what the detections and candidates below are drawn from."""
    found = match_aliases(record_fields(spread(records)), pack)
    return stored(found.select("record", "field", "source", "pos", "kind", "id", "token", "ordinal", "whole"), "alias-hits")


def detect_league(records: DataFrame, pack: Pack, hits: DataFrame | None = None) -> DataFrame:
    """record, league_id of records (record, name, category, path): by the category and its path, else by the name.

    Within a text: priority phrases, then dictionary order without generic aliases and leagues of priority phrases, then the generic ones.
    """
    hits = alias_hits(records, pack) if hits is None else hits
    turn = F.when(F.col("field") == "context", 0).otherwise(1)
    special = [league for _, league in pack.priority]
    generic = F.col("token").isin(*pack.generic) if pack.generic else F.lit(False)
    rank = F.when(generic, 2).otherwise(1)
    found = hits.where((F.col("kind") == "league") & F.col("field").isin("context", "title")).where(~F.col("id").isin(*special) if special else F.lit(True))
    found = found.select("record", turn.alias("turn"), rank.alias("rank"), "ordinal", F.col("id").alias("league_id"))
    texts = record_fields(records).where(F.col("field").isin("context", "title")).select("record", turn.alias("turn"), "text")
    for i, (phrase, league) in enumerate(pack.priority):
        hit = texts.where(fold(F.coalesce("text", F.lit(""))).contains(phrase))
        found = found.unionByName(hit.select("record", "turn", F.lit(0).alias("rank"), F.lit(i).cast("long").alias("ordinal"), F.lit(league).alias("league_id")))
    best = found.groupBy("record").agg(F.min(F.struct("turn", "rank", "ordinal", "league_id"))["league_id"].alias("league_id"))
    return best


def detect_team(records: DataFrame, leagues: DataFrame, pack: Pack, hits: DataFrame | None = None) -> DataFrame:
    """record, team_id: an alias that equals a category field, the last path element first; else the longest alias of three
    letters or more in the whole text. Both within the record's league, if it has one; national teams always may be."""
    hits = (alias_hits(records, pack) if hits is None else hits).where("kind = 'team'")
    known = leagues.select("record", F.col("league_id").alias("_league"))
    teams = small(pack.teams.select("id", F.col("league_id").alias("_team_league"), "national"))
    in_field = F.col("source").isin("category", "path") & F.col("whole")
    in_text = (F.col("source") == "whole") & (F.length("token") >= 3)
    found = hits.where(in_field | in_text).select("record", "id", F.when(in_field, -F.col("pos")).otherwise(-F.length("token")).alias("a"), F.col("ordinal").alias("b"), F.when(in_field, 0).otherwise(1).alias("turn"))
    both = found.join(teams, "id").join(known, "record", "left")
    fits = F.col("_league").isNull() | (F.col("_team_league") == F.col("_league")) | F.col("national")
    return both.where(fits).groupBy("record").agg(F.min(F.struct("turn", "a", "b", "id"))["id"].alias("team_id"))


def backfill_league(records: DataFrame, pack: Pack) -> DataFrame:
    """records (record, league_id, team_id) with the league that the team implies where there is none."""
    teams = small(pack.teams.select(F.col("id").alias("team_id"), F.col("league_id").alias("_of"), "national"))
    default = F.when(F.col("national"), F.lit(pack.national_league)) if pack.national_league else F.lit(None).cast("string")
    return records.join(teams, "team_id", "left").withColumn("league_id", F.coalesce("league_id", "_of", default)).drop("_of", "national")


def detect_facets(records: DataFrame, pack: Pack, hits: DataFrame | None = None) -> DataFrame:
    """record, facets (ids by sort order): all whose alias is contained, and the base facet that some of them imply."""
    hits = alias_hits(records, pack) if hits is None else hits
    found = hits.where("kind = 'facet' and field = 'whole'").select("record", "id").distinct()
    if pack.base_facet:
        found = found.unionByName(found.where(F.col("id").isin(*pack.implies)).select("record", F.lit(pack.base_facet).alias("id"))).distinct()
    ordered = found.join(small(pack.facets.select("id", "sort_order")), "id")
    return ordered.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id"))), lambda f: f["id"]).alias("facets"))


def base_status(df: DataFrame, not_navigation: tuple[str, ...] = ()) -> DataFrame:
    """df (team_id, league_id, facets, category) with signals, status and confidence."""
    navigable = is_navigation_category(F.col("category"), not_navigation)
    signals = F.col("team_id").isNotNull().cast("int") + F.col("league_id").isNotNull().cast("int") + (F.coalesce(F.size("facets"), F.lit(0)) > 0).cast("int") + navigable.cast("int")
    out = df.withColumn("signals", signals)
    return out.withColumn("status", F.when(F.col("signals") >= 2, "automatic").when(F.col("signals") == 1, "needs_review").otherwise("unknown")).withColumn("confidence", base_confidence(F.col("signals"), F.col("team_id").isNotNull()))


def classify_item(df: DataFrame, information: str, product: str, generic: str, taxonomy: str) -> DataFrame:
    """df (name, description, images) with kind, kind_confidence and kind_reason; the arguments are patterns."""
    text = clean_ws(F.concat_ws(" ", "name", "description"))
    info, signal, word, nav = (text.rlike(f"(?iu){p}") for p in (information, product, generic, taxonomy))
    images = F.coalesce("images", F.lit(0))
    navigation = (nav & (images <= 2)) | (~signal & (images <= 1) & word)
    kind = F.when(info, "information").when(navigation, "navigation").otherwise("product")
    sure = F.when(info, "high").when(navigation, "medium").when(signal | (images > 1), "high").otherwise("medium")
    reason = F.when(info, "information_text").when(navigation, "navigation_text").when(signal, "product_signal").otherwise("default_product")
    return df.withColumns({"kind": kind, "kind_confidence": sure, "kind_reason": reason})


# -- evidence -------------------------------------------------------------------------------------------------------

#: What a field's match is worth, and what equality with the whole field adds.
WEIGHTS = {"title": 0.96, "category": 0.94, "path": 0.92}
WHOLE, MOST = 0.03, 0.99
SEASON_WEIGHTS = {"attribute": 0.99, "title": 0.96, "category": 0.91, "path": 0.88}


def build_evidence(products: DataFrame, most_path: int = 32, most_text: int = 500) -> DataFrame:
    """record, name, category, path, description, code: clean fields within their sizes; code names what is wrong with a row."""
    name, category = clean_ws(F.coalesce("name", F.lit(""))), clean_ws(F.coalesce("category", F.lit("")))
    path = F.filter(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda p: clean_ws(p)), lambda p: F.coalesce(p, F.lit("")) != "")
    code = F.when(F.col("record").isNull(), "evidence_record_missing").when(name == "", "evidence_title_missing").when(F.size(path) > most_path, "evidence_path_too_long")
    return spread(products).select("record", F.substring(name, 1, most_text).alias("name"), F.substring(category, 1, most_text).alias("category"), F.slice(path, 1, most_path).alias("path"), code.alias("code"))


#: The fields that evidence is drawn from.
SOURCES = ("title", "category", "path")


def suppress_shorter(matches: DataFrame, keys: tuple[str, ...] = ("record", "field", "kind")) -> DataFrame:
    """Matches without those whose token is part of a longer token of another id, found in the same field.

    The tokens of a field are gathered first: as many as its own matches, at most.
    """
    of = matches.groupBy(*keys).agg(F.collect_set(F.struct("id", "token")).alias("_all"))
    longer = F.exists("_all", lambda o: (o["id"] != F.col("id")) & (F.length(o["token"]) > F.length("token")) & o["token"].contains(F.col("token")))
    return matches.join(of, list(keys)).where(~longer).drop("_all")


def evidence_candidates(evidence: DataFrame, pack: Pack, hits: DataFrame | None = None) -> DataFrame:
    """record, kind, id, score, sources of all aliases in the evidence; generic league aliases count only as whole fields."""
    hits = alias_hits(evidence, pack) if hits is None else hits
    found = hits.where(F.col("source").isin(*SOURCES)).where((F.col("kind") != "team") | (F.length("token") >= 3))
    if pack.generic:
        found = found.where((F.col("kind") != "league") | ~F.col("token").isin(*pack.generic) | F.col("whole"))
    weight = F.lit(0.0)
    for source, w in WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    score = F.round(F.least(F.lit(MOST), weight + F.when(F.col("whole"), WHOLE).otherwise(0.0)), 4)
    return aggregate_matches(suppress_shorter(found).withColumn("score", score), ["record", "kind", "id"])


def pick_season(evidence: DataFrame) -> DataFrame:
    """record, label, confidence, rank of all seasons in the evidence; evidence may have a column season (attribute)."""
    fields = record_fields(spread(evidence)).where(F.col("source").isin(*SOURCES)).select("record", "field", "source", "text")
    if "season" in evidence.columns:
        fields = fields.unionByName(evidence.select("record", F.lit("season").alias("field"), F.lit("attribute").alias("source"), F.col("season").alias("text")))
    weight = F.lit(0.0)
    for source, w in SEASON_WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    found = fields.select("record", weight.alias("confidence"), F.explode(season_candidates(F.coalesce("text", F.lit("")))).alias("label"))
    return dedupe_seasons(found, "record")


def find_conflicts(candidates: DataFrame, seasons: DataFrame, pack: Pack) -> DataFrame:
    """record, field, ids (sorted): fields with several strong candidates."""
    team_leagues = small(pack.teams.select("id", F.col("league_id").alias("of")))
    strong = candidates.where("score >= 0.9")
    teams = strong.where("kind = 'team'")
    leagues = strong.where("kind = 'league'").select("record", "id").unionByName(teams.join(team_leagues, "id").where("of is not null").select("record", F.col("of").alias("id")))
    versions = candidates.where("kind = 'facet'").join(small(pack.facets.where("facet_type = 'version'").select("id")), "id")
    parts = (("team", teams.select("record", "id")), ("league", leagues), ("season", seasons.where("confidence >= 0.88").select("record", F.col("label").alias("id"))), ("version", versions.select("record", "id")))
    out = None
    for name, df in parts:
        some = df.groupBy("record").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1).select("record", F.lit(name).alias("field"), "ids")
        out = some if out is None else out.unionByName(some)
    return out


def domain_confidence(candidates: DataFrame, records: DataFrame, pack: Pack) -> DataFrame:
    """record, confidence, domain of each record (record, text): by the best candidates, a keyword, or neither."""
    best = lambda k: F.max(F.when(F.col("kind") == k, F.col("score")))
    tops = candidates.groupBy("record").agg(best("team").alias("team"), best("league").alias("league"), best("facet").alias("facet"))
    folded = F.concat(F.lit(" "), fold(F.coalesce("text", F.lit(""))), F.lit(" "))
    keyword = F.lit(False)
    for k in pack.keywords:
        keyword = keyword | folded.contains(f" {k} ")
    score = F.when(F.col("team").isNotNull(), F.greatest(F.lit(0.96), "team")).when(F.col("league").isNotNull(), F.greatest(F.lit(0.94), "league")).when(F.col("facet").isNotNull(), 0.86).when(keyword, 0.78).otherwise(0.25)
    out = records.join(tops, "record", "left").select("record", score.alias("confidence"))
    return out.withColumn("domain", F.when(F.col("confidence") >= pack.thresholds["needsReview"], "known").otherwise("unknown"))


def field_confidence(df: DataFrame) -> DataFrame:
    """df (team_score, league_score, facet_count, season_score, conflicts: array of fields) with a confidence for each field."""
    has = lambda f: F.array_contains("conflicts", f)
    team = F.when(F.col("team_score").isNull(), 0.0).when(has("team"), 0.45).otherwise(F.greatest(F.lit(0.84), "team_score"))
    league = F.when(F.col("league_score").isNull() & F.col("team_score").isNull(), 0.0).when(has("league"), 0.45).otherwise(F.greatest(F.when(F.col("team_score").isNotNull(), 0.91).otherwise(0.84), F.coalesce("league_score", F.lit(0.0))))
    season = F.when(has("season"), 0.0).otherwise(F.coalesce("season_score", F.lit(0.0)))
    return df.withColumns({"team_confidence": team, "league_confidence": league, "facet_confidence": F.when(F.col("facet_count") > 0, 0.9).otherwise(0.0), "season_confidence": season})


def review_status(df: DataFrame) -> DataFrame:
    """A record with a conflict needs review, at half confidence at most; base_status and base_confidence are those before."""
    conflict = F.size("conflicts") > 0
    out = df.withColumns({"base_status": F.col("status"), "base_confidence": F.col("confidence")})
    return out.withColumn("status", F.when(conflict, "needs_review").otherwise(F.col("status"))).withColumn("confidence", F.when(conflict, F.least(F.lit(0.5), "confidence")).otherwise(F.col("confidence")))


PackClassifier = Callable[[DataFrame, Pack], DataFrame]


def route_domains(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """The best result (record, confidence, domain) of 1 to 16 packs: by confidence, known domains first, then by key."""
    keys = [k for k, _ in results]
    if not 1 <= len(keys) <= 16 or len(set(keys)) != len(keys):
        raise ValueError("1 to 16 packs with different keys")
    out = None
    for key, df in results:
        rows = df.select("record", "confidence", "domain", F.lit(key).alias("pack"))
        out = rows if out is None else out.unionByName(rows)
    return first_per_key(out, ["record"], [F.desc("confidence"), F.col("domain") == "unknown", "pack"])


#: The fields of an override, the sizes of its labels, the number of its facets, and its statuses.
OVERRIDE_KEYS = ("displayName", "displayCategoryName", "teamId", "leagueId", "facetIds", "classificationStatus", "classificationConfidence")
LABEL_SIZES = {"displayName": 240, "displayCategoryName": 160}
MOST_FACETS, ID_SIZE = 24, 80
STATUSES = ("automatic", "needs_review", "unknown")
URL = r"(?i)https?://"


def build_claims(df: DataFrame, fields: list[str]) -> DataFrame:
    """record, claims: a map of each field to its value, confidence, sources of evidence, and source.

    A field has <field>_id (or a column of its plural: its values as a JSON array), <field>_confidence and maybe
    <field>_sources. What is in override_fields comes from the merchant, has confidence 1 and no evidence.
    """
    return df.select("record", _claims(df.columns, fields, "", True).alias("claims"))


def _claims(columns: list[str], fields: list[str], prefix: str, effective: bool, states: dict[str, Column] | None = None) -> Column:
    """A map of claims from columns with a prefix, or without one where there is no such column."""
    named = lambda c: F.col(prefix + c) if prefix + c in columns else F.col(c) if c in columns else None
    nothing = F.array().cast("array<string>")
    entries: list[Column] = []
    for f in fields:
        one, several = named(f"{f}_id"), named(f"{f}s")
        value = one.cast("string") if one is not None else F.to_json(several) if several is not None else F.lit(None).cast("string")
        by = F.array_contains(F.col("override_fields"), f) if effective and "override_fields" in columns else F.lit(False)
        sources = named(f"{f}_sources")
        parts = [
            value.alias("value"), F.when(by, 1.0).otherwise(F.coalesce(named(f"{f}_confidence"), F.lit(0.0)).cast("double")).alias("confidence"),
            *([states[f].alias("state")] if states else []), F.when(by, nothing).otherwise(F.coalesce(F.array_distinct(sources), nothing) if sources is not None else nothing).alias("sources"),
            F.when(by, "merchant_override").otherwise("inference").alias("source"),
        ]
        entries += [F.lit(f), F.struct(*parts)]
    return F.create_map(*entries)


def parse_overrides(overrides: DataFrame, pack: Pack, unwanted: str = URL) -> DataFrame:
    """record, given (the keys present), the values, and override_error of merchants' overrides (record, json).

    Errors, the first of them: bad_json, unknown_key, bad_team, bad_league, bad_facets (no array of up to 24 ids),
    bad_label (blank, too long or not a text), unsafe_label (fits ``unwanted``), bad_status, bad_confidence, unknown_team, unknown_league, unknown_facet. A
    null team or league clears. Of several overrides of a record the smallest JSON counts.
    """
    text = lambda k: F.get_json_object("json", f"$.{k}")
    has = lambda k: F.array_contains("given", k)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), f"$.{k}", "variant"))
    rows = overrides.groupBy("record").agg(F.min("json").alias("json")).where("json is not null and trim(json) <> ''")
    parsed = F.try_parse_json("json")
    is_object = is_json(F.col("json")) & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("given", F.coalesce(F.when(is_object, F.json_object_keys("json")), F.array().cast("array<string>")))
    ids = F.transform(F.from_json(text("facetIds"), "array<string>"), lambda i: F.trim(i))
    values = {
        "_team": F.trim(text("teamId")), "_league": F.trim(text("leagueId")), "_facets": F.when(has("facetIds"), F.array_distinct(ids)), "_n_facets": F.size(ids), "_name": F.trim(text("displayName")),
        "_category": F.trim(text("displayCategoryName")), "_status": text("classificationStatus"), "_confidence": F.try_variant_get(parsed, "$.classificationConfidence", "double"),
    }
    rows = rows.withColumns(values)
    an_id = lambda k, c: F.coalesce((kind(k) == "VOID") | ((kind(k) == "STRING") & F.length(c).between(1, ID_SIZE)), F.lit(False))
    label = lambda k, c: F.coalesce((kind(k) == "STRING") & F.length(c).between(1, LABEL_SIZES[k]), F.lit(False))
    facets_ok = (kind("facetIds") == "ARRAY<STRING>") & (F.col("_n_facets") <= MOST_FACETS) & F.forall("_facets", lambda i: F.length(i).between(1, ID_SIZE)) | (F.col("_n_facets") == 0)
    wrong = lambda k, ok: has(k) & ~F.coalesce(ok, F.lit(False))
    error = (
        F.when(~is_object, "bad_json").when(F.size(F.array_except("given", F.array(*[F.lit(k) for k in OVERRIDE_KEYS]))) > 0, "unknown_key")
        .when(wrong("teamId", an_id("teamId", F.col("_team"))), "bad_team").when(wrong("leagueId", an_id("leagueId", F.col("_league"))), "bad_league").when(wrong("facetIds", facets_ok), "bad_facets")
        .when(wrong("displayName", label("displayName", F.col("_name"))) | wrong("displayCategoryName", label("displayCategoryName", F.col("_category"))), "bad_label")
        .when(F.coalesce(F.concat_ws(" ", "_name", "_category").rlike(unwanted), F.lit(False)), "unsafe_label")
        .when(wrong("classificationStatus", F.col("_status").isin(*STATUSES)), "bad_status").when(wrong("classificationConfidence", F.col("_confidence").between(0, 1)), "bad_confidence")
    )
    rows = rows.withColumn("_error", error)
    teams = small(pack.teams.groupBy(F.col("id").alias("_team")).agg(F.first("league_id").alias("_of"), F.lit(True).alias("_known")))
    leagues = small(pack.aliases.where("kind = 'league'").select("id").unionByName(pack.teams.select(F.col("league_id").alias("id"))).distinct().select(F.col("id").alias("_league"), F.lit(True).alias("_known_league")))
    known = small(pack.facets.select(F.col("id").alias("_facet")).distinct())
    strange = rows.select("record", F.explode("_facets").alias("_facet")).join(known, "_facet", "left_anti").select("record", F.lit(True).alias("_strange")).distinct()
    rows = rows.join(teams, "_team", "left").join(leagues, "_league", "left").join(strange, "record", "left")
    unknown = F.when(F.col("_team").isNotNull() & F.col("_known").isNull(), "unknown_team").when(F.col("_league").isNotNull() & F.col("_known_league").isNull(), "unknown_league").when(F.col("_strange"), "unknown_facet")
    return rows.select("record", "given", "_team", "_of", "_league", "_facets", "_name", "_category", "_status", "_confidence", F.coalesce("_error", unknown).alias("override_error"))


def apply_overrides(classified: DataFrame, overrides: DataFrame, pack: Pack, unwanted: str = URL) -> DataFrame:
    """classified (record, team_id, league_id, status, confidence, conflicts, and what else it has) with merchants' overrides.

    A key that is present decides, null clears. A team brings its league unless a league is given; facets settle the
    conflicts of facets and versions. Fields overridden lose their conflict and get confidence 1; while other conflicts are left, the
    record needs review at half confidence at most, else it has the status and confidence it had before the review, unless the
    override names them. An override with an error (parse_overrides) changes nothing. Added: override_applied, override_error,
    override_fields, display_name and display_category_name (given ones, else those of classified), team_source, and
    automatic_<column> of all columns that an override may change.
    """
    has = lambda k: F.array_contains("_given", k)
    own = [c for c in ("team_id", "league_id", "facets", "status", "confidence", "conflicts", "team_confidence", "league_confidence", "facet_confidence") if c in classified.columns]
    rows = classified.join(parse_overrides(overrides, pack, unwanted).withColumnRenamed("given", "_given"), "record", "left")
    ok = F.col("_given").isNotNull() & F.col("override_error").isNull()
    rows = rows.withColumn("override_applied", ok)
    ok = F.col("override_applied")
    rows = rows.withColumn("_given", F.when(ok, F.col("_given")).otherwise(F.array().cast("array<string>")))
    brings = has("teamId") & F.col("_of").isNotNull()
    fields = F.filter(F.array(F.when(has("teamId"), "team"), F.when(has("leagueId") | brings, "league"), F.when(has("facetIds"), "facet")), lambda f: f.isNotNull())
    settled = F.concat("override_fields", F.when(has("facetIds"), F.array(F.lit("facets"), F.lit("version"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("override_fields", fields).withColumn("_rest", F.array_except("conflicts", settled))
    before = lambda c: F.col(f"base_{c}" if f"base_{c}" in classified.columns else c)
    left = F.size("_rest") > 0
    new = {
        "team_id": F.when(has("teamId"), F.col("_team")).otherwise(F.col("team_id")),
        "league_id": F.when(has("leagueId"), F.col("_league")).when(brings, F.col("_of")).otherwise(F.col("league_id")),
        "conflicts": F.when(ok, F.col("_rest")).otherwise(F.col("conflicts")),
        "status": F.when(~ok, F.col("status")).when(has("classificationStatus"), F.col("_status")).when(left, "needs_review").otherwise(before("status")),
        "confidence": F.when(~ok, F.col("confidence")).when(has("classificationConfidence"), F.col("_confidence")).when(left, F.least(F.lit(0.5), before("confidence"))).otherwise(before("confidence")),
        **({"facets": F.when(has("facetIds"), F.col("_facets")).otherwise(F.col("facets"))} if "facets" in own else {}),
        **{f"{f}_confidence": F.when(F.array_contains("override_fields", f), 1.0).otherwise(F.col(f"{f}_confidence")) for f in ("team", "league", "facet") if f"{f}_confidence" in own},
    }
    shown = {c: F.coalesce(F.when(has(k), F.col(v)), F.col(c) if c in classified.columns else F.lit(None).cast("string")) for c, k, v in (("display_name", "displayName", "_name"), ("display_category_name", "displayCategoryName", "_category"))}
    rest = [c for c in classified.columns if c not in (*new, *shown)]
    return rows.select(
        *rest, *[v.alias(k) for k, v in (new | shown).items()], *[F.col(c).alias(f"automatic_{c}") for c in own], "override_applied", "override_error", "override_fields",
        F.when(F.array_contains("override_fields", "team"), "merchant_override").otherwise("automatic").alias("team_source"),
    )


def _view(columns: list[str], fields: list[str], prefix: str) -> tuple[Column, Column, dict[str, Column]]:
    """The view of a classification as a struct, its knowledge state, and that of each field."""
    named = lambda c: F.col(prefix + c if prefix + c in columns else c)
    effective = not prefix
    conflicts = named("conflicts")
    by = lambda f: F.array_contains("override_fields", f) if effective and "override_fields" in columns else F.lit(False)
    score = lambda f: F.when(by(f), 1.0).otherwise(F.coalesce(named(f"{f}_confidence"), F.lit(0.0)))
    states = {f: knowledge_state(score(f), F.array_contains(conflicts, f)) for f in fields}
    overall = knowledge_state(named("confidence"), F.size(conflicts) > 0, None, named("status"))
    review = (named("status") == "needs_review") | (F.size(conflicts) > 0)
    body = F.struct(named("status").alias("status"), named("confidence").alias("confidence"), overall.alias("knowledgeState"), _claims(columns, fields, prefix, effective, states).alias("claims"), conflicts.alias("conflicts"), review.alias("reviewRequired"))
    return body, overall, states


def intelligence_state(df: DataFrame, fields: list[str], version: str) -> DataFrame:
    """record, knowledge_state, conflict_count, review_required, research_required, reasons, state_json.

    df has confidence, status, conflicts and for each field what build_claims takes; after apply_overrides these are the
    effective values, and the automatic ones are in automatic_* (where there is no such column, both views agree). A domain
    and domain_confidence may be there too. The first columns are of the effective view; reasons to look further (``knowledge_*``, ``field_*``) are of the
    automatic one. The JSON holds both views, each with its claims: value, confidence, state, sources, source.
    """
    effective, overall, _ = _view(df.columns, fields, "")
    automatic, first, states = _view(df.columns, fields, "automatic_")
    open_ = ("UNKNOWN", "UNCERTAIN", "CONFLICT", "STALE")
    reasons = [F.when(first.isin(*open_), F.concat(F.lit("knowledge_"), F.lower(first)))] + [F.when(s.isin(*open_), F.concat(F.lit("field_"), F.lower(s))) for s in states.values()]
    listed = F.array_sort(F.array_distinct(F.filter(F.array(*reasons), lambda r: r.isNotNull())))
    domain = F.col("domain") if "domain" in df.columns else F.lit("unknown")
    sure = F.col("domain_confidence") if "domain_confidence" in df.columns else F.lit(0.0)
    of = F.struct(domain.alias("id"), sure.alias("confidence"), knowledge_state(sure, None, None, F.when(domain == "unknown", "unknown")).alias("knowledgeState"))
    applied = F.col("override_applied") if "override_applied" in df.columns else F.lit(False)
    body = F.struct(F.lit(version).alias("classifierVersion"), of.alias("domain"), automatic.alias("automatic"), effective.alias("effective"), applied.alias("overrideApplied"), F.struct((F.size(listed) > 0).alias("required"), listed.alias("reasonCodes")).alias("research"))
    return df.select(
        "record", overall.alias("knowledge_state"), F.size("conflicts").alias("conflict_count"), ((F.col("status") == "needs_review") | (F.size("conflicts") > 0)).alias("review_required"),
        (F.size(listed) > 0).alias("research_required"), listed.alias("reasons"), F.to_json(body).alias("state_json"),
    )


#: Bytes of a state's JSON at most (fixed value).
STATE_BYTES = 64 * 1024


def state_columns(state: DataFrame, most: int = STATE_BYTES) -> DataFrame:
    """state (of intelligence_state) with state_bytes and state_error; a JSON of more bytes is no valid state and is left out."""
    size = F.octet_length("state_json")
    return state.withColumns({"state_bytes": size, "state_error": F.when(size > most, "state_too_large"), "state_json": F.when(size <= most, F.col("state_json"))})


def classify_base(products: DataFrame, pack: Pack, hits: DataFrame | None = None) -> DataFrame:
    """record, league_id, team_id, facets, signals, status, confidence of products (record, name, category, path)."""
    hits = alias_hits(products, pack) if hits is None else hits
    leagues = detect_league(products, pack, hits)
    out = products.select("record", "category").join(leagues, "record", "left").join(detect_team(products, leagues, pack, hits), "record", "left")
    out = backfill_league(out, pack).join(detect_facets(products, pack, hits), "record", "left")
    return base_status(out, pack.not_navigation).select("record", "league_id", "team_id", F.coalesce("facets", F.array().cast("array<string>")).alias("facets"), "signals", "status", "confidence")


def stale_products(products: DataFrame, events: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Products to classify again: touched by an event, or not classified by this version."""
    current = state.where(F.col("version") == version).select("record")
    return products.join(events.select("record"), "record", "left_semi").unionByName(products.join(current, "record", "left_anti")).distinct()


#: What keys of packs, domains, dictionaries and navigation look like, and how much a navigation holds.
KEYS = {"pack": r"^[a-z0-9][a-z0-9-]{0,63}$", "domain": r"^[a-z0-9][a-z0-9-]{0,31}$", "id": r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$", "item": r"^[a-z0-9][a-z0-9:_-]{0,95}$", "kind": r"^[a-z][a-z0-9_-]{0,47}$"}
MOST_ITEMS, LABEL_SIZE, MOST_ORDER = 64, 120, 10_000


def validate_pack(pack: Pack, unwanted: str = URL) -> DataFrame:
    """check, id of each fault of a pack: its key, domain, version and thresholds (0 to 1), its dictionaries (ids unique and
    well formed, aliases of one id, teams with an alias), and its navigation (at most 64 items, unique, with safe labels)."""
    ids = pack.aliases.groupBy("kind", "id").agg(F.countDistinct("ordinal").alias("n"))
    repeated = pack.aliases.withColumn("token", fold(F.col("alias"))).groupBy("kind", "token").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n > 1")
    twice = lambda df: df.groupBy("id").count().where("count > 1").select("id")
    blank = lambda df: df.where("id is null or trim(id) = ''").select("id")
    parts: list[tuple[str, DataFrame]] = [
        ("ordinal_repeats", ids.where("n > 1").select("id")), ("bad_key", pack.aliases.where(~F.col("id").rlike(KEYS["id"])).select("id").distinct()), ("alias_of_several", repeated.select("id")),
        ("team_without_alias", pack.teams.select("id").join(pack.aliases.where("kind = 'team'").select("id"), "id", "left_anti")),
        ("team_repeats", twice(pack.teams)), ("facet_repeats", twice(pack.facets)), ("team_blank", blank(pack.teams)), ("facet_blank", blank(pack.facets)),
    ]
    if pack.navigation is not None:
        items = pack.navigation
        label = clean_ws(F.coalesce("name", F.lit("")))
        fits = lambda c, k: F.coalesce(F.lower(F.trim(c)).rlike(KEYS[k]), F.lit(False))
        parts += [
            ("navigation_too_long", items.agg(F.count("*").alias("n")).where(F.col("n") > MOST_ITEMS).select(F.col("n").cast("string").alias("id"))), ("navigation_repeats", twice(items.withColumn("id", F.lower(F.trim("id"))))),
            ("navigation_bad_id", items.where(~fits("id", "item")).select("id")), ("navigation_bad_kind", items.where(~fits("kind", "kind")).select("id")),
            ("navigation_bad_label", items.where((label == "") | (F.length(label) > LABEL_SIZE) | label.rlike(unwanted)).select("id")), ("navigation_bad_order", items.where(~F.coalesce(F.col("sort_order").between(0, MOST_ORDER), F.lit(False))).select("id")),
        ]
    spark = pack.aliases.sparkSession
    plain = [("pack_bad_key", pack.key)] * (not re.match(KEYS["pack"], pack.key)) + [("pack_bad_domain", pack.domain)] * (not re.match(KEYS["domain"], pack.domain)) + [("pack_bad_version", str(pack.version))] * (pack.version < 1)
    plain += [("bad_threshold", k) for k, v in pack.thresholds.items() if not k or not 0 <= v <= 1]
    out = spark.createDataFrame(plain, "check string, id string")
    for name, df in parts:
        out = out.unionByName(df.select(F.lit(name).alias("check"), "id"))
    return out


def build_navigation(items: DataFrame, counts: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Navigation items (id, kind, ref, sort_order) with their totals (kind, id, total): those without products go, unless
    no item has any (then all stay at 0); an item whose total is unknown stays."""
    c = counts.select(F.col("kind").alias("_kind"), F.col("id").alias("_ref"), "total")
    rows = items.join(c, (F.col("kind") == F.col("_kind")) & (F.col("ref") == F.col("_ref")), "left").drop("_kind", "_ref")
    some = rows.agg(F.coalesce(F.max(F.col("total") > 0), F.lit(False)).alias("_some"))  # one row
    out = rows.crossJoin(F.broadcast(some))
    shown = F.lit(True) if keep_zero else ~F.col("_some") | F.col("total").isNull() | (F.col("total") > 0)
    return out.where(shown).select("id", "kind", "ref", "sort_order", F.when(F.col("_some"), F.col("total")).otherwise(0).alias("total"))




def conflicts_by_record(evidence: DataFrame, pack: Pack, hits: DataFrame, seasons: DataFrame) -> DataFrame:
    """record, conflicts (sorted fields) of the records that have any."""
    found = find_conflicts(evidence_candidates(evidence, pack, hits), seasons, pack)
    return found.groupBy("record").agg(F.array_sort(F.collect_set("field")).alias("conflicts"))


def classify_catalog(t: dict[str, DataFrame], pack: Pack, version: str, key: str) -> dict[str, DataFrame]:
    """A whole classification run; an empty catalog fails.

    t: products (record, name, category, category_path_ids), categories (id, name), overrides (record, json), leagues
    (id), teams (id), facets (id). Gives products (record, team_id, league_id, facets, status, confidence, conflicts,
    override_applied, ...), product_facets (record, facet_id: all of them anew), state (the stored intelligence), leagues,
    teams and facets with product_count (those without products go), and meta (key, value). All of it is drawn from one
    stored pass over the texts and one stored table of classified products.
    """
    products = t["products"]
    if products.isEmpty():
        raise ValueError("the catalog is empty")
    names = resolve_path(products, "record", "category_path_ids", t["categories"]).withColumnRenamed("path_names", "path")
    evidence = stored(build_evidence(products.select("record", "name", "category").join(names, "record", "left")), "evidence")
    hits = alias_hits(evidence, pack)
    seasons = stored(pick_season(evidence), "seasons")
    none = F.array().cast("array<string>")
    rows = classify_base(evidence, pack, hits).join(conflicts_by_record(evidence, pack, hits, seasons), "record", "left")
    rows = stored(review_status(rows.withColumn("conflicts", F.coalesce("conflicts", none))), "classified")
    best = lambda kind, name: evidence_candidates(evidence, pack, hits).where(F.col("kind") == kind).groupBy("record").agg(F.max("score").alias(name))
    scored = rows.join(best("team", "team_score"), "record", "left").join(best("league", "league_score"), "record", "left").join(seasons.where("rank = 1").select("record", F.col("label").alias("season_id"), F.col("confidence").alias("season_score")), "record", "left")
    sure = field_confidence(scored.withColumn("facet_count", F.size("facets"))).drop("team_score", "league_score", "season_score", "facet_count")
    done = stored(apply_overrides(sure, t["overrides"].select("record", "json"), pack), "overridden")
    facets = done.select("record", F.explode("facets").alias("facet_id"))
    state = state_columns(intelligence_state(done, ["team", "league", "facet", "season"], version))
    state = state.join(done.select("record", "override_applied"), "record")
    counted = lambda dim, facts, column: prune_zero(dim_counts(dim.withColumnRenamed("id", column), facts, column), "product_count").withColumnRenamed(column, "id")
    return {
        "products": done, "product_facets": facets, "state": state, "meta": _classification_meta(done, version, key),
        "leagues": counted(t["leagues"], done, "league_id"), "teams": counted(t["teams"], done, "team_id"), "facets": counted(t["facets"], facets, "facet_id"),
    }


def _classification_meta(done: DataFrame, version: str, key: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    totals = done.agg(n("automatic").alias("classified"), n("needs_review").alias("needsReview"), n("unknown").alias("unknown"), F.count("*").alias("products"))
    meta = totals.select(F.lit("classification").alias("name"), F.lit(version).alias("version"), F.lit(key).alias("key"), "*")
    short = totals.select(F.lit("normalization").alias("name"), F.lit(version).alias("version"), F.lit(None).cast("string").alias("key"), "classified", "needsReview", "unknown", F.lit(None).cast("long").alias("products"))
    return meta_rows(meta.unionByName(short).withColumnRenamed("name", "_name"), "_name")


def merge_counts(dim: DataFrame, before: DataFrame, added: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """dim (id, ...) with product_count: the counts before (id, product_count; none is 0) and one for each fact added, less one
    for each that is gone; those without products go. Only the facts that changed are read."""
    signed = added.select(F.col(column).alias("id"), F.lit(1).alias("d")).unionByName(gone.select(F.col(column).alias("id"), F.lit(-1).alias("d")))
    parts = before.select("id", F.col("product_count").cast("long").alias("d")).unionByName(signed.where("id is not null").select("id", F.col("d").cast("long").alias("d")))
    return dim.drop("product_count").join(parts.groupBy("id").agg(F.sum("d").alias("product_count")), "id").where("product_count <> 0")


def reclassify_catalog(t: dict[str, DataFrame], before: dict[str, DataFrame], events: DataFrame, pack: Pack, version: str, key: str) -> dict[str, DataFrame]:
    """What classify_catalog gives for t, from the stored tables of an earlier run (before) and the records of events.

    Classified again are products that an event names, that the run before didn't have, or whose state is of another version;
    products that t no longer has go. All other rows are taken over, and counts move by signed differences. An override
    that changed has to come with an event. before has to be stored tables of another place than the result's.
    """
    products = t["products"]
    kept_state = before["state"].select("record", F.get_json_object("state_json", "$.classifierVersion").alias("version"))
    stale = stored(stale_products(products, events, kept_state, version), "stale")
    gone = before["products"].select("record").join(products.select("record"), "record", "left_anti")
    touched = small(stored(stale.select("record").unionByName(gone).distinct(), "touched"))
    if stale.isEmpty():
        now = {k: before[k].limit(0) for k in ("products", "product_facets", "state")}
    else:
        now = classify_catalog(t | {"products": stale}, pack, version, key)
    out = {k: before[k].join(touched, "record", "left_anti").unionByName(now[k]) for k in ("products", "product_facets", "state")}
    old = {k: stored(before[k].join(touched, "record", "left_semi"), "old") for k in ("products", "product_facets")}
    for name, table, column in (("leagues", "products", "league_id"), ("teams", "products", "team_id"), ("facets", "product_facets", "facet_id")):
        out[name] = merge_counts(t[name], before[name], now[table], old[table], column)
    return out | {"meta": _classification_meta(out["products"], version, key)}
