"""Queries of the classification operators, over a small pack of the driver's own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import classify as C
from tidemark.operators.counts import exception_metrics
from tidemark.operators.ranking import top_candidate
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Tables
from tidemark.sources.shared import stored

DIMS = ("titles", "team_dim", "facet_dim", "types")
#: Words of a title, as rows.
WORDS = "words as materialized (select k, unnest(string_split(regexp_replace(title, '[^a-z0-9]+', ' ', 'g'), ' ')) as w, title, p_type, p_brand from titles)"
TEAMS = "team_hits as materialized (select distinct k, t.team_id, t.league_id, t.ordinal from words join team_dim t on t.team_id = w)"
COLD = "not (facet_id = 'old' and cold)"  # a shorter token within a longer one doesn't count
FACETS = "facet_hits as materialized (select distinct words.k, f.facet_id, f.facet_type, f.ordinal, c.k is not null as cold from words join facet_dim f on f.facet_id = w left join (select distinct k from words where w = 'cold') c on c.k = words.k)"


def pack_of(t: Tables) -> C.Pack:
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), F.col(c).alias("alias"), "ordinal", F.lit(0).alias("alias_ordinal"))
    leagues = row(t.types, "league", "league_id").withColumn("alias", F.concat(F.lit("x"), "alias"))
    aliases = leagues.unionByName(row(t.team_dim, "team", "team_id")).unionByName(row(t.facet_dim, "facet", "facet_id"))
    teams = t.team_dim.select(F.col("team_id").alias("id"), "league_id", F.lit(False).alias("national"))
    facets = t.facet_dim.select(F.col("facet_id").alias("id"), "facet_type", F.col("ordinal").alias("sort_order"))
    # a user's dictionaries are tables; these are derived, so they are stored once
    return C.Pack(stored(aliases, "aliases"), stored(teams, "teams"), stored(facets, "facets"), keywords=("24",))


def records_of(t: Tables) -> DataFrame:
    """Titles with a category that is no league, so that teams of any league may be found."""
    return t.titles.select(F.col("k").alias("record"), F.col("title").alias("name"), F.col("p_brand").alias("category"), F.array("p_brand").alias("path"))


def leagued_of(t: Tables) -> DataFrame:
    return t.titles.select(F.col("k").alias("record"), F.col("title").alias("name"), F.concat(F.lit("x"), "p_type").alias("category"), F.array(F.concat(F.lit("x"), "p_type"), "p_brand").alias("path"))


@query(f"with {WORDS} select distinct k as record, 'team' as kind, t.team_id as id from words join team_dim t on t.team_id = w union all select distinct k, 'facet', f.facet_id from words join facet_dim f on f.facet_id = w", DIMS)
def alias_matches(t: Tables) -> DataFrame:
    return C.match_aliases(records_of(t).select("record", F.col("name").alias("text")), pack_of(t)).select("record", "kind", "id")


@query("""with d as (select distinct p_name || ' ' || p_type as alias, p_type as id from part where p_partkey % 2 = 0), a as (select alias, id, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) as token from d), p as (select k, trim(regexp_replace(lower(title || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) as text from titles)
    select p.k as record, a.token, a.id, p.text = a.token as whole from p join a on contains(' ' || p.text || ' ', ' ' || a.token || ' ')""", ("titles",))
def long_alias_matches(t: Tables) -> DataFrame:
    """Names with their types as aliases of up to six words, among all titles with their types and brands."""
    names = t.part.where("p_partkey % 2 = 0").select(F.lit("name").alias("kind"), F.col("p_type").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("alias")).distinct()
    aliases = names.withColumns({"ordinal": F.lit(0).cast("long"), "alias_ordinal": F.lit(0)})
    texts = t.titles.select(F.col("k").alias("record"), F.concat_ws(" ", "title", "p_type", "p_brand").alias("text"))
    empty = t.spark.createDataFrame([], "id string, league_id string, national boolean, facet_type string, sort_order int")
    return C.match_aliases(texts, C.Pack(stored(aliases, "aliases"), empty, empty)).select("record", "token", "id", "whole")


@query(f"with {WORDS}, {TEAMS}, best as (select k, team_id from team_hits qualify row_number() over (partition by k order by length(team_id) desc, ordinal) = 1) select t.k as record, d.league_id, b.team_id from titles t left join best b on b.k = t.k left join team_dim d on d.team_id = b.team_id", DIMS)
def detected_teams(t: Tables) -> DataFrame:
    records, pack = stored(records_of(t), "records"), pack_of(t)
    return _teams(records, pack, C.alias_hits(records, pack))


def _teams(records: DataFrame, pack: C.Pack, hits: DataFrame) -> DataFrame:
    leagues = C.detect_league(records, pack, hits)
    teams = records.select("record").join(leagues, "record", "left").join(C.detect_team(records, leagues, pack, hits), "record", "left")
    return C.backfill_league(teams, pack).select("record", "league_id", "team_id")


@query(f"""with {WORDS}, {TEAMS}, {FACETS}, best as (select h.k, h.team_id from team_hits h join titles t on t.k = h.k where h.league_id = t.p_type qualify row_number() over (partition by h.k order by length(h.team_id) desc, h.ordinal) = 1),
    f as (select k, string_agg(facet_id, ',' order by ordinal) as facets from facet_hits group by k), s as (select t.k, t.p_type, b.team_id, f.facets, cast(b.team_id is not null as integer) + 1 + cast(f.facets is not null as integer) + 1 as signals from titles t left join best b on b.k = t.k left join f on f.k = t.k)
    select k as record, p_type as league_id, team_id, coalesce(facets, '') as facets, signals, 'automatic' as status, case signals when 2 then 0.67 when 3 then case when team_id is not null then 0.95 else 0.83 end else 0.99 end as confidence from s""", DIMS)
def base_status(t: Tables) -> DataFrame:
    return C.classify_base(leagued_of(t), pack_of(t)).withColumn("facets", F.array_join("facets", ","))


@query(f"with {WORDS}, {TEAMS}, {FACETS} select k as record, 'team' as kind, team_id as id, 0.96 as score, 'title' as sources from team_hits union all select k, 'facet', facet_id, 0.96, 'title' from facet_hits where {COLD} union all select k, 'league', p_type, 0.97, 'category,path' from titles", DIMS)
def evidence_scores(t: Tables) -> DataFrame:
    evidence = C.build_evidence(leagued_of(t)).where("code is null")
    return C.evidence_candidates(evidence, pack_of(t)).withColumn("sources", F.array_join("sources", ","))


@query("""with m as (select k, 'red bolt' as token, 'a' as id from titles where k % 3 = 0 union all select k, 'bolt', 'b' from titles union all select k, 'old', 'c' from titles where k % 2 = 0 union all select k, 'cold', 'd' from titles where k % 4 = 0)
    select k as record, id from m where not exists (select 1 from m o where o.k = m.k and o.id <> m.id and length(o.token) > length(m.token) and contains(o.token, m.token))""", ("titles",))
def longest_alias(t: Tables) -> DataFrame:
    k = F.col("k")
    options = F.array(*[F.when(cond, F.struct(F.lit(token).alias("token"), F.lit(i).alias("id"))) for token, i, cond in (("red bolt", "a", k % 3 == 0), ("bolt", "b", k >= 0), ("old", "c", k % 2 == 0), ("cold", "d", k % 4 == 0))])
    rows = t.titles.select(k.alias("record"), F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o")).select("record", F.lit("title").alias("field"), F.lit("x").alias("kind"), "o.token", "o.id")
    return C.suppress_shorter(rows).select("record", "id")


@query("""select k as record, '2024/25' as label, 0.96 as confidence, 1 as rank from titles where k % 4 = 0 union all select k, '2025/26', 0.96, 2 from titles where k % 12 = 0""", ("titles",))
def season_pick(t: Tables) -> DataFrame:
    return C.pick_season(C.build_evidence(records_of(t))).withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {WORDS}, {TEAMS}, {FACETS} select k as record, 'team' as field, string_agg(distinct team_id, ',' order by team_id) as ids from team_hits group by k having count(*) > 1
    union all select k, 'league', string_agg(distinct league_id, ',' order by league_id) from team_hits group by k having count(distinct league_id) > 1
    union all select k, 'season', '2024/25,2025/26' from titles where k % 12 = 0
    union all select k, 'version', string_agg(distinct facet_id, ',' order by facet_id) from facet_hits where facet_type = 'version' and {COLD} group by k having count(*) > 1""", DIMS)
def entity_conflicts(t: Tables) -> DataFrame:
    pack, evidence = pack_of(t), stored(C.build_evidence(records_of(t)), "evidence")
    found = C.find_conflicts(stored(C.evidence_candidates(evidence, pack), "candidates"), C.pick_season(evidence), pack)
    return found.withColumn("ids", F.array_join("ids", ","))


def _state_input(t: Tables) -> tuple[DataFrame, DataFrame, C.Pack]:
    """Records with the conflicts of their fields, and status and confidence of a base run; their seasons; the pack."""
    pack, evidence = pack_of(t), stored(C.build_evidence(records_of(t)), "evidence")
    hits, seasons = C.alias_hits(evidence, pack), C.pick_season(evidence)
    base = _teams(evidence, pack, hits).withColumns({"status": F.lit("automatic"), "confidence": F.lit(0.95)})
    rows = base.join(C.conflicts_by_record(evidence, pack, hits, seasons), "record", "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>")))
    return C.review_status(rows), seasons, pack


CONFLICTS = f"""{WORDS}, {TEAMS}, {FACETS}, found as (select k, 'team' as field from team_hits group by k having count(*) > 1 union all select k, 'league' from team_hits group by k having count(distinct league_id) > 1
    union all select k, 'season' from titles where k % 12 = 0 union all select k, 'version' from facet_hits where facet_type = 'version' and {COLD} group by k having count(*) > 1),
    best as (select k, team_id, league_id from team_hits qualify row_number() over (partition by k order by length(team_id) desc, ordinal) = 1),
    given as (select k, json, k % 3 = 0 as clears from overrides), st as (select t.k, b.team_id, b.league_id, string_agg(f.field, ',' order by f.field) as conflicts, count(f.field) as n, count(*) filter (where f.field = 'team') as nt, count(*) filter (where f.field = 'league') as nl, count(*) filter (where f.field = 'season') as ns from titles t left join best b on b.k = t.k left join found f on f.k = t.k group by 1, 2, 3)"""


@query(f"""with {CONFLICTS}, r as (select st.*, g.json, g.clears, case when g.json is null then n when g.clears then n - nt else n - nt - nl end as rest from st left join given g on g.k = st.k)
    select k as record, case when json is null then team_id when clears then null else 'bolt' end as team_id, case when json is null or clears then r.league_id else (select d.league_id from team_dim d where d.team_id = 'bolt') end as league_id, rest as conflicts,
    case when json is not null and rest = 0 then 'automatic' when n > 0 then 'needs_review' else 'automatic' end as status, case when json is not null and rest = 0 then 0.95 when rest > 0 or n > 0 then 0.5 else 0.95 end as confidence, json is not null as override_applied from r""", (*DIMS, "overrides"))
def overrides_applied(t: Tables) -> DataFrame:
    rows, _, pack = _state_input(t)
    out = C.apply_overrides(rows, t.overrides.withColumnRenamed("k", "record"), pack)
    return out.select("record", "team_id", "league_id", F.size("conflicts").cast("long").alias("conflicts"), "status", "confidence", "override_applied")


@query(f"""with {CONFLICTS}, x as (select k, n, nt, ns, team_id is not null as has, k % 4 = 0 and ns = 0 as season from st)
    select k as record, case when n > 0 then 'CONFLICT' else 'VERIFIED' end as knowledge_state, n as conflict_count, n > 0 as review_required, case when nt > 0 then 'CONFLICT' when has then 'VERIFIED' else 'UNKNOWN' end as team_state, n > 0 or not has or not season as research_required from x""", (*DIMS, "overrides"))
def intelligence_states(t: Tables) -> DataFrame:
    rows, seasons, _ = _state_input(t)
    season = seasons.where("rank = 1").select("record", F.col("confidence").alias("season_score"))
    rows = rows.join(season, "record", "left").withColumns({"team_score": F.when(F.col("team_id").isNotNull(), 0.96), "league_score": F.lit(None).cast("double"), "facet_count": F.lit(1)})
    state = C.state_columns(C.intelligence_state(C.field_confidence(rows), ["team", "season"], "v1"))
    return state.select("record", "knowledge_state", F.col("conflict_count").cast("long").alias("conflict_count"), "review_required", F.get_json_object("state_json", "$.automatic.claims.team.state").alias("team_state"), "research_required")


@query(f"with {CONFLICTS} select count(*) filter (where n > 0) as review, count(*) filter (where n > 0 or team_id is null or not (k % 4 = 0 and ns = 0)) as research, count(*) filter (where n > 0) as conflicts from st", (*DIMS, "overrides"))
def exception_counts(t: Tables) -> DataFrame:
    return exception_metrics(intelligence_states(t))


@query(f"with {WORDS}, {TEAMS}, {FACETS}, hit as (select k from team_hits union select k from facet_hits) select t.k as record, case when h.k is not null then 0.96 when t.k % 4 = 0 then 0.78 else 0.25 end as confidence, case when h.k is not null or t.k % 4 = 0 then 'a' else 'b' end as pack from titles t left join hit h on h.k = t.k", DIMS)
def routed_domains(t: Tables) -> DataFrame:
    pack, evidence = pack_of(t), C.build_evidence(records_of(t))
    a = C.domain_confidence(C.evidence_candidates(evidence, pack), evidence.select("record", F.col("name").alias("text")), pack)
    b = evidence.select("record", F.lit(0.25).alias("confidence"), F.lit("known").alias("domain"))
    return C.route_domains([("a", a), ("b", b)]).select("record", "confidence", "pack")


@query("select k, case when k % 7 = 0 then 'information' when k % 3 = 0 and k % 4 <= 2 then 'navigation' else 'product' end as kind from titles", ("titles",))
def item_kinds(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.titles.select("k", F.when(k % 7 == 0, "Size chart").when(k % 3 == 0, "All categories").otherwise(F.col("title")).alias("name"), F.lit("").alias("description"), (k % 4).alias("images"))
    return C.classify_item(rows, r"\bsize\s+chart\b", r"\b(?:ring|bolt)\b", r"\bteam\b", r"^all categories$").select("k", "kind")


@query("select l_suppkey as supplier, id, confidence from (select l_suppkey, cast(l_partkey as varchar) as id, l_discount as confidence, row_number() over (partition by l_suppkey order by l_discount desc, cast(l_partkey as varchar)) as r from lineitem) where r = 1")
def top_candidates(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").cast("string").alias("id"), F.col("l_discount").alias("confidence"))
    return top_candidate(rows, ["supplier"])


@query("""with c as (select split_part(p_name, ' ', 2) as id, count(*) as total from part group by 1), items as (select team_id as id, 'team' as kind, team_id as ref, ordinal as sort_order from team_dim union all select 'none', 'team', 'none', 90 union all select 'zero', 'team', 'zero', 91)
    select i.id, i.sort_order, case when i.ref = 'zero' then 0 else c.total end as total from items i left join c on c.id = i.ref where i.ref <> 'zero'""", ("team_dim",))
def navigation(t: Tables) -> DataFrame:
    totals = t.part.groupBy(F.split("p_name", " ")[1].alias("id")).agg(F.count("*").alias("total"))
    zero = t.spark.createDataFrame([("team", "zero", 0)], "kind string, id string, total long")
    counts = totals.select(F.lit("team").alias("kind"), "id", "total").unionByName(zero)
    extra = t.spark.createDataFrame([("none", "team", "none", 90), ("zero", "team", "zero", 91)], "id string, kind string, ref string, sort_order long")
    items = t.team_dim.select(F.col("team_id").alias("id"), F.lit("team").alias("kind"), F.col("team_id").alias("ref"), F.col("ordinal").alias("sort_order")).unionByName(extra)
    return C.build_navigation(items, counts).select("id", "sort_order", "total")


@query("""select 'alias_of_several' as "check", min(team_id) as id from team_dim group by substr(team_id, 1, 1) having count(*) > 1 union all select 'bad_threshold', 'needsReview' union all select 'pack_bad_key', 'Bad Key' union all select 'team_repeats', team_id from team_dim where ordinal % 3 = 0
    union all select 'navigation_bad_label', team_id from team_dim where ordinal % 4 = 0 union all select 'navigation_bad_order', team_id from team_dim where ordinal % 5 = 0 union all select 'navigation_bad_kind', team_id from team_dim where ordinal % 7 = 0
    union all select 'navigation_repeats', team_id from team_dim where ordinal % 2 = 0 union all select 'navigation_too_long', cast(c as varchar) from (select count(*) + count(*) filter (where ordinal % 2 = 0) as c from team_dim) where c > 64""", ("team_dim",))
def pack_faults(t: Tables) -> DataFrame:
    pack = pack_of(t)
    teams = pack.aliases.where("kind = 'team'").withColumn("alias", F.substring("alias", 1, 1))
    o = F.col("ordinal")
    items = t.team_dim.select(F.col("team_id").alias("id"), F.when(o % 4 == 0, "see HTTPS://x.test").otherwise("Name").alias("name"), F.when(o % 7 == 0, "9 kinds").otherwise("team").alias("kind"), F.when(o % 5 == 0, 10_001).otherwise(o).alias("sort_order"), "ordinal")
    again = items.where(o % 2 == 0).select(F.upper("id").alias("id"), F.lit("Other").alias("name"), F.lit("team").alias("kind"), F.lit(1).cast("long").alias("sort_order"))
    twice = pack.teams.unionByName(pack.teams.join(t.team_dim.where(o % 3 == 0).select(F.col("team_id").alias("id")), "id", "left_semi"))
    return C.validate_pack(C.Pack(teams, twice, pack.facets, thresholds={"needsReview": 1.5, "known": 1.0}, key="Bad Key", navigation=items.drop("ordinal").unionByName(again)))


#: Overrides by the last digit of a record.
GIVEN = ['{"teamId":null}', '{"teamId":"bolt"}', '{"leagueId":"nowhere"}', '{"facetIds":["hot","hot"]}', '{"displayName":"see http://x"}', '{"facetIds":["nothing"]}', '{"classificationStatus":"unknown","classificationConfidence":0.25}', '{"teamId":"bolt","color":1}', 'no json', '{"leagueId":null,"displayName":" Fine name "}']


@query("""select k as record, case k % 10 when 0 then null when 1 then 'bolt' else 'x' end as team_id, case k % 10 when 1 then (select league_id from team_dim where team_id = 'bolt') when 9 then null else 'y' end as league_id, case k % 10 when 3 then 'hot' else 'old' end as facets,
    case when k % 10 in (0, 1) then 'version' when k % 10 = 3 then 'team' else 'team,version' end as conflicts, case k % 10 when 6 then 'unknown' else 'needs_review' end as status, case k % 10 when 6 then 0.25 else 0.5 end as confidence, case when k % 10 in (0, 1) then 1.0 else 0.45 end as team_confidence,
    case k % 10 when 9 then 'Fine name' end as display_name, k % 10 in (0, 1, 3, 6, 9) as override_applied, case k % 10 when 2 then 'unknown_league' when 4 then 'unsafe_label' when 5 then 'unknown_facet' when 7 then 'unknown_key' when 8 then 'bad_json' end as override_error,
    case k % 10 when 0 then 'merchant_override' when 1 then 'merchant_override' else 'inference' end as team_claim, case when k % 10 in (0, 1) then 'VERIFIED' else 'CONFLICT' end as team_state, 'CONFLICT' as automatic_state, 'field_conflict,knowledge_conflict' as reasons from titles""", ("team_dim", "titles"))
def override_rules(t: Tables) -> DataFrame:
    """Each kind of override on records with conflicts of team and version, and both views of the state that follows."""
    k = F.col("k")
    rows = t.titles.select(
        k.alias("record"), F.lit("x").alias("team_id"), F.lit("y").alias("league_id"), F.array(F.lit("old")).alias("facets"), F.lit("needs_review").alias("status"), F.lit(0.5).alias("confidence"), F.lit("automatic").alias("base_status"), F.lit(0.95).alias("base_confidence"),
        F.array(F.lit("team"), F.lit("version")).alias("conflicts"), F.lit(0.45).alias("team_confidence"),
    )
    given = t.titles.select(k.alias("record"), F.get(F.array(*[F.lit(g) for g in GIVEN]), (k % 10).cast("int")).alias("json"))
    out = C.apply_overrides(rows, given, pack_of(t))
    state = C.intelligence_state(out, ["team"], "v1")
    part = lambda p: F.get_json_object("state_json", p)
    seen = state.select("record", part("$.effective.claims.team.source").alias("team_claim"), part("$.effective.claims.team.state").alias("team_state"), part("$.automatic.knowledgeState").alias("automatic_state"), F.array_join("reasons", ",").alias("reasons"))
    return out.select("record", "team_id", "league_id", F.array_join("facets", ",").alias("facets"), F.array_join("conflicts", ",").alias("conflicts"), "status", "confidence", "team_confidence", "display_name", "override_applied", "override_error").join(seen, "record")


@query("select event_id, case when event_id % 5 <> 0 then cast(json_extract_string(props, '$.k') as integer) end as k, event_id % 5 <> 0 as good from events")
def safe_json(t: Tables) -> DataFrame:
    value = scoring.safe_json(F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")), "k int")
    return t.events.select("event_id", value["k"].alias("k"), value.isNotNull().alias("good"))


@query("select k as record from titles where k % 5 = 0 or k % 7 <> 0", ("titles",))
def stale_products(t: Tables) -> DataFrame:
    records = t.titles.select(F.col("k").alias("record"))
    state = records.withColumn("version", F.when(F.col("record") % 7 == 0, "v2").otherwise("v1"))
    return C.stale_products(records, records.where("record % 5 = 0"), state, "v2")


@query("""select k as record, split_part(p_name, ' ', 2) as team, case when k % 4 = 0 then 1.0 else 0.96 end as confidence, case when k % 4 = 0 then '' else 'title' end as sources, case when k % 4 = 0 then 'merchant_override' else 'inference' end as source from titles""", ("titles",))
def claims(t: Tables) -> DataFrame:
    """The team of each record with its evidence; a fourth of them comes from the merchant."""
    rows = t.titles.select(F.col("k").alias("record"), F.split("p_name", " ")[1].alias("team_id"), F.lit(0.96).alias("team_confidence"), F.array(F.lit("title"), F.lit("title")).alias("team_sources"), F.when(F.col("k") % 4 == 0, F.array(F.lit("team"))).otherwise(F.array().cast("array<string>")).alias("override_fields"))
    team = F.col("claims")["team"]
    return C.build_claims(rows, ["team"]).select("record", team["value"].alias("team"), team["confidence"].alias("confidence"), F.array_join(team["sources"], ",").alias("sources"), team["source"].alias("source"))


@query(f"""with {WORDS}, {TEAMS}, {FACETS}, own as (select k, league_id from team_hits union select k, p_type from titles), found as (select k, 'team' as field from team_hits group by k having count(*) > 1 union all select k, 'league' from own group by k having count(*) > 1
    union all select k, 'season' from titles where k % 12 = 0 union all select k, 'version' from facet_hits where facet_type = 'version' and {COLD} group by k having count(*) > 1),
    best as (select h.k, h.team_id from team_hits h join titles t on t.k = h.k where h.league_id = t.p_type qualify row_number() over (partition by h.k order by length(h.team_id) desc, h.ordinal) = 1),
    st as (select t.k, t.p_type, b.team_id, count(f.field) as n, count(*) filter (where f.field = 'team') as nt, count(*) filter (where f.field = 'league') as nl from titles t left join best b on b.k = t.k left join found f on f.k = t.k group by 1, 2, 3),
    r as (select st.*, json, case when json is null then n when st.k % 3 = 0 then n - nt else n - nt - nl end as rest from st left join overrides o on o.k = st.k),
    e as (select k, case when json is null then team_id when k % 3 = 0 then null else 'bolt' end as team_id, case when json is null or k % 3 = 0 then p_type else (select d.league_id from team_dim d where d.team_id = 'bolt') end as league_id, case when json is not null and rest = 0 then 'automatic' when n > 0 then 'needs_review' else 'automatic' end as status from r)
    select 'status' as kind, status as id, count(*) as n from e group by status union all select 'team', team_id, count(*) from e where team_id is not null group by team_id union all select 'league', league_id, count(*) from e group by league_id union all select 'facet', facet_id, count(*) from facet_hits group by facet_id""", (*DIMS, "overrides"))
def classified_catalog(t: Tables) -> DataFrame:
    """Counts of a whole classification run: statuses as its meta row has them, and the dimensions it keeps."""
    tables, pack = _catalog(t)
    return _run_counts(C.classify_catalog(tables, pack, "v1", "key"))


def _catalog(t: Tables) -> tuple[dict[str, DataFrame], C.Pack]:
    path = F.array(F.concat(F.lit("x"), "p_type"), "p_brand")
    products = t.titles.select(F.col("k").alias("record"), F.col("title").alias("name"), F.concat(F.lit("x"), "p_type").alias("category"), path.alias("category_path_ids"))
    categories = t.titles.select(F.explode(path).alias("id")).distinct().withColumn("name", F.col("id"))
    pack = pack_of(t)
    dims = {"leagues": t.types.select(F.col("league_id").alias("id")), "teams": pack.teams.select("id"), "facets": pack.facets.select("id")}
    return {"products": products, "categories": categories, "overrides": t.overrides.withColumnRenamed("k", "record"), **dims}, pack


def _run_counts(out: dict[str, DataFrame]) -> DataFrame:
    total = lambda name, field: F.struct(F.lit(name).alias("id"), F.get_json_object("value", f"$.{field}").cast("long").alias("n"))
    meta = out["meta"].where("key = 'classification'").select(F.explode(F.array(total("automatic", "classified"), total("needs_review", "needsReview"), total("unknown", "unknown"))).alias("c")).select(F.lit("status").alias("kind"), "c.*").where("n > 0")
    for kind in ("team", "league", "facet"):
        meta = meta.unionByName(out[f"{kind}s"].select(F.lit(kind).alias("kind"), "id", F.col("product_count").alias("n")))
    return meta


@query(f"""with {WORDS}, {TEAMS}, {FACETS}, own as (select k, league_id from team_hits union select k, p_type from titles), found as (select k, 'team' as field from team_hits group by k having count(*) > 1 union all select k, 'league' from own group by k having count(*) > 1
    union all select k, 'season' from titles where k % 12 = 0 union all select k, 'version' from facet_hits where facet_type = 'version' and {COLD} group by k having count(*) > 1),
    best as (select h.k, h.team_id from team_hits h join titles t on t.k = h.k where h.league_id = t.p_type qualify row_number() over (partition by h.k order by length(h.team_id) desc, h.ordinal) = 1),
    st as (select t.k, t.p_type, b.team_id, count(f.field) as n, count(*) filter (where f.field = 'team') as nt, count(*) filter (where f.field = 'league') as nl from titles t left join best b on b.k = t.k left join found f on f.k = t.k group by 1, 2, 3),
    r as (select st.*, json, case when json is null then n when st.k % 3 = 0 then n - nt else n - nt - nl end as rest from st left join overrides o on o.k = st.k),
    e as (select k, case when json is null then team_id when k % 3 = 0 then null else 'bolt' end as team_id, case when json is null or k % 3 = 0 then p_type else (select d.league_id from team_dim d where d.team_id = 'bolt') end as league_id, case when json is not null and rest = 0 then 'automatic' when n > 0 then 'needs_review' else 'automatic' end as status from r)
    select 'status' as kind, status as id, count(*) as n from e group by status union all select 'team', team_id, count(*) from e where team_id is not null group by team_id union all select 'league', league_id, count(*) from e group by league_id union all select 'facet', facet_id, count(*) from facet_hits group by facet_id""", (*DIMS, "overrides"))
def reclassified_catalog(t: Tables) -> DataFrame:
    """The counts of classified_catalog from an earlier run in which a fifth of the products had other names and a seventh
    was missing, and some were there that are no more."""
    tables, pack = _catalog(t)
    r = F.col("record")
    earlier = tables["products"].where(r % 7 != 3).withColumn("name", F.when(r % 5 == 0, F.lit("cold bolt 24/25")).otherwise(F.col("name")))
    earlier = earlier.unionByName(tables["products"].where(r % 11 == 0).withColumn("record", -1 - r))
    before = C.classify_catalog(tables | {"products": earlier}, pack, "v1", "key")
    before = {k: stored(df, f"run-{k}") for k, df in before.items()}
    return _run_counts(C.reclassify_catalog(tables, before, tables["products"].where(r % 5 == 0).select("record"), pack, "v1", "key"))
