"""Confidence, knowledge states, seasons, JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence by number of signals, without and with a team.
BASE_CONFIDENCE = {0: (0.35, 0.35), 1: (0.51, 0.63), 2: (0.67, 0.79), 3: (0.83, 0.95), 4: (0.99, 0.99)}


def base_confidence(signals: Column, has_team: Column) -> Column:
    out = F.lit(None).cast("double")
    for n, (plain, team) in BASE_CONFIDENCE.items():
        out = F.when(signals == n, F.when(has_team, team).otherwise(plain)).otherwise(out)
    return out


def knowledge_state(score: Column, conflict: Column | None = None, stale: Column | None = None, status: Column | None = None) -> Column:
    """Thresholds .95, .85 and .65, after conflict, staleness and an unknown status."""
    no = F.lit(False)
    return (
        F.when(F.coalesce(conflict, no) if conflict is not None else no, "CONFLICT")
        .when(F.coalesce(stale, no) if stale is not None else no, "STALE")
        .when(F.coalesce(status == "unknown", no) if status is not None else no, "UNKNOWN")
        .when(score >= 0.95, "VERIFIED").when(score >= 0.85, "KNOWN").when(score >= 0.65, "UNCERTAIN").otherwise("UNKNOWN")
    )


def _seasons(text: Column, pattern: str, start: int, end: int) -> Column:
    starts, ends = F.regexp_extract_all(text, F.lit(pattern), F.lit(start)), F.regexp_extract_all(text, F.lit(pattern), F.lit(end))
    return F.arrays_zip(starts.alias("s"), ends.alias("e"))


def season_candidates(text: Column) -> Column:
    """Labels like 2024/25 of the two-year seasons in a text, distinct: long and short starts, the end one year later."""
    long = _seasons(text, r"(?<!\d)((?:19|20)\d{2})[/-]((?:19|20)?\d{2})(?!\d)", 1, 2)
    short = _seasons(text, r"(?<![\d/-])(\d{2})/(\d{2})(?![\d/-])", 1, 2)

    def year(x: Column) -> Column:
        s = x["s"].cast("int")
        return F.when(F.length(x["s"]) == 4, s).when(s >= 70, 1900 + s).otherwise(2000 + s)

    def label(x: Column) -> Column:
        start, e = year(x), x["e"].cast("int")
        century = (start / 100).cast("int") * 100 + e
        end = F.when(F.length(x["e"]) == 4, e).when(century < start, century + 100).otherwise(century)
        ok = (end == start + 1) & start.between(1900, 2099) & (end <= 2099)
        return F.when(ok, F.concat(start.cast("string"), F.lit("/"), F.lpad((end % 100).cast("string"), 2, "0")))

    return F.array_distinct(F.filter(F.transform(F.concat(long, short), label), lambda x: x.isNotNull()))


def json_int(col: Column, path: str) -> Column:
    """An integer field of a JSON text, whether it is a number or a text of one; null for bad JSON."""
    return F.try_variant_get(F.try_parse_json(col), path, "int")


def is_json(col: Column) -> Column:
    """Whether a text is one JSON value with nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), col, F.lit("]"))) == 1, F.lit(False))


def safe_json(col: Column, schema: str) -> Column:
    """A JSON text as a value of a schema; null for bad JSON or none, nulls inside for fields of another type."""
    return F.from_json(F.when(is_json(col), col), schema)


def json_has(col: Column, key: str) -> Column:
    """Whether a JSON object has a key, a null value included."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(is_json(col), col)), key), F.lit(False))


def minutes_after(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
