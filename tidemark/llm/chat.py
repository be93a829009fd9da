"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    conversation := turn*
    turn         := "[INST:" level ":" role "]" body "</s>"

role never holds "%", "/" or "]" as such (percent-encoded). body is the text at an escape level: 0 as it is; 1 with the
"/" of each "</s>" written as %2F; 2 the same with each "%" written as %25 before. A turn is rendered at the lowest
level from which the parser below gets the same role and text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</s>"
LEVELS = (0, 1, 2)
HEADER = r"^\[INST:[012]:[^\]]*\]"


def _replace(col: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def render_turn(role: Column, text: Column, level: int) -> Column:
    body = (text, _replace(text, (END, "<%2Fs>")), _replace(text, ("%", "%25"), (END, "<%2Fs>")))[level]
    return F.concat(F.lit(f"[INST:{level}:"), _replace(role, ("%", "%25"), ("/", "%2F"), ("]", "%5D")), F.lit("]"), body, F.lit(END))


def parse_turn(segment: Column) -> Column:
    """role, text of what stands before an end mark; null if it is no turn."""
    header = F.regexp_extract(segment, HEADER, 0)
    body = F.substring(segment, F.char_length(header) + 1, F.char_length(segment))
    level = F.substring(segment, F.lit(7), F.lit(1))
    role = F.regexp_extract(segment, r"^\[INST:[012]:([^\]]*)\]", 1)
    text = F.when(level == "0", body).when(level == "1", _replace(body, ("%2F", "/"))).otherwise(_replace(body, ("%2F", "/"), ("%25", "%")))
    return F.when(header != "", F.struct(_replace(role, ("%5D", "]"), ("%2F", "/"), ("%25", "%")).alias("role"), text.alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), parse_turn)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, text, ...):

    conv_id, formatted, n_turns, loss_spans (array of the start and length, in code points, of each body of loss_role),
    identical (whether the formatted text parses to just these turns).

    Null roles and texts count as empty. Turns are ordered by turn (nulls first), ties by role and text; repeated rows
    are turns of their own. A null conv_id is a conversation like any other. An empty table gives an empty result;
    further columns are ignored. A conversation is put together in one place, as its text is one string.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    tried = [render_turn(F.col("role"), F.col("text"), k) for k in LEVELS]
    rendered = F.coalesce(*[F.when(parse(t) == source, t) for t in tried[:-1]], tried[-1])
    rows = rows.withColumn("rendered", rendered)
    before = F.sum(F.char_length("rendered").cast("long")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))
    head = F.char_length(F.regexp_extract("rendered", HEADER, 0))
    rows = rows.withColumn("span", F.struct((F.col("start") + head).alias("start"), (F.char_length("rendered") - head - len(END)).cast("long").alias("length")))
    together = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "role", "text", "rendered", "span"))).alias("t"))
    together = together.select("conv_id", "t", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == loss_role), lambda x: x["span"])
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return together.select("conv_id", "formatted", F.size("t").cast("long").alias("n_turns"), spans.alias("loss_spans"), same.alias("identical"))


def span_text(formatted: Column, span: Column) -> Column:
    """What a loss span marks, unescaped by the level of its turn; as it is if no header ends where the span starts."""
    head = F.substring_index(F.substring(formatted, F.lit(1), span["start"].cast("int")), END, -1)
    body = F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
    return F.when(head.rlike(HEADER + "$"), parse_turn(F.concat(head, body))["text"]).otherwise(body)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text, the loss by its spans."""
    marked = F.array_join(F.transform("loss_spans", lambda s: span_text(F.col("formatted"), s)), "")
    read = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), marked.alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), flat.alias("flat"), "loss", "formatted_chars")
    return read.select("conv_id", "n_turns", F.sha2(F.encode("flat", "UTF-8"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


#: What digests(format_conversations(...)) gives, over a view "turns" (conv_id, turn, role, text).
SQL = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from turns),
r as (
  select *, case when not contains(text, '</s>') then length(text)
                 when not contains(text, '%2F') then length(replace(text, '</s>', '<%2Fs>'))
                 else length(replace(replace(text, '%', '%25'), '</s>', '<%2Fs>')) end
            + length(replace(replace(replace(role, '%', '%25'), '/', '%2F'), ']', '%5D')) + length('[INST:0:') + length(']</s>') as chars
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from r group by conv_id
"""
