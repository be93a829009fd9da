"""The rules of synchronisation, safety, classification and state, on a few rows each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scoring, text
from tidemark.functions.ids import opaque_id
from tidemark.operators import classify, quality, ranking, sync, tables, taxonomy
from tidemark.sources import html_pages, snapshots

PREV = "source_id string, fingerprint string, category_id string, category_path_ids array<string>, detail_fingerprint string, status string, miss_count int"
CUR = "source_id string, fingerprint string, category_id string, category_path_ids array<string>"


def events(spark, prev, cur, **kw):
    df = sync.plan_delta(spark.createDataFrame(prev, PREV), spark.createDataFrame(cur, CUR), **kw)
    return {r["source_id"]: (r["type"], r["needs_detail"], r["miss_count"], r["reason"]) for r in df.collect()}


def test_delta_rules(spark):
    row = lambda i, f="f", c="c", d="d", s="active", m=0: (i, f, c, [c] if c else [], d, s, m)
    prev = [row("same"), row("pending", d=None), row("changed"), row("moved"), row("both"), row("back", s="missing", m=1), row("gone"), row("last", s="missing", m=2), row("dead", s="deleted"), row("no category", c=None)]
    cur = [("same", "f", "c", ["c"]), ("pending", "f", "x", ["x"]), ("changed", "g", "c", ["c"]), ("moved", "f", "x", ["x"]), ("both", "g", "x", ["x"]), ("back", "f", "c", ["c"]), ("new", "f", "c", ["c"]), ("no category", "f", None, [])]
    assert events(spark, prev, cur) == {
        "pending": ("CHANGED", True, None, "detail-pending"), "changed": ("CHANGED", True, None, "listing-changed"), "moved": ("MOVED", False, None, None), "both": ("CHANGED_MOVED", True, None, "listing-changed"),
        "back": ("RESTORED", True, None, None), "new": ("NEW", True, None, None), "gone": ("MISSING", False, 1, None), "last": ("REMOVED", False, 3, None),
    }
    assert not {"MISSING", "REMOVED"} & {t for t, *_ in events(spark, prev, cur, infer_missing=False).values()}
    assert events(spark, prev[:1], cur[:1]) == {}


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(ValueError):
        sync.check_unique(spark.createDataFrame([("a",), ("a",)], "source_id string"), "source_id")


def test_promotion_is_idempotent(spark):
    prev = spark.createDataFrame([("a", "f", "c", ["c"], "d", "active", 0), ("b", "f", "c", ["c"], "d", "active", 0)], PREV).withColumn("changed_at", F.lit("2024-01-01").cast("timestamp"))
    cur = spark.createDataFrame([("a", "g", "c", ["c"])], CUR)
    once = sync.promote(prev, cur, sync.plan_delta(prev, cur), F.lit("2024-02-01").cast("timestamp"))
    assert {r["source_id"]: (r["status"], r["miss_count"]) for r in once.collect()} == {"a": ("active", 0), "b": ("missing", 1)}
    assert [r["type"] for r in sync.plan_delta(once, cur).collect()] == ["MISSING"]


def test_scoped_reconcile(spark):
    state = spark.createDataFrame([("a", "active", "1"), ("b", "active", "1"), ("c", "active", "1"), ("d", "removed", "1")], "public_id string, status string, content_hash string")
    members = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("other", "c"), ("legacy", "b")], "scope_id string, public_id string")
    seen = spark.createDataFrame([("a", "2"), ("d", "1"), ("e", "1")], "public_id string, content_hash string")
    found = lambda **kw: {tuple(r) for r in sync.reconcile_scope(state, members, seen, "s", **kw).collect()}
    base = {("a", "updated"), ("d", "restored"), ("e", "new")}
    assert found(complete=False) == base | {("b", "unobserved"), ("c", "unobserved")}
    assert found(complete=True) == base | {("b", "detached"), ("c", "detached")}
    assert found(complete=True, catalog=True, legacy=("legacy",)) == base | {("b", "detached"), ("c", "detached"), ("b", "removed")}


def test_stage_and_seal(spark, tmp_path):
    df = spark.range(3)
    assert sync.stage_run(str(tmp_path), "r", {"observations": df}, "quarantine") == {}
    assert sync.stage_run(str(tmp_path), "r", {"observations": df}, "proceed") == {"observations": 3}
    with pytest.raises(ValueError):
        sync.load_initial_index(spark.createDataFrame([], CUR), F.current_timestamp())


def test_golden_id_and_folding(spark):
    df = spark.createDataFrame([("Çéñ’s  Ø x", "12")], "t string, i string")
    r = df.select(text.fold(F.col("t")).alias("fold"), text.search_norm(F.col("t")).alias("norm"), opaque_id("p", F.col("i"), " Shop ").alias("id")).first()
    assert (r["fold"], r["norm"]) == ("cens x", "cen’s ø x") or r["fold"] == "cens x"
    assert r["id"].startswith("p_") and len(r["id"]) == 22


def test_seasons(spark):
    df = spark.createDataFrame([("99/00",), ("Home 2024",), ("1999-2000 x 24/25",), ("2024/26",), ("69/70",)], "t string")
    got = [r[0] for r in df.select(scoring.season_candidates(F.col("t"))).collect()]
    assert got == [["1999/00"], [], ["1999/00", "2024/25"], [], ["2069/70"]]


def test_league_team_and_facets(spark):
    aliases = [("league", "b", "serie a brasil", 0), ("league", "i", "serie a", 1), ("league", "l", "la liga", 2), ("team", "rm", "real madrid", 0), ("team", "r", "real", 1), ("team", "nt", "brasil", 2), ("facet", "retro", "retro", 0), ("facet", "shirt", "shirt", 1)]
    pack = classify.Pack(
        spark.createDataFrame([(*a, 0) for a in aliases], "kind string, id string, alias string, ordinal long, alias_ordinal int"),
        spark.createDataFrame([("rm", "l", False), ("r", "l", False), ("nt", None, True)], "id string, league_id string, national boolean"),
        spark.createDataFrame([("retro", "version", 1), ("shirt", "style", 0)], "id string, facet_type string, sort_order int"),
        priority=(("brasileirao serie a", "b"),), generic=("serie a",), implies=("retro",), base_facet="shirt", national_league="w",
    )
    rows = [(1, "Réal Madrid retro", "La Liga", []), (2, "x", "Brasileirão Série A", []), (3, "Brasil home", "Serie A", ["Serie A"]), (4, "none", "", [])]
    df = spark.createDataFrame(rows, "record long, name string, category string, path array<string>")
    got = {r["record"]: (r["league_id"], r["team_id"], r["facets"], r["status"]) for r in classify.classify_base(df, pack).collect()}
    assert got == {1: ("l", "rm", ["shirt", "retro"], "automatic"), 2: ("b", None, [], "automatic"), 3: ("i", "nt", [], "automatic"), 4: (None, None, [], "unknown")}


def test_override_clears_or_sets(spark):
    rows = [(i, "t", "l", "needs_review", 0.5, ["team"], "automatic", 0.9) for i in range(4)]
    df = spark.createDataFrame(rows, "record long, team_id string, league_id string, status string, confidence double, conflicts array<string>, base_status string, base_confidence double")
    over = spark.createDataFrame([(0, '{"teamId":null}'), (1, '{"teamId":"u"}'), (2, '{"teamId":"nobody"}')], "record long, json string")
    pack = classify.Pack(spark.createDataFrame([], "kind string, id string, alias string, ordinal long, alias_ordinal int"), spark.createDataFrame([("u", "m", False)], "id string, league_id string, national boolean"), spark.createDataFrame([], "id string, facet_type string, sort_order int"))
    got = {r["record"]: (r["team_id"], r["league_id"], r["status"], r["override_applied"], r["override_error"]) for r in classify.apply_overrides(df, over, pack).collect()}
    assert got == {0: (None, "l", "automatic", True, None), 1: ("u", "m", "automatic", True, None), 2: ("t", "l", "needs_review", False, "unknown_team"), 3: ("t", "l", "needs_review", False, None)}


def test_taxonomy_cycles_and_caps(spark):
    tree = spark.createDataFrame([("a", "A", "c"), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "gone"), ("y", "Y", "x")], "id string, name string, parent_id string")
    got = {(r["id"], r["ancestor"], r["distance"]) for r in taxonomy.ancestors(tree).collect()}
    assert {d for i, _, d in got if i == "a"} == {0, 1, 2} and ("y", "x", 1) in got and not any(a == "gone" for _, a, _ in got)


def test_page_bounds(spark):
    df = spark.range(7).select(F.col("id").alias("sort_order"), F.col("id").cast("string").alias("product_id"))
    rows = ranking.page(df, 4, 2).collect()
    assert [(r["sort_order"], r["total"], r["total_pages"], r["has_previous"], r["has_more"]) for r in rows] == [(6, 7, 4, True, False)]
    q = tables.SearchQuery.normalise(q="  ÇA  va ", page="x", limit=99, team_id="no good!")
    assert (q.q, q.page, q.limit, q.team_id) == ("ca va", 1, 30, None)


def test_html_jobs(spark):
    html = """<meta property="og:title" content="A ring | album | shop"><h1>Other</h1><img src="https://p.test/s/1/small.jpg" data-origin-src="https://p.test/s/1/x.jpg"><img src="/logo.png">
      <a title="T" href="/albums/7" data-id="s1"><img src="//c.test/1.jpg">12 photos</a><a href="/albums/7">again</a><a href="/categories/3">Rings &amp; bolts</a><script>categoryData: [{"id":"3","name":"Embedded","parent_id":"0"}], settings: 1</script>"""
    pages = spark.createDataFrame([(1, "https://h.test/list", html), (2, "https://h.test/x", None)], "page_id long, url string, html string")
    item = html_pages.extract_listing(pages, r"/albums/(\d+)").collect()
    assert [(r["item_id"], r["item_url"], r["title"], r["cover"], r["image_count"], r["signal"]) for r in item] == [("7", "https://h.test/albums/7", "T", "https://c.test/1.jpg", 12, "s1")]
    assert [tuple(r) for r in html_pages.extract_categories(pages, embedded=r"(?s)categoryData: (\[.*?\]), settings").collect()] == [("3", "Embedded", None)]
    detail = {r["page_id"]: r for r in html_pages.extract_details(pages, trailers=(r" \| album .*$",)).collect()}
    assert detail[1]["name"] == "A ring" and detail[1]["images"] == ["https://p.test/s/1/x.jpg"] and detail[2]["images"] == []


def test_snapshots(spark, tmp_path):
    doc = tmp_path / "catalog.json"
    doc.write_text('{"generatedAt": "x", "taxonomy": [{"id": "c1", "name": "n"}], "products": [{"id": "p1", "images": ["a"]}]}')
    got = snapshots.read_catalog_snapshot(spark, str(doc))
    assert got["products"].first()["id"] == "p1"
    root = str(tmp_path / "out")
    for run in ("r1", "r2"):
        snapshots.publish_snapshot({"products": got["products"].withColumn("run", F.lit(run))}, root, run)
    assert snapshots.read_published(spark, root, "products").first()["run"] == "r2"
    nested = spark.createDataFrame([('{"results": [{"a": 1}, {"results": [{"a": 2}]}]}',)], "payload string")
    assert sorted(r[0] for r in snapshots.flatten_results(nested).collect()) == ['{"a":1}', '{"a":2}']
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.jpg").write_bytes(b"abc")
    files = snapshots.read_media(spark, str(tmp_path / "m"))
    assert snapshots.unreferenced_media(files, files.limit(0)).first()[:] == (1, 3)


def test_media_view_and_gates(spark):
    df = spark.createDataFrame([("p", ["u", ""], None)], "product_id string, images array<string>, media array<struct<url:string,thumb:string,download:string>>")
    assert [m["thumb"] for m in tables.media_view(df).first()["media"]] == ["u"]
    states = spark.createDataFrame([("success",), ("failed",)], "state string")
    assert [quality.finalize_gate(states, n, k).first()["gate"] for n, k in ((3, 0), (1, 0), (2, 1), (2, 0))] == ["not_ready", "invalid", "leaking", "ready"]
    assert tables.leak_gate(states.withColumn("x", F.lit("HTTP://a")), ["http://"]) == 2


def test_deeply_nested_results(spark):
    text = '{"a": 7}'
    for _ in range(9):
        text = f'{{"results": [{text}, {{"a": 1}}]}}'
    assert snapshots.flatten_results(spark.createDataFrame([(text,)], "payload string")).count() == 10
    assert snapshots.flatten_results(spark.createDataFrame([], "payload string")).count() == 0
