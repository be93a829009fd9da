from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from tests.oracle import connection, rows as normal_rows
from tidemark.llm import chat, decontaminate, html_extract, quality, queries, url_filter, warc
from tidemark.llm.common import scratch

FOLDER = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    con = connection(FOLDER)
    for name, sql in queries.oracle_sql().items():
        got, expected = queries.queries()[name](spark, FOLDER), con.sql(sql)
        assert normal_rows(got.columns, got.collect()) == normal_rows(expected.columns, expected.fetchall()), name


def test_chat_round_trip(spark):
    texts = [(-8, 0, None, None), (-8, 1, "a]b%/", "%2F</s>%5D%25[INST:0:user]"), (-8, 1, "assistant", "</s"), (-8, 1, "assistant", "</s"), (-8, None, "assistant", "é</s></s>"), (None, 0, "assistant", ""), (1, 0, "user", "%2F"), (1, 1, "assistant", "</s>%2F")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    assert all(r["identical"] for r in out.collect())
    for r in out.collect():
        loss = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(loss) == sum(t[2] == "assistant" for t in texts if t[0] == r["conv_id"]) and not any("</s>" in x for x in loss)
    turns = df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("turns", turns)
    assert sorted(map(tuple, chat.digests(out).collect()), key=str) == sorted(con.sql(chat.SQL).fetchall(), key=str)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_containment(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(40))
    items = [(1, item), (2, "only three words"), (3, None), (4, ""), (5, item.upper()), (None, "x y z")]
    docs = [(10, "pre " * 5000 + item + " post" * 5000), (11, item[:60]), (12, "Only  three\nwords"), (13, None), (14, "only three words more"), (None, item), (15, " ".join(item.split()[:34]))]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, shingle string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, i).collect()}
    assert got == {(10, 1), (10, 5), (12, 2), (15, 1), (15, 5)}
    assert decontaminate.contained_items(d.limit(0), i).count() == 0 == decontaminate.contained_items(d, i.limit(0)).count()
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)  # the way of large benchmarks
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, i).collect()} == got


@pytest.mark.parametrize("sizes", [{}, {"roll": 2000, "shard": 3000, "least": 1000}])
def test_warc(spark, sizes):
    pages = [(10, "http://a/\r\nx", None), (11, None, "x" * 120), (12, "u", "x" * 120), (12, "u2", "x" * 120), (13, "u", "y"), (14, "u", "y"), (None, "u", "x" * 120), (10**15, "é", "é\x00\n" * 100)] + [(i, "u", f"page {i} " * 50) for i in range(20, 60)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    expected = []
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = i is not None and h in first and i > first[h]
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    names = []
    for _ in range(2):
        out = scratch(spark, "warc")
        names.append(sorted((r["name"], r["sha256"]) for r in warc.write_warc(df, out, **sizes).collect()))
        got = warc.read_warc(spark, out, payloads=True).collect()
        assert sorted([(r[0], *r[2:6]) for r in got], key=str) == sorted(expected, key=str)
        assert sorted(bytes(r[6]) for r in got if r[6] is not None) == sorted((h or "").encode() for (_, _, h), e in zip(pages, expected, strict=True) if e[3] == "response")
    assert names[0] == names[1]
    empty = scratch(spark, "warc")
    assert warc.write_warc(df.limit(0), empty).count() == 0 == warc.read_warc(spark, empty).count()


def test_url_rules_and_model(spark):
    urls = ["http://x.net/", "https://A.example.net/en/1", "http://example.com/de/x?y", "http://b.org/fr/", "http://example.net", "casino-win.test", None, "http://best-jackpot-bonus.test/x", "https://www.maritimelibrary.test/en/7", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("x.net", "/", "net/", "block") and got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][:3] == ("example.net", "", None) and got[5][:3] == ("", "", None) == got[6][:3]
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "allow") and got[9][:2] == ("b:", "//c/d")
    rows = tuple((*url_filter.split_url(u), v) for u, v in url_filter.LABELLED)
    threshold, accuracy = url_filter.cross_validated(rows)
    print("held-out accuracy, threshold", accuracy, threshold)
    assert accuracy >= 0.85 and url_filter.default_model()[1] == threshold


def brute_rule(url):
    host, path = url_filter.split_url(url) if "://" in (url or "") else ("", "")
    fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls_against_brute_force(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("url").collect()] + [None, "", "x", "://", "a://B.Net/", "http://notnet/", "http://net", "http://EXAMPLE.net/en/?x", "http://é.org/fr/#", "http://org/fr", "u://net?/en/"] * 2
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, path string")
    model, threshold = url_filter.default_model()
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if model.score(host, path) > threshold else "allow"))
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_labels_know_nothing_of_the_pages(spark):
    """No word of a host of the pages, and no host, is in the labelled table; verdicts follow the score and the rules alone."""
    rows = queries.queries()["op3_url_filter"](spark, "/root/testdata/sf0.1").collect()
    split = lambda host: set(host.replace("-", ".").split(".")[:-1])
    hosts = {r["host"] for r in rows}
    shared = set().union(*map(split, hosts)) & set().union(*(split(url_filter.split_url(u)[0]) for u, v in url_filter.LABELLED if v == "block"))
    assert not shared, shared
    assert {r["verdict"] for r in rows} == {"allow", "block"}


def test_warc_shards_of_hot_keys(spark):
    pages = [(None, f"u{i}", f"null {i} " * 20) for i in range(300)] + [(7, f"u{i}", "same " * 100) for i in range(300)] + [(5, "u", "same " * 100), (9, "u", "same " * 100)] + [(7, "v", f"other {i} " * 20) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = scratch(spark, "warc")
    manifest = warc.write_warc(df, out, shard=20_000, least=1000).toPandas()
    assert manifest["records"].sum() == len(pages) and manifest.groupby("shard")["records"].sum().max() < 80
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, out).collect()]
    assert sorted(got, key=str) == sorted([(i, "revisit" if i in (7, 9) and h.startswith("same") else "response", 5 if i in (7, 9) and h.startswith("same") else None) for i, _, h in pages], key=str)


PAGE = """<html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a>b">A</a></ul></nav><!-- ad --><div class="cookie-notice">We use</div>
<article><h1>T &amp;amp; &lt;x&gt;</h1><p><b>one <i>t</i>wo<br><p>three  <span class="ad">buy</span>four</p><ul><li>i1<li>i2</ul><form>f<input></form><table><tr><td>c1<td>c2</table>tail &nbsp; x<div id="comments"><p>c</p></div></article><aside>s</aside>after<footer>f</footer></body></html>"""


def test_extraction(spark):
    assert html_extract.main_text(PAGE) == "T &amp; <x>\n\none two\n\nthree four\n\ni1\n\ni2\n\nc1\n\nc2\n\ntail x"
    odd = {"": "", "<": "<", "a<b c": "a", "<!-- x": "", "<div>a</div>b<": "a\n\nb<", "<script>x": "", '<a href="x>y': "y", "</p></x>t": "t"}
    assert {k: html_extract.main_text(k) for k in odd} == odd
    assert html_extract.main_text("<a " * 50_000 + "<!--" * 1000) == ""


def test_what_is_no_furniture():
    page = "<body><nav>menu</nav>{}<footer>foot</footer></body>"
    text = lambda body: html_extract.main_text(page.format(body))
    assert text('<article class="ad-story share"><p>one</p></article>') == "one"
    assert text("<form><nav>x</nav><article><p>one</p></article></form>") == "one"
    assert text("<form><h1>T</h1><p>one</p></form>") == "T\n\none"
    assert text('<div class="post-related-item"><p>one</p></div>') == "one"
    assert text("<article><header><h1>T</h1></header><p>one</p></article>") == "T\n\none"
    assert text('<div class="mainmenu"><p>one</p></div>') == "one" and text('<div class="main-menu"><p>x</p></div><main>one</main>') == "one"
    assert text('<div id="comments"><p>c</p></div><div>one</div>') == "one" and text("<main></main><div>one</div>") == "one"


def test_deep_pages():
    n = 60_000
    assert html_extract.main_text("<div>" * n + "x" + "</div>" * n) == "x"
    assert html_extract.main_text("<x-y>" * n + "x" + "<p>y") == "x\n\ny"
    assert len(html_extract.page_nodes("<div>a" * n)) == n + 1
    assert html_extract.main_text("<svg>" * n + "x") == "x"


def renamed(html):
    """The page with neutral names for its tags and classes."""
    for old, new in (("nav", "k1"), ("footer", "k4"), ("article", "k3")):
        html = html.replace(f"<{old}>", f'<div class="{new}">').replace(f"</{old}>", "</div>")
    return html.replace('class="ad"', 'class="k2"')


def test_style_tree_alone(spark):
    """With neutral names the tree has to find the article; without a tree all is kept."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    rows = [(p, u, renamed(h), "clash") for p, u, h in zip(pages["page_id"], pages["url"], pages["html"], strict=True)]
    many = pages["url"].str.extract("://([^/?#]*)")[0].value_counts()
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, paths string")).collect()}
    of_many = [(p, h) for p, u, h in zip(pages["page_id"], pages["url"], pages["html"], strict=True) if many[u.split("/")[2].split("?")[0].split("#")[0]] >= 8]
    assert len(of_many) > 50
    right = [got[p] == html_extract.main_text(h) for p, h in of_many]
    assert np.mean(right) > 0.95
    assert not any(html_extract.main_text(renamed(h)) == html_extract.main_text(h) for _, h in of_many)
    named = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(pages)).collect()}
    assert all(named[p] == html_extract.main_text(h) for p, h in zip(pages["page_id"], pages["html"], strict=True))


def test_importance_against_brute_force(spark):
    pages = [(i, "http://h.test/", f"<body><div class=a>same</div><div class=b>{'<p>x</p>' * (i % 3)}{i}</div></body>") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("'h.test' as host", "html")
    got = {r["path"]: (r["pages"], round(r["importance"], 9)) for r in html_extract.style_tree(df).collect()}
    seen = {}
    for _, _, html in pages:
        for path, *kinds in html_extract.page_nodes(html):
            seen.setdefault(path, []).append(kinds)

    def entropy(values):
        p = np.array([values.count(v) for v in set(values)]) / len(values)
        return -(p * np.log(p)).sum() / np.log(len(values))

    for path, kinds in seen.items():
        presentation, content = ([k[i] for k in kinds] for i in (0, 1))
        assert got[path] == (len(kinds), round(0.6 * entropy(presentation) + 0.4 * entropy(content), 9) + 0.0)
    assert len(got) == len(seen)


def test_style_tree_drops_what_all_pages_share(spark):
    page = "<body><div class=x1><p>Same words on each page</p></div><div class=x2><p>Text {0}</p><p>More {0}</p></div></body>"
    schema = "page_id long, url string, html string, values string"
    rows = [(i, f"http://h{i % 2}.test/{i}", page.format(i), "clash") for i in range(12)] + [(50, "http://one.test/", page.format(50), ""), (51, None, None, ""), (51, None, None, "")]
    rows += [(60 + i, "http://copies.test/", page.format(0), "") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, schema)).collect()}
    assert got[3] == "Text 3\n\nMore 3" and got[50].startswith("Same words") and got[51] == ""
    assert got[60] == "Same words on each page\n\nText 0\n\nMore 0"
    assert html_extract.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_repeated_words_in_both_ways(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (0, 4, 5, 6, 50, 400):
        w = [f"w{i}" for i in rng.integers(0, 3, n)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        monkeypatch.setattr(quality, "LONG", 50_000)
        assert quality.repeated_words(w) == len(covered)
        monkeypatch.setattr(quality, "LONG", 0)
        assert quality.repeated_words(w) == len(covered)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=800) > 0).astype(float)
    model = quality.fit(x[:600], y[:600], [1, 0, -1])
    assert ((model.score(x[600:]) > 0) == (y[600:] > 0)).mean() > 0.85
    for j, sign in ((0, 1), (2, -1)):
        z = np.repeat(rng.normal(size=(1, 3)), 50, 0)
        z[:, j] = np.linspace(-3, 3, 50)
        assert (sign * np.diff(model.score(z)) >= -1e-9).all()


def test_quality_query(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "one two three four five six seven eight nine ten", "c"), (3, "a b\na b\n#", "c"), (None, "w " * 30, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = sorted(map(lambda r: (r["doc_id"], r["n_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), quality.judge(docs, model).collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, 0, True), (2, 0, 0, 0, 0, True), (3, 10, 0, 0, 0, False), (3, 5, 1, 1, 0, True), (None, 30, 0, 0, 30, True)], key=str)
    assert quality.train(docs, labels.limit(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0, 0]
    assert quality.judge(docs.limit(0), model).count() == 0 == quality.kept_rows(docs.limit(0), model).count()
    assert quality.train(docs.limit(0), labels).score(np.zeros((1, len(quality.FEATURES)))).tolist() == [0]
    twice = [quality.train(docs.repartition(n), labels).value.tolist() for n in (1, 3)]
    assert twice[0] == twice[1]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = lambda k: labels.where(f"pmod(xxhash64(doc_id), 2) = {k}")
    held = quality.judge(docs.join(half(1), "doc_id").select("doc_id", "text"), quality.train(docs, half(0)))
    right = held.where("not base_failed").join(half(1), "doc_id").selectExpr("avg(cast(kept = (quality = 1) as int)) as a").first()["a"]
    print("held-out accuracy", right)
    assert right > 0.9


def test_quality_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 200_000 + "end", "c")], "doc_id long, text string, kept string")
    r = quality.judge(df, quality.train(df, df.selectExpr("doc_id", "1 as quality"))).first()
    assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (200_001, 200_000, False)


def test_short_items_inside_documents(spark):
    docs = spark.createDataFrame([(1, "so Alpha beta  gamma and more words follow"), (2, "alpha beta"), (3, "beta gamma alpha is not it at all"), (4, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta"), (8, "Six"), (9, "two three four five six")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items, runs=True).collect()}
    assert found == {(1, 7), (2, 7), (4, 8), (4, 9)}


def test_loss_digest_reads_the_mask(spark):
    turns = [(1, 0, "user", "a 50% b</s>"), (1, 1, "assistant", "x</s>y %2F"), (1, 2, "assistant", "é</s>%"), (1, 3, "user", "z")]
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    right = hashlib.sha256("x</s>y %2Fé</s>%".encode()).hexdigest()
    assert chat.digests(out).first()["loss_sha256"] == right
    off = out.selectExpr("conv_id", "formatted", "n_turns", "transform(loss_spans, s -> struct(s.start + 1 as start, s.length as length)) as loss_spans", "identical")
    assert chat.digests(off).first()["loss_sha256"] != right
    fewer = out.selectExpr("conv_id", "formatted", "n_turns", "slice(loss_spans, 1, 1) as loss_spans", "identical")
    assert chat.digests(fewer).first()["loss_sha256"] != right
