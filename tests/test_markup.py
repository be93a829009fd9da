"""The tokenizer against trees that are written out in odd ways, and extraction from nested cards."""

from __future__ import annotations

import html
import random

import pytest

from tidemark.sources import html_pages
from tidemark.sources.markup import tokenize

TAGS = ["div", "span", "b", "section", "ul", "em"]
VALUES = ["", "x", "a b", "it's", 'say "hi"', "é&<>", "1=2", "/p/q.jpg 2x, /r 1x"]


def tree(rng, depth=0):
    if depth > 4 or rng.random() < 0.25:
        return rng.choice(["t", " ", "a<b", "x & y", "ü©", "&amp;"])
    attrs = {n: rng.choice(VALUES) for n in rng.sample(["id", "class", "data-id", "title"], rng.randint(0, 3))}
    return (rng.choice(["img", "br"] if rng.random() < 0.2 else TAGS), attrs, [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))])


def escaped(text, rng, quote=""):
    styles = [html.escape, lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):X};"]
    return "".join(rng.choice(styles)(c) if c in "&<>'\"" or (ord(c) > 127 and rng.random() < 0.5) or c == quote else c for c in text)


def written(t, rng):
    if isinstance(t, str):
        return escaped(t, rng)
    tag, attrs, inside = t
    parts = []
    for k, v in attrs.items():
        style = rng.choice(["'", '"', "bare"])
        if style == "bare" and v and not set(v) & set(" '\"=<>`/"):
            parts.append(f"{k}={escaped(v, rng)}")
        else:
            q = style if style != "bare" else "'"
            parts.append(rng.choice([k, f'{k}=""', f"{k} = ''"]) if not v else f"{rng.choice([k, k.upper()])}={q}{escaped(v, rng)}{q}")
    name = rng.choice([tag, tag.upper()])
    begin = f"<{' '.join([name, *parts])}{rng.choice(['', ' '])}>"
    return begin if tag in ("img", "br") else f"{begin}{''.join(written(c, rng) for c in inside)}</{name}>"


def separated(t):
    """Texts side by side joined, so that what is expected doesn't depend on where they met."""
    if isinstance(t, str):
        return t
    inside = []
    for c in map(separated, t[2]):
        if isinstance(c, str) and inside and isinstance(inside[-1], str):
            inside[-1] += c
        else:
            inside.append(c)
    return (t[0], t[1], inside)


@pytest.mark.parametrize("seed", range(120))
def test_odd_markup(seed):
    rng = random.Random(seed)
    t = separated(("div", {}, [tree(rng) for _ in range(4)]))
    expected: list = []

    def walk(x):
        at = len(expected)
        if isinstance(x, str):
            expected.append(["#text", None, at, None, x])
            return
        expected.append([x[0], list(x[1].items()), at, None, None])
        for c in x[2] if x[0] not in ("img", "br") else ():
            walk(c)
        expected[at][2] = len(expected) - 1

    walk(t)
    assert tokenize(written(t, rng)) == expected


def test_what_is_left_open():
    tags = lambda h: [(n[0], n[2]) for n in tokenize(h)]
    assert tags("<ul><li>a<li>b<ul><li>c</ul></ul>d") == [("ul", 7), ("li", 2), ("#text", 2), ("li", 7), ("#text", 4), ("ul", 7), ("li", 7), ("#text", 7), ("#text", 8)]
    assert tags("<p>a<p><b>b<div>c") == [("p", 1), ("#text", 1), ("p", 4), ("b", 4), ("#text", 4), ("div", 6), ("#text", 6)]
    assert tags("</x><table><tr><td>1<td>2<tr><td>3</table>") == [("table", 8), ("tr", 5), ("td", 3), ("#text", 3), ("td", 5), ("#text", 5), ("tr", 8), ("td", 8), ("#text", 8)]
    assert tags("<script>if (a<b) '</p>'</script>x") == [("script", 1), ("#raw", 1), ("#text", 2)]
    assert tokenize("<a x=1 x=2 y>")[0][1] == [("x", "1"), ("y", "")] and tokenize(None) == [] == tokenize("")
    assert [n[0] for n in tokenize("<b>t</b><![foo[ <i>")][:2] == ["b", "#text"] and len(tokenize("<div>" * 5000)) == 5000


def test_cards(spark):
    page = """<ul><li class='c album' data-update-time=u1><div><a href=/albums/1><img src='/a.jpg'><img data-src="//photo.test/b.jpg"></a></div><h3>One &amp; <b>only</b></h3><span class="photo-count"> 7 </span>
      <li><a href='/albums/2' title=" T&nbsp;2 ">x</a> photos: 31 <time>yesterday</time><li><a href="/albums/1">again</a></ul><a href=/albums/3>bare <i>link</i></a><a href=/other>o</a><a>no</a>"""
    pages = spark.createDataFrame([(1, "https://h.test/list", page), (2, "https://h.test/", None), (3, None, "")], "page_id long, url string, html string")
    got = sorted(map(tuple, html_pages.extract_listing(pages, r"/albums/(\d+)", cards=("li", ".album"), preferred="photo").collect()))
    assert got == [
        (1, "1", "https://h.test/albums/1", "One & only", "https://photo.test/b.jpg", 7, "u1"), (1, "2", "https://h.test/albums/2", "T 2", None, 31, "yesterday"), (1, "3", "https://h.test/albums/3", "bare link", None, None, None),
    ]
