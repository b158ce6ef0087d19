import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st

from skeinflow.llm import html_text
from skeinflow.llm.html_text import OUTSIDE, extract, main_text, parse

PROSE = "The quick brown fox jumps over the lazy dog and then runs on through the wide green field."
HARD = f"""<!DOCTYPE html><html><head><title>No</title><style>p>b{{}}</style><script>var t="</p><p>no";</script></head>
<body class="widget"><header>No</header><nav><a href="/">No</a></nav><div class="cookie-notice">No</div>
<div id="page"><div class="post-12 post-body"><h1>Head &amp; Tail</h1><p>{PROSE}<p>a<b>b</b>c&nbsp;d<br>e
 <!-- no <p> --> f &lt;g&gt; <span class="ad">no</span>h</p><aside class="x">No</aside><form><input value=">"><p>No</p></form>
<ul><li>one<li>two</ul><img alt="no" src=x><table><tr><td>1</td><td>2</td></tr></table></div>
<div class="comments"><article class="comment">No, {PROSE}</article></div><div class="sidebar">No {PROSE * 3}</div></div>
<footer>No</footer><noscript>No</noscript></body></html>"""
WANT = f"Head & Tail {PROSE} abc d e f <g> h one two 1 2"


def test_hard_page():
    assert extract(HARD, []) == WANT


def test_article_beats_longer_surroundings():
    page = f"<body><div class=links>{'<p><a href=x>' + PROSE + '</a></p>'}</div><article><p>Short &copy; text</p></article><div>{PROSE}</div>"
    assert extract(page, []) == "Short © text"


def test_broken_pages():
    assert extract("", []) == ""
    assert extract("just text", []) == "just text"
    assert extract("<p>open <b>bold <p>next</i></div> 1 < 2 & 3", []) == "open bold next 1 < 2 & 3"
    assert extract("<p>cut <a href='x", []) == "cut"
    assert extract("<script>never closed <p>x", []) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert extract(deep, []) == "x"


@pytest.mark.parametrize(("page", "want"), [
    ("<p title=it's>Hello</p> you", "Hello you"),
    ('<p title="oops>Hello</p><p class="x">you</p>', "you"),
    ('<p title="oops>Hello', ""),
    ("<p 'x\">Hello", "Hello"),
    ("<p a=b/>Hello<a href=http://x.example/>link</a> end", "Hellolink end"),
    ("<article>one</b></i></section></td>two</article>", "onetwo"),
    ("<article><b><div>one</b></div>two</article>", "one two"),
    ("<article><span class=hidden>no<span>no</span>no</span>yes</article>", "yes"),
    ("<article><nav><div>no</div>no</nav><div>yes</div></article>", "yes"),
    ("<div>a</nav></article></span>b</div>", "ab"),
    ("<head><title>no</title><p>yes", "yes"),
    ("<head><meta charset=x>no head", "no head"),
    ("<article>a<svg/>b<svg><path d='x'/><text>no</text></svg>c</article>", "abc"),
    ("<article>a<svg><path d='x'><div>b</div></article>", "a b"),
    ("<article>a<template><div>no<template>no</template>no</div>no</template>b</article>", "ab"),
    ("<article><script>if (a</b) '</article>' </SCRIPT\n >a<!--> b --> c<!-- - > no --!>d<!doctype x><?php no?></ no>e</>f</article>", "a b --> cdef"),
    ("<article>a<table><tr><td>b<td>c<tr><td>d<table><tr><td>e</tr></table>f</table>g</article>", "a b c d e f g"),
    ("<article>a < b &lt; <3 &amp;amp; <</article>", "a < b < <3 &amp; <"),
    ("a<br/>b<hr>c<wbr>d<img src='>'>e", "a b cde"),
    ("</body></html>late", "late"),
])
def test_markup_is_read_as_browsers_read_it(page, want):
    assert extract(page, []) == want


class Plain(HTMLParser):
    """The blocks of well-formed pages, read by another parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in OUTSIDE or tag == "script"
        if tag in ("div", "p", "li", "br", "article", "section", "nav", "aside", "form"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in OUTSIDE or tag == "script"
        if tag in ("div", "p", "li", "article", "section", "nav", "aside", "form"):
            self.text.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


LEAF = st.sampled_from(["word", " two words ", "&amp;", "&eacute;t&#233;", "<br>", "<img alt='>' src=a/b>", "<!-- no -->", "x &lt; y", "<script>no < </scrip></script>", "\n"])
TREE = st.recursive(LEAF, lambda inner: st.tuples(st.sampled_from(["div", "p", "b", "span", "a", "li", "section", "nav", "aside", "form"]), st.sampled_from(["", " class='c1 lead'", ' title="a > b"', " data-x=y/"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}{t[1]}>{''.join(t[2])}</{t[0]}>"), max_leaves=25)


@hyp(max_examples=300, deadline=None)
@given(st.lists(TREE, max_size=6))
def test_agrees_with_another_parser(parts):
    page = "<body><article>" + "".join(parts) + "</article></body>"
    plain = Plain()
    plain.feed(page)
    plain.close()
    text = html_text.text_below(nodes := html_text._parse(page, True, True)[0], nodes[:1])  # forms are forms, whatever they hold
    assert text.split() == "".join(plain.text).split()


@hyp(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-=\"' abdiv&;#\n", max_size=80))
def test_any_text_is_read(page):
    text = extract(page, [])
    assert " ".join(text.split()) == text


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>x" + "</span></td></p>" * 100_000, "<b>x" * 200_000, "<p title='" * 100_000, "<" * 1_000_000, "<!--" * 300_000,
    "<a " + "a " * 500_000, "<table><tr><td>" * 60_000, "<span class=ad><span>" * 50_000, "<script>" * 100_000, "</" * 400_000, "<div><span class=hidden>x</div>" * 30_000,
])
def test_long_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    extract(page, ["no such path"])
    assert time.process_time() - began < 20


LONG = PROSE + " " + PROSE


@pytest.mark.parametrize(("page", "want"), [
    (f"<article class=a>{LONG}</article><nav>no</nav><article class=b>two</article>", f"{LONG} two"),
    (f"<article>{LONG}<article class=comment>no</article></article><article class='teaser'>no</article>", LONG),
    (f"<body><form id=aspnet><nav>no</nav><h1>Head</h1><article>{LONG}</article><footer>no</footer></form>", LONG),
    (f"<body><form><h1>Head</h1><p>{LONG}</p><div class=sidebar>no</div></form>", f"Head {LONG}"),
    (f"<article>{LONG}<form>Your name and mail <input></form></article>", LONG),
    ("".join(f"<div class='{c}'>{PROSE}</div>" for c in ("social-history", "tags-of-war", "related-work", "notice-board")), " ".join([PROSE] * 4)),
    (f"<article>{LONG}<div class='related-posts-grid'><a href=x>{PROSE}</a></div><div class='newsletter-hook'>Join us</div></article>", LONG),
    (f"<article>{LONG}<div class='related'>{LONG}</div><div class='ad-slot'>{LONG}</div><div id='siteFooter footer'>no</div></article>", LONG),
    ("<div class=notice>only this</div>", "only this"),
    (f"<article><header><h1>goes with its header</h1></header>{LONG}</article>", LONG),
    ("<div class=comments>no</div>", ""),
])
def test_what_surrounds_an_article(page, want):
    assert extract(page, []) == want
    nodes = html_text.parse(page)
    paths = [html_text.path_of(n) for n in html_text.best(nodes)]
    assert extract(page, paths) == want  # a page doesn't change with its host's size


class Tree(HTMLParser):
    """A plain tree (path, words below, text below, children) of well-formed pages of div and p."""

    def __init__(self):
        super().__init__()
        self.root = self.at = {"path": "body", "up": None, "down": [], "text": []}

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            step = ".".join(["div", *sorted(c for c in dict(attrs).get("class", "").split() if not re.search(r"\d", c))])
            node = {"path": self.at["path"] + "/" + step, "up": self.at, "down": [], "text": []}
            self.at["down"].append(node)
            self.at["text"].append(node)
            self.at = node

    def handle_endtag(self, tag):
        if tag == "div":
            self.at = self.at["up"]

    def handle_data(self, data):
        self.at["text"].append(data)


def said(node):
    return " ".join(" ".join(x if isinstance(x, str) else said(x) for x in node["text"]).split())


def every(node):
    return [node, *[x for d in node["down"] for x in every(d)]]


def plain_consensus(rows, share):
    """Votes, winners and texts by dictionaries, for pages whose containers have no telling names."""
    trees, votes, hosts = {}, {}, {}
    for page_id, host, page in rows:
        reader = Tree()
        reader.feed(page)
        trees[page_id] = reader.root
        now = reader.root
        size = lambda n: len(said(n).split())
        while now["down"] and 10 * size(fullest := max(now["down"], key=size)) >= 7 * size(now) and size(fullest):
            now = fullest
        reader.root["own"] = now
        if host:
            hosts[host] = hosts.get(host, 0) + 1
            total = votes.setdefault(host, {}).setdefault(now["path"], [0, 0])
            total[0] += round(1000 * size(now) / size(reader.root)) if size(reader.root) else 0
            total[1] += 1
    out = {}
    for page_id, host, _ in rows:
        winners = sorted(((-w, p) for p, (w, n) in votes.get(host, {}).items() if n > 1 and n * share >= hosts[host]), key=lambda x: x[0])
        texts = [" ".join(filter(None, (said(n) for n in every(trees[page_id]) if n["path"] == p))) for _, p in winners]
        out[page_id] = next((t for t in texts if t), said(trees[page_id]["own"]))
    return out


@pytest.mark.parametrize("share", [1000, 4])
def test_votes_and_winners_match_a_plain_version(spark, share):
    rng = random.Random(share)
    word = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = []
    for i in range(160):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        template = rng.choice(["lead", "lead", "tale1 deep", "odd", f"gen{i}"])
        blocks = [f"<div class='{template}'><p>page {i} {word(rng.choice([3, 30, 31, 60]))}</p></div>", f"<div class='teasers'><p>{word(rng.choice([2, 9, 40]))}</p></div>"]
        rng.shuffle(blocks)
        inner = "".join(blocks)
        rows.append((i, host, f"<body><div class='outer x{i}'>{inner}</div><div class='end'>{word(rng.randrange(4))}</div></body>" if rng.random() < 0.5 else f"<body>{inner}</body>"))
    df = spark.createDataFrame([(i, host and f"https://{host}.example/{i}", page) for i, host, page in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in main_text(df, share=share).collect()}
    want = plain_consensus(rows, share)
    assert got == want
    assert got != plain_consensus(rows, 10**9 if share == 4 else 0)  # the bound, and the winners, matter


def test_depth_has_no_end():
    inner = "<div>" * 5000
    page = f"{inner}<div class=lead><p>{PROSE}</p></div><div class=other><p>side</p></div>"
    nodes = parse(page)
    path = html_text.path_of(next(n for n in nodes if n.step == "div.lead"))
    assert extract(page, [path]) == PROSE and html_text.paths_of(nodes).count(path) == 1


def test_every_template_of_a_host_wins(spark, monkeypatch):
    # alone, the teaser would win every last page of a template
    page = lambda t, i, prose: f"<body><div class='teaser{t}'><p>{PROSE * 4}</p></div><div class='lead{t}'><p>page {i} {prose}</p></div>"
    names = ["a", "b", "c", "d", "e", "f"]
    rows = [(t * 10 + i, "http://a.example/x", page(n, i, PROSE * 20 if i < 3 else "short")) for t, n in enumerate(names) for i in range(4)] + [(99, None, page("a", 9, "short"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert [got[t * 10 + 3] for t in range(6)] == ["page 3 short"] * 6 and got[99].startswith(PROSE)
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", 0)
    assert {r.page_id: r.text for r in main_text(df).collect()} == got


def test_consensus_of_host(spark):
    good = [f"<body><div class='teaser'><p>{PROSE}</p></div><div class='c{i}x lead'><p>page {i} {PROSE} {PROSE} {PROSE} {PROSE}</p></div>" for i in range(9)]
    # alone, the longer teaser would win this page
    odd = f"<body><div class='teaser'><p>{PROSE * 9}</p></div><div class='c77x lead'><p>odd one</p></div>"
    rows = [(i, "http://a.example/x", p, "h") for i, p in enumerate([*good, odd])] + [(20, None, odd, "h"), (21, "nothing", None, None), (22, "http://b.example", "", "h"), (22, "http://b.example", "", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(df).collect())
    assert got[9][1] == "odd one"
    assert got[10][1].startswith(PROSE)
    assert [g[1:] for g in got[11:]] == [("", 0)] * 3
    assert all(g[2] == len(g[1]) for g in got)
    assert main_text(df.filter("false")).collect() == []


def test_matches_plain_reading(spark):
    """On the synthetic pages the article element is known: compare with a direct reading of it."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert set(got) == set(rows)
    for page_id, page in rows.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|br)>", article)
        assert got[page_id] == " ".join(" ".join(unescape(re.sub(r"<[^>]*>", "", b)) for b in blocks).split())


def test_outside_nodes_hold_nothing():
    assert not any(n.blocks for n in parse(HARD) if n.outside)
