"""HTML main-text extraction by consensus host paths.

First pass: every page is cut into containers, each with a score for the prose that it holds. A container's path is
generalised: tags and classes from the body down, digits and generated parts left out, so pages of a template agree; it
is known by a digest, so a page of any depth costs as much as its length. The pages of a host vote in Spark: a page
gives its best container's path one vote, weighted by the container's share of the page's prose. The host's winning
paths, best first, are joined back, and every page is extracted again below the first of them that it has; a page with
none of them, and a page without a host, uses its own best container.

What surrounds an article goes: elements that say so by their tag (a header in the article too, with what it holds),
and those whose class, identifier or role consists of words that do. A name that only contains such a word, as
"related-work" does, is a doubt: its element goes if links make up half of its words, or it has under FEW words. No list
empties a page: a form that holds more prose than the rest of the page is its frame and no form, and where nothing is
left the names don't count. Of several article elements all are taken.

Markup is read as browsers read it: attributes in quotes may hold any character, a quote elsewhere is text, a slash in
an unquoted value belongs to it, stray end tags close nothing around them. Reading takes time linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.staging import bound_batches, stage

#: A path wins if two pages of its host at least, and one in SHARE, voted for it; so a host has at most twice SHARE of them
#: where pages have one article. It bounds what a host's pages carry along; a template with a smaller share of a large
#: host is read page by page.
SHARE = 1000
#: Words below which an element of a doubtful name goes.
FEW = 8
#: Winning paths that are broadcast (about 100 bytes each); beyond it the pages are shuffled by host.
BROADCAST_PATHS = 200_000

#: Elements whose content is raw text up to their end tag, and never part of the prose.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
#: Elements of other languages, in which a slash ends an element, and those of a page that end them.
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset("body blockquote center div dl dt h1 h2 h3 h4 h5 h6 li main article section nav footer ol p pre table ul".split())
#: Elements that a page's head can hold.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What a start tag of a table's parts ends, up to the table around it.
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody"), "thead": ("td", "th", "tr", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the article.
OUTSIDE = frozenset("aside button dialog footer form head header input math menu nav object search select svg template".split())
#: Elements that can hold the article.
HOLDERS = frozenset("article body center div main section table tbody td tr".split())
#: Words of a class, identifier or role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox banner billboard breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright disqus disclaimer "
    "dialog footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup popular promo promoted "
    "promotion related recommended recommendations respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets "
    "complementary contentinfo alert".split()
)
#: Those of them that say little beside a word of GOOD.
WEAK = frozenset("header hidden login notification overlay social tags text widget widgets".split())
#: Those that count for an article or main element too.
STRONG = frozenset("ad ads adv advert adverts comment comments promo promoted related recommended sponsored teaser".split())
#: Words that say nothing about what a name with a word of MARKS marks.
NEUTRAL = frozenset(
    "above area aside bar below block bottom box button buttons center col column container content desktop fixed global group holder icons id inline inner item items js label left line link links list "
    "main mobile module new outer page panel primary right row secondary section site slot small sticky text title top unit wrap wrapper".split()
)
#: Words of a class or identifier that mark an article's container.
GOOD = frozenset("article articlebody body content entry main mainbody post story text".split())

TAG = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*")
GAP = re.compile(r"[ \t\n\f\r/]*")
NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
VALUE = re.compile(r"[^ \t\n\f\r>]*")
COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    step: str
    parent: Node | None
    outside: bool
    good: bool = False
    doubt: bool = False
    blocks: list[tuple[int, str]] | None = None
    prose: int = 0  # words outside links, those of the nodes below included once a page is read
    links: int = 0  # words in links, likewise


def generalised(tag: str, classes: str) -> str:
    """A step of a path: the tag and its classes, in order, without those that hold digits."""
    return ".".join([tag, *sorted({c.lower() for c in classes.split() if not any(x.isdigit() for x in c)})])


def below(path: str, step: str) -> str:
    """The digest of a path that goes on by a step."""
    return blake2b(f"{path}/{step}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def path_of(node: Node) -> str:
    steps = []
    while node is not None:
        steps.append(node.step)
        node = node.parent
    path = ""
    for step in reversed(steps):
        path = below(path, step)
    return path


def paths_of(nodes: list[Node]) -> list[str]:
    """The paths of all nodes, parents standing before their children."""
    known: dict[int, str] = {}
    for node in nodes:
        known[id(node)] = below(known[id(node.parent)] if node.parent is not None else "", node.step)
    return [known[id(node)] for node in nodes]


def surrounds(tag: str, attributes: dict[str, str], names: bool = True, forms: bool = True) -> tuple[bool, bool, bool]:
    """(an element that surrounds the article, one whose name leaves that in doubt, one named as the article's container).
    Without ``names`` only those of STRONG count, without ``forms`` a form is a container."""
    if tag in ("html", "body"):
        return False, False, False
    tokens = [{w.lower() for w in SPLIT.split(t) if w} for a in ("class", "id", "role") for t in attributes.get(a, "").split()]
    good = tag in ("article", "main") or any(t & GOOD for t in tokens)
    marks = STRONG if tag in ("article", "main") or not names else MARKS - WEAK if good else MARKS
    clear = any(t & marks and t <= marks | NEUTRAL | GOOD for t in tokens)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    outside = hidden or clear or tag in OUTSIDE and (forms or tag != "form")
    return outside, not outside and any(t & marks for t in tokens), good


def attributes(page: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """(attributes, whether a slash ends the tag, the place after it) of a tag from behind its name; None if the page ends
    before the tag does. Of attributes with one name the first counts."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        gap = GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return None
        if page[at] == ">":
            return found, gap.group().endswith("/"), at + 1
        m = NAME.match(page, at)
        name, value, at = m.group().lower(), "", m.end()
        if equals := EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                m = VALUE.match(page, at)
                value, at = m.group(), m.end()
        found.setdefault(name, value)


class _Reader:
    """Open elements and blocks of a page that is being read."""

    def __init__(self, names: bool, forms: bool) -> None:
        self.names, self.forms = names, forms
        self.formed = 0  # words in forms
        self.body = Node("body", "body", None, outside=False)
        self.nodes = [self.body]
        # open elements that make a container or stand between it and another of their name
        self.stack: list[tuple[str, Node]] = []
        self.opened: dict[str, list[int]] = defaultdict(list)
        self.special: list[int] = []
        self.text: list[str] = []
        self.owner, self.link, self.linked, self.order = self.body, False, 0, 0

    def top(self) -> Node:
        return self.stack[-1][1] if self.stack else self.body

    def last(self, *tags: str) -> int:
        return max((self.opened[t][-1] for t in tags if self.opened.get(t)), default=-1)

    def push(self, tag: str, node: Node) -> None:
        self.opened[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.special.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self, length: int) -> None:
        while len(self.stack) > length:
            tag, _ = self.stack.pop()
            self.opened[tag].pop()
            if self.special and self.special[-1] == len(self.stack):
                self.special.pop()

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            if self.owner.blocks is None:
                self.owner.blocks = []
            self.owner.blocks.append((self.order, " ".join(words)))
            self.owner.prose += max(0, len(words) - self.linked)
            self.owner.links += self.linked
            self.order += 1
        self.text.clear()
        self.linked = 0

    def say(self, piece: str) -> None:
        if self.opened.get("head") and piece.strip():
            self.pop(self.opened["head"][0])
        now = self.top()
        if now.outside:
            self.formed += len(piece.split()) if now.tag == "form" else 0
            return
        if now is not self.owner:
            self.flush()
            self.owner = now
        self.text.append(piece)
        if self.link:
            self.linked += len(piece.split())

    def start(self, tag: str, found: dict[str, str], closed: bool) -> None:
        if self.opened.get("head") and tag not in HEAD:
            self.pop(self.opened["head"][0])
        if tag in BLOCKS and not self.top().outside:
            self.flush()
        if tag in ("html", "body") or tag in VOID:
            return
        if self.opened.get("svg") or self.opened.get("math"):
            if tag in BREAKOUT:
                self.pop(min(self.opened[t][0] for t in FOREIGN if self.opened.get(t)))
            elif closed:
                return
        elif closed and tag in FOREIGN:
            return
        if tag in ENDS and (at := self.last(*ENDS[tag])) > (table := self.last("table")):
            while (at := self.last(*ENDS[tag])) > table:
                self.pop(at)
        if tag == "a":
            self.link = True
        around = self.top()
        outside, doubt, good = surrounds(tag, found, self.names, self.forms)
        doubt = doubt and tag in BLOCKS  # a piece of a line is part of it
        if (tag in HOLDERS or tag == "form" or outside or doubt) and not around.outside:
            node = Node(tag, generalised(tag, found.get("class", "")), around, outside, good, doubt)
            self.nodes.append(node)
            self.push(tag, node)
        elif tag in HOLDERS or tag in ("th", "caption") or self.opened.get(tag):
            self.push(tag, around)

    def end(self, tag: str) -> None:
        if tag in BLOCKS and tag not in HOLDERS and tag not in OUTSIDE and not self.top().outside:  # whether these are open isn't known
            self.flush()
        if tag == "a":
            self.link = False
        if not self.opened.get(tag) or tag in ("body", "html"):
            return
        at = self.opened[tag][-1]
        if tag in ENDS:
            around = self.last("table")
        elif tag == "table":
            around = self.last("template")
        elif tag in BLOCKS or tag in FOREIGN:
            around = self.last("td", "th", "caption", "table", "template", "object")
        else:
            around = self.special[-1] if self.special else -1
        if at >= around:
            if tag in BLOCKS and not self.top().outside:
                self.flush()
            self.pop(at)


def parse(page: str) -> list[Node]:
    """The containers of a page in page order, the body first, each with the blocks (position, text) right in it."""
    nodes, formed = _parse(page, True, True)
    if formed > nodes[0].prose:
        framed, _ = _parse(page, True, False)
        if framed[0].prose > 2 * nodes[0].prose:
            nodes = framed
    return nodes if nodes[0].prose or nodes[0].links else _parse(page, False, False)[0]


def _parse(page: str, names: bool, forms: bool) -> tuple[list[Node], int]:
    """(containers, words in forms) of a page.

    Unclosed elements end with the element around them; what stands in a tag, comment or script that the page's end
    cuts off is no text.
    """
    read = _Reader(names, forms)
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            read.say(entities.unescape(page[at : lt if lt >= 0 else n]))
            if lt < 0:
                break
        at = lt + 1
        if page.startswith("!--", at):
            m = COMMENT.match(page, lt)
            if m is None:
                break
            at = m.end()
            continue
        closing = page.startswith("/", at)
        name = TAG.match(page, at + closing)
        if name is None:
            if page.startswith(("!", "?"), at) or closing and at + 1 < n:
                end = page.find(">", at)
                if end < 0:
                    break
                at = end + 1
            else:
                read.say("<")
            continue
        tag, at = name.group().lower(), name.end()
        if page.startswith(">", at):
            found, closed, at = {}, False, at + 1
        elif (rest := attributes(page, at)) is not None:
            found, closed, at = rest
        else:
            break
        if closing:
            read.end(tag)
            continue
        read.start(tag, found, closed)
        if tag in RAW and not (closed and (read.opened.get("svg") or read.opened.get("math"))):
            close = re.compile(rf"</{re.escape(tag)}(?=[ \t\n\f\r/>])[^>]*>", re.I).search(page, at)
            if close is None:
                break
            read.pop(read.opened[tag][-1]) if read.opened.get(tag) else None
            at = close.end()
    read.flush()
    for node in reversed(read.nodes):
        if node.doubt and (node.prose < FEW or node.links >= node.prose):
            node.outside = True
        if node.parent is not None and not node.outside:
            node.parent.prose += node.prose
            node.parent.links += node.links
    for node in read.nodes[1:]:  # parents stand before their children
        if node.outside or node.parent.outside:
            node.outside, node.blocks = True, None
    return read.nodes, read.formed


def articles(nodes: list[Node]) -> list[Node]:
    """A page's article elements with prose, or else its main elements."""
    for tag in ("article", "main"):
        named = [n for n in nodes if n.tag == tag and not n.outside and n.prose]
        if named:
            return named
    return []


def best(nodes: list[Node]) -> list[Node]:
    """The containers of a page's article: its article or main elements, else the fullest container so named that holds
    half of the prose, else the innermost one that holds most of what is around it."""
    if named := articles(nodes):
        return named
    inside = [n for n in nodes if not n.outside]
    body = inside[0]
    named = [n for n in inside if n.good and 2 * n.prose >= body.prose > 0]
    if named:
        return [min(named, key=lambda n: n.prose)]
    fullest: dict[int, Node] = {}
    for node in inside[1:]:
        if id(node.parent) not in fullest or node.prose > fullest[id(node.parent)].prose:
            fullest[id(node.parent)] = node
    now = body
    while True:
        next_ = fullest.get(id(now))
        if next_ is None or 10 * next_.prose < 7 * now.prose or not next_.prose:
            return [now]
        now = next_


def text_below(nodes: list[Node], roots: list[Node]) -> str:
    """The blocks in and below ``roots``, in page order."""
    chosen = {id(n) for n in roots}
    blocks = []
    for node in nodes:  # parents stand before their children
        if node.outside:
            continue
        if id(node) in chosen or node.parent is not None and id(node.parent) in chosen:
            chosen.add(id(node))
            blocks += node.blocks or ()
    return " ".join(text for _, text in sorted(blocks))


def extract(page: str, paths: list[str]) -> str:
    """The text below the first of ``paths`` that the page has with some text, else of its own best containers.

    Where that path is an article's, all articles of the page are meant, as they are without paths.
    """
    nodes = parse(page)
    if paths:
        wanted, held = set(paths), defaultdict(list)
        for node, path in zip(nodes, paths_of(nodes), strict=True):
            if path in wanted and not node.outside:
                held[path].append(node)
        for path in paths:
            if path not in held:
                continue
            own = articles(nodes)
            text = text_below(nodes, own if held[path][0] in own else held[path])
            if text:
                return text
    return text_below(nodes, best(nodes))


def _ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, shares = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes = parse(page)
            own: dict[str, int] = defaultdict(int)
            for chosen in best(nodes):
                own[path_of(chosen)] += chosen.prose
            for path, prose in own.items():
                hosts.append(host)
                paths.append(path)
                shares.append(prose / nodes[0].prose if nodes[0].prose else 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "share"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def consensus(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """(host, paths) from pages (host, html): each host's winning paths by their votes, ties by name.

    A path wins with two votes at least, and one in ``share`` of its host's. Votes are summed per (host, path) before paths of a host meet, and only winners are listed.
    """
    votes = pages.filter("host IS NOT NULL").mapInArrow(_ballots, "host string, path string, share double")
    counted = stage(votes.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("votes"), F.count("*").alias("n")), "host-votes")
    whole = counted.groupBy("host").agg(F.sum("n").alias("pages"))
    winners = counted.join(whole, "host").filter((F.col("n") > 1) & (F.col("n") * share >= F.col("pages")))
    ranked = winners.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path"))).alias("all"))
    return ranked.select("host", F.transform("all", lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: int = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``share`` is ``consensus``'.

    Null and empty pages have an empty text, as have pages without prose; a page whose address is null or has no host
    takes no part in votes. Repeated rows vote and return each. Other columns are ignored; an empty table gives no rows.
    """
    bound_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"), F.nullif(host, F.lit("")).alias("host"))
    winners = stage(consensus(rows.select("host", "html"), share), "host-paths")
    if (winners.agg(F.sum(F.size("paths"))).first()[0] or 0) <= BROADCAST_PATHS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # pages without a host stay where they are
        joined = rows.filter("host IS NOT NULL").join(winners, "host", "left").unionByName(rows.filter("host IS NULL").withColumn("paths", F.lit(None).cast("array<string>")))
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For the synthetic pages, whose article is an article element with few kinds of tags and references.
OP10_SQL = r"""
SELECT page_id, url, t AS text, length(t) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
"""
