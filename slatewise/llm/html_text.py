"""Main text of web pages by consensus of each host.

Pages of one host share a template. Every container of a page (an element that can hold an article)
is scored by its text, its links and the words its tag, class and id are made of; the best one of a
page votes for its generalised path, the tags and classes from the root with digits made N. Votes
are counted per host in Spark, and pages are extracted again from the winning path of their host. A
page without an element at that path uses its own best container.

Parsing is a tokenizer over the page with a stack of open elements, as forgiving as browsers are with
missing end tags. The vote table has one row per host and is written. Where it is small, by its measured
size, it is broadcast and no page moves. Else the pages of hosts with very many pages, of which there can
only be few, meet their rows by a broadcast, and those of all others by a join on the host.

Inside the winning container only what isn't the article goes. Elements that are menus, headers, footers,
sidebars or forms by their tag, role or a hidden state go, and so do adverts, sidebars, navigation and reader comments by
their class or id. Names that an article may use itself (menu, notice, footer, promotion, ...) only raise a doubt, which
the element's own text settles when it ends: lists and tables go if most of their text is links, a block with such a
whole name if it has less than SHORT characters outside links, a block with such a part of a name if most of it is links.
Paragraphs, headings, cells and figures of such names stay. A button's word in a paragraph stays.

Time and memory grow with a page, however deep it is or however many of its elements never end: sums are kept once
and not in every open element, an element holds its own part of its path alone, and below DEPTH levels
elements are not told apart.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import saved, table
from slatewise.shipping import ship

#: Bytes of a vote table that is broadcast; pages of a host that has a broadcast row of its own, and how many such hosts there can be.
BROADCAST = 32 << 20
MANY_PAGES, MANY_HOSTS = 1_000_000, 10_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body div main section td".split())
_NEVER = frozenset("nav header footer aside form button select option menu dialog head noscript object canvas audio video svg iframe".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of names that tell what isn't the article, and names of the same kind that are told by two parts.
_GONE = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs newsletter pagination gdpr masthead".split())
_READERS = frozenset("comment comments disqus responses replies respond".split())
_DOUBTED = frozenset(
    "menu footer banner notice notices promo promos promotion promotions widget widgets consent cookie cookies related share sharing social subscribe signup login popup toolbar pager skip recommended".split()
)
_PAIRED = (frozenset("cookie cookies privacy".split()), frozenset("banner notice consent bar popup message overlay policy".split()))
_SITE_HEADER = frozenset("header site-header page-header".split())
#: Elements that such names can remove, and those of them that are lists.
_LISTS = frozenset("ul ol dl table menu".split())
_BLOCKS = _LISTS | frozenset("div section span".split())
SHORT, DEPTH = 200, 512
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body|page)(?:$|[\s_-])", re.I)
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_DIGITS = re.compile(r"\d+")


class _Element:
    __slots__ = ("tag", "above", "part", "depth", "away", "doubt", "text", "links", "paragraphs", "score", "start", "end", "containers")

    def __init__(self, tag: str, above: _Element | None, part: str, away: bool, doubt: int):
        self.tag, self.above, self.part, self.away, self.doubt = tag, above, part, away, doubt
        self.depth = above.depth + bool(part) if above else 0
        self.text = self.links = self.paragraphs = self.start = self.containers = 0
        self.end = -1
        self.score = 0.0

    def parts(self) -> list[str]:
        """Parts of the path, from the element up; inline elements have none."""
        out, e = [], self
        while e is not None:
            if e.part:
                out.append(e.part)
            e = e.above
        return out

    @property
    def path(self) -> str:
        return "".join(f"/{p}" for p in reversed(self.parts()))


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTR.findall(raw)} if raw.strip() else {}


WHOLE, PART = 1, 2


def _standing(tag: str, attrs: dict[str, str], in_article: bool, in_paragraph: bool) -> tuple[bool, int]:
    """Whether an element is no part of an article, and what its name says against it: 0, WHOLE or PART."""
    if tag in _NEVER:
        return not (tag == "header" and in_article or tag == "button" and in_paragraph), 0
    if not attrs:
        return False, 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES:
        return True, 0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True, 0
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if tag not in _BLOCKS:
        return tag == "p" and not _GONE.isdisjoint(names), 0
    doubt = 0
    for name in names:
        parts = set(_PARTS.split(name))
        if not _GONE.isdisjoint(parts) or not _READERS.isdisjoint(parts) or all(not p.isdisjoint(parts) for p in _PAIRED):
            return True, 0
        if name in _DOUBTED or name in _SITE_HEADER and not in_article:
            doubt = WHOLE
        elif not doubt and not _DOUBTED.isdisjoint(parts):
            doubt = PART
    return False, doubt


_PARTS = re.compile(r"[-_]")


def parse(page: str) -> tuple[list[str], list[_Element]]:
    """Text events of a page and its containers.

    Events are texts that are kept, each with the place where its block starts: (block number, text).
    """
    events: list = []  # (block, text)
    root = _Element("html", None, "", False, 0)
    stack, found = [root], [root]
    block = at = text = links = 0  # text, links: characters so far; an element has what came while it was open
    is_open: dict[str, int] = {}
    deeper: dict[str, int] = {}

    def put(raw: str) -> None:
        nonlocal text, links
        if not raw or stack[-1].away:
            return
        events.append((block, raw))
        n = len(raw.strip())
        if n:
            text += n
            if any(e.tag == "a" for e in stack[-4:]):
                links += n
            if any(e.tag == "p" for e in stack[-3:]):
                for e in stack[-5:]:
                    e.paragraphs += n

    def close(down_to: int) -> None:
        nonlocal text, links
        while len(stack) > down_to:
            e = stack.pop()
            is_open[e.tag] -= 1
            own, linked = text - e.text, links - e.links
            if e.doubt and not e.away and (linked * 2 >= own if e.doubt == PART or e.tag in _LISTS else own - linked < SHORT):
                del events[e.start :], found[e.containers :]
                text, links = e.text, e.links
                for outer in stack[-4:]:
                    outer.paragraphs = max(0, outer.paragraphs - e.paragraphs)
            e.text, e.links, e.end = own, linked, len(events)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            put(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in _BLOCK:
                block += 1
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            if not is_open.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK:
                    break  # an inline end tag doesn't reach over blocks
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in _BLOCK:
            block += 1
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in _BLOCK:
                k -= 1  # inline elements don't reach into the next block
            if stack[k].tag == "p":
                close(k)
            if tag in _CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _CLOSED_BY[tag]:
                        close(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "select"):
                        break
        if tag in _VOID or (m["attrs"] or "").endswith("/") and tag not in _BLOCK:
            continue
        if len(stack) > DEPTH:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        attrs = _attributes(m["attrs"] or "")
        top = stack[-1]
        away, doubt = _standing(tag, attrs, bool(is_open.get("article")), any(e.tag == "p" for e in stack[-3:]))
        part = tag + "".join(f".{c}" for c in sorted(_DIGITS.sub("N", attrs.get("class", "")).replace("/", "_").split())) if tag in _BLOCK else ""
        e = _Element(tag, top, part, top.away or away, doubt)
        e.start, e.containers, e.text, e.links = len(events), len(found), text, links
        stack.append(e)
        is_open[tag] = is_open.get(tag, 0) + 1
        if tag in _CONTAINER and not e.away:
            found.append(e)
            e.score = 1.0 if _GOOD.search(f"{attrs.get('class', '')} {attrs.get('id', '')} {tag}") else 0.0
    if at < len(page) and not page.startswith("<", at):
        put(html.unescape(page[at:]))
    close(1)
    root.text, root.links, root.end = text, links, len(events)
    return events, found


def scores(found: list[_Element]) -> list[float]:
    """A score for each container: text outside links, more so in paragraphs, and for telling names; wide ones lose to those inside."""
    whole = max(1, found[0].text)
    out = []
    for e in found:
        own = (e.text - 2 * e.links) / whole
        out.append(own + 0.3 * e.paragraphs / whole + {"article": 0.5, "main": 0.4}.get(e.tag, 0.2 * e.score) * own + 0.01 * min(e.depth, 30))
    return out


def best_path(page: str) -> str | None:
    """The generalised path that a page votes for; none without text."""
    _, found = parse(page)
    if not found[0].text:
        return None
    points = scores(found)
    return found[max(range(len(found)), key=lambda k: (points[k], -k))].path


def text_at(page: str, path: str | None) -> str:
    """The blocks under the elements at a path, or under the page's best container where there is none with text."""
    events, found = parse(page)
    parts = (path or "").split("/")[:0:-1]
    chosen = [e for e in found if e.depth == len(parts) and e.text and e.parts() == parts] if path is not None else []
    if not chosen:
        points = scores(found)
        chosen = [found[max(range(len(found)), key=lambda k: (points[k], -k))]]
    lines: list[str] = []
    done = 0
    for e in chosen:
        if e.end <= done:
            continue  # inside one that is out already
        now, parts = None, []
        for b, text in events[max(e.start, done) : e.end]:
            if b != now:
                lines.append(" ".join("".join(parts).split()))
                now, parts = b, []
            parts.append(text)
        lines.append(" ".join("".join(parts).split()))
        done = e.end
    return "\n".join(x for x in lines if x)


def host_of(url) -> F.Column:
    """Lower-case host without port; empty for null or none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, pages: the path with most votes among each host's pages, the smaller path at a tie, and how many voted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_path(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])

    voted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string").where("path IS NOT NULL")
    votes = voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"), F.sum("votes").alias("pages"))


def with_paths(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """pages (host and others) with the path of their host, null without one. winners: a written table of host, path, pages."""
    rows = winners.select("host", "path")
    size, every = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.sum("pages")).head()
    if (size or 0) <= BROADCAST:
        return pages.join(F.broadcast(rows), "host", "left")
    least = max(MANY_PAGES, every // MANY_HOSTS)  # no more than MANY_HOSTS hosts can have more pages than that
    many = F.broadcast(winners.where(F.col("pages") > least).select("host", "path"))
    others = pages.join(many.select("host"), "host", "left_anti").join(rows.hint("merge"), "host", "left")
    return pages.join(many, "host").unionByName(others)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Null or empty html gives an empty text; so does a page whose whole text is boilerplate. A null url
    belongs to the host "". At tied votes the smaller path wins. Repeated rows give repeated results and
    vote each; an empty table gives no rows. Other columns are not looked at.
    """
    ship(pages.sparkSession)
    joined = with_paths(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), saved(host_paths(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_at(h.as_py() or "", p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted() over all pages."""
    return extracted(table(spark, sf_dir, "pages"))
