"""Main text of web pages by consensus host paths.

Pass one reads each page into blocks of text under generalised container
paths (tags and classes, digits and long hashes levelled), scores the
containers and casts one vote for the best. Votes are counted per host and
path (partial sums, so a host with a third of all pages costs nothing).
Pass two reads each page again and takes all blocks under the host's highest
ranked path that the page has, or under its own best container if it has
none of them.

Boilerplate (menus, page headers and footers, side bars, notices, adverts,
forms, comments, scripts, styles) is left out by tag, role and, of boxes, by
class or id words. Where such a word may as well be the article's own (an id, a
table row of class "header"), the element is left out of the vote and of whole
bodies, and stays in a container that the vote chose around it.

Defined results: null or empty html gives an empty text; a page without a
host votes among the pages without one; broken markup is read on; repeated
rows are extracted each; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tricklens.llm.common import private_names, stored

# What follows a tag's name, up to its end: quotes count after an equals sign only, as HTML reads them.
REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|noscript|template|iframe|svg|object|xmp|annotation|annotation-xml)(?![^\s/>]){REST}>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+>?"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({REST})>"
    r"|</?[a-zA-Z].*\Z",  # a tag that never ends (a quote left open) takes the rest of the page, as in HTML
    re.S | re.I,
)
# One whole attribute, as HTML reads it: a name up to white space, / or =, then perhaps a value. The first of a name counts.
ATTRIBUTE = re.compile(r"([^\s/=>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary address legend".split())
CONTAINERS = frozenset(
    "html body div article main section header footer nav aside form fieldset table thead tbody tfoot tr ul ol dl figure details center menu dialog".split()
)
CLOSED_BY = {  # an open element of the key's kind ends where one of these starts
    "p": LEAVES | CONTAINERS | {"hr"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What makes an element boilerplate: its tag, its role, or a word of its class or id.
DROPPED_TAGS = frozenset("head nav footer aside form button select dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc "
    "header masthead footer sidebar aside rail widget "
    "comment comments commentlist respond disqus discussion replies "
    "notice notices cookie cookies consent gdpr alert popup modal overlay paywall "
    "share sharing social related recommended newsletter subscribe signup login search form tags".split()
)
# Boxes that are named after what they are for; tables, lists' items and paragraphs are named after what they say.
BOXES = frozenset("div ul ol dl figure details center".split())
# A class may also name a part of the article so, an id a heading's anchor.
UNSURE_CLASSES = frozenset("header discussion".split())
SURE_IDS = frozenset("ad ads advert advertisement adsense comments commentlist respond disqus sidebar footer masthead navbar breadcrumbs cookie cookies gdpr newsletter".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LEVELLED = re.compile(r"[0-9a-f]{8,}|\d+", re.I)

DESCEND = 0.7  # share of the text that a container must hold for its parent to give way
RANKED = 16  # paths of a host that every task of pass two knows; pages with none of them get their path by a join


class Block:
    """One run of text: its container path, its text, how much of it is links, and whether it is a top heading.

    ``section`` is the path of the outermost element around it that is named like boilerplate: the block
    belongs to a container around that element, and to nothing else.
    """

    __slots__ = ("path", "text", "linked", "heading", "section")

    def __init__(self, path: str, text: str, linked: int, heading: bool, section: str):
        self.path, self.text, self.linked, self.heading, self.section = path, text, linked, heading, section


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return found


def dropped(tag: str, at: dict[str, str], in_article: bool) -> bool:
    """Whether an element is boilerplate wherever it stands."""
    if tag in DROPPED_TAGS or (tag == "header" and not in_article) or at.get("role", "").strip().lower() in DROPPED_ROLES:
        return True
    if "hidden" in at or at.get("aria-hidden", "").strip().lower() == "true":
        return True
    classes, sure = at.get("class", ""), DROPPED_WORDS - UNSURE_CLASSES
    if tag in BOXES:
        return any(w.lower() in sure for w in WORD.findall(classes)) or any(w.lower() in SURE_IDS for w in WORD.findall(at.get("id", "")))
    # Of a paragraph, an item or a cell, a whole class only: "ad", but not "social-studies".
    return tag in LEAVES and tag not in HEADINGS and any(c.lower() in sure for c in classes.split())


def named(tag: str, at: dict[str, str]) -> bool:
    """Whether a word of the class or id names boilerplate: then it is none of the page's text, unless it stands in the article."""
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    return any(w.lower() in DROPPED_WORDS for w in WORD.findall(f"{at.get('class', '')} {at.get('id', '')}"))


def step(tag: str, at: dict[str, str]) -> str:
    names = sorted({LEVELLED.sub("#", c) for c in at.get("class", "").lower().replace("/", "").split()})
    return ".".join([tag, *names])


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, boilerplate left out."""
    found: list[Block] = []
    stack: list[tuple[str, str | None, bool, str]] = []  # tag, path if a container, whether dropped, element named like boilerplate
    text: list[str] = []
    linked = depth_a = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                path = next((p for _, p, _, _ in reversed(stack) if p), "body")
                found.append(Block(path, words, min(linked, len(words)), bool(stack) and stack[-1][0] == "h1", stack[-1][3] if stack else ""))
            text.clear()
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part and not (stack and stack[-1][2]):
            part = entities.unescape(part) if "&" in part else part
            text.append(part)
            if depth_a:
                linked += len(part)

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            depth_a = 0 if m[2] else 1
        elif tag in VOID or tag not in LEAVES and tag not in CONTAINERS and tag not in DROPPED_TAGS:
            if tag == "hr":
                flush()
        elif m[2]:  # an end tag closes the nearest open element of its kind, and all within it
            if any(t == tag for t, _, _, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
                depth_a = 0
        else:
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            inside = next((p for _, p, _, _ in reversed(stack) if p), "")
            attrs = attributes(m[4]) if m[4] else {}
            out = bool(stack) and stack[-1][2] or dropped(tag, attrs, "/article" in inside)
            if tag == "body":
                stack = [x for x in stack if x[0] == "html" and not x[2]]
                inside, out = "", False
            path = None
            if tag in CONTAINERS and tag != "html":
                path = f"{inside or 'body'}/{step(tag, attrs)}" if tag != "body" else "body"
            section = stack[-1][3] if stack else ""
            if not section and "/article" not in inside and attrs and named(tag, attrs):
                section = path or f"{inside or 'body'}/{step(tag, attrs)}"
            stack.append((tag, path, out, section))
            depth_a = 0
    say(page[at:])
    flush()
    return found


def best_path(found: list[Block]) -> str | None:
    """The container that holds the page's own text: from the body down, while one child holds nearly all of it."""
    score: dict[str, int] = {}
    headings: dict[str, int] = {}
    found = [b for b in found if not b.section]
    for b in found:
        parts = b.path.split("/")
        for i in range(1, len(parts) + 1):
            p = "/".join(parts[:i])
            score[p] = score.get(p, 0) + len(b.text) - b.linked
            headings[p] = headings.get(p, 0) + b.heading
    if not found:
        return None
    best = "body"
    while not best.rpartition("/")[2].startswith("article"):
        children = [p for p in score if p.rpartition("/")[0] == best]
        child = max(children, key=lambda p: (score[p], p), default=None)
        if child is None or score[child] < DESCEND * score.get(best, 0) or headings[child] < headings.get(best, 0):
            break
        best = child
    return best


def under(found: list[Block], path: str) -> list[Block]:
    """The blocks of a container; those of an element named like boilerplate only if the container is around it and not the body."""
    inside = path + "/"
    return [b for b in found if (b.section.startswith(inside) and path != "body" if b.section else b.path == path or b.path.startswith(inside))]


def own_paths(found: list[Block]) -> set[str]:
    """All containers that hold a block of the page."""
    out: set[str] = set()
    for b in found:
        path = b.path if not b.section else b.section.rpartition("/")[0]
        while path and path not in out and not (b.section and path == "body"):
            out.add(path)
            path = path.rpartition("/")[0]
    return out


def digest(path: str) -> bytes:
    return hashlib.md5(path.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def digested(path: Column) -> Column:
    """``digest`` as an SQL function."""
    return F.unhex(F.md5(path.cast("binary")))


VOTES = "host string, page string, path string, chars long, own array<binary>"


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [], [])
        for host, name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = blocks(page.as_py())
            path = best_path(found)
            if path is not None:
                row = (host, name, path, sum(len(b.text) for b in under(found, path)), [digest(p) for p in own_paths(found)])
                for column, value in zip(out, row):
                    column.append(value)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "page", "path", "chars", "own"])


def tallied(voted: DataFrame) -> DataFrame:
    """(host, path, order): how each host's paths rank, by pages that voted for them; the least order ranks first."""
    tally = voted.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
    return tally.select("host", "path", F.struct((-F.col("pages")).alias("p"), (-F.col("chars")).alias("c"), "path").alias("order"))


def first_paths(tally: DataFrame) -> DataFrame:
    """(host, paths): each host's first ``RANKED`` paths in order. Of a host's other paths each task drops its own before any shuffle."""
    rank = F.row_number().over(W.partitionBy("host").orderBy("order")).alias("rank")
    first = tally.select("host", "path", rank).where(F.col("rank") <= RANKED)
    return first.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def odd_pages(voted: DataFrame, first: DataFrame) -> DataFrame:
    """(host, page, own) of the pages that have none of their host's first paths, on hosts that have more."""
    keyed = first.where(F.size("paths") == RANKED).select(F.col("host").alias("of"), F.transform("paths", digested).alias("first"))
    met = voted.join(keyed, F.col("host") == F.col("of"))
    return met.where(~F.arrays_overlap("own", "first")).select("host", "page", "own").distinct()


def late_paths(odd: DataFrame, tally: DataFrame) -> DataFrame:
    """(late_host, late_page, late_path): the best ranked path of each odd page, among all paths of its host."""
    own = odd.select("host", "page", F.explode("own").alias("key"))
    hosts = odd.select(F.col("host").alias("odd_host")).distinct()
    known = tally.join(hosts, F.col("host") == F.col("odd_host"), "left_semi")
    best = own.join(known.select("host", "order", digested(F.col("path")).alias("key")), ["host", "key"]).groupBy("host", "page").agg(F.min("order").alias("best"))
    return best.select(F.col("host").alias("late_host"), F.col("page").alias("late_page"), F.col("best.path").alias("late_path"))


def main_text(page: str, paths: list[str]) -> str:
    found = blocks(page)
    own = next((b for b in (under(found, p) for p in paths) if b), None)
    if own is None:
        best = best_path(found)
        own = under(found, best) if best else []
    return "\n\n".join(b.text for b in own)


def extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without their html, with ``text`` (its main text) and ``n_chars`` (its code points)."""
    host, paths, late = private_names(pages, "host_", "paths_", "late_")
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    hosted = pages.withColumn(host, name).withColumn(html, F.coalesce(F.col(html), F.lit("")))
    page = F.sha2(F.col(html), 256)
    voted = stored(hosted.select(host, page.alias("page"), html).mapInArrow(votes, VOTES), "page-votes")
    tally = stored(tallied(voted), "path-votes")
    # Written once: its true size lets Spark broadcast a short list and split a hot host of a long one.
    first = stored(first_paths(tally), "host-paths")
    winners = first.withColumnsRenamed({"host": f"{host}w", "paths": paths})
    joined = hosted.join(winners, F.col(host) == F.col(f"{host}w"), "left").drop(f"{host}w")
    # Few pages have none of their host's first paths; only they, if any, move to their own path.
    odd = stored(odd_pages(voted, first), "odd-pages")
    others = stored(late_paths(odd, tally), "late-paths").withColumnsRenamed({c: f"{late}{c}" for c in ("late_host", "late_page", "late_path")})
    if others.isEmpty():
        joined = joined.drop(host)
    else:
        joined = joined.join(others, (F.col(host) == F.col(f"{late}late_host")) & (page == F.col(f"{late}late_page")), "left")
        one = F.when(F.col(f"{late}late_path").isNotNull(), F.array(f"{late}late_path")).otherwise(F.col(paths))
        joined = joined.withColumn(paths, one).drop(host, *others.columns)
    kept = [f for f in pages.schema if f.name not in (html, "text", "n_chars")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "`text` string", "`n_chars` long"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [p or [] for p in batch.column(paths).to_pylist()]
            texts = [main_text(page.as_py(), p) for page, p in zip(batch.column(html), known)]
            columns = [batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    names = [f.name for f in kept]
    return joined.select(*names, html, paths).mapInArrow(read, fields)
