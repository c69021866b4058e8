"""Main-text extraction with site style trees.

The element trees of all pages of a host are merged: elements with the same path of tags and classes are one node of
the host's style tree. Pages with the same text blocks count as one page, so copies repeat nothing. Over the m pages
that have a node:

* a content node (a text block at that path, found on k of the pages) has importance 1 - log k / log m: text that all
  pages repeat has 0, text of one page has 1;
* a presentation node (an element) has the entropy of its pages' sequences of child elements, to the base m, as its own
  importance. With c the mean importance of all content below and s its own, its composite importance is
  1 - (1 - c) * (1 - s): a branch is important by content that differs from page to page, or by its build.

Nodes that ``LEAST_PAGES`` pages have are judged, first of all. The measure is the host's main branch, the deepest one
with half of the host's text or more: a branch of a page is removed when its composite importance is more than ``GAP``
below that of the main branch. Text in adverts, menus and footers recurs now and then even where it is not the same on
all pages; an article's hardly does. A text block that most pages of its node repeat (importance under ``CUT``) is
removed as well. Within the main branch, and within article and main elements, nothing is removed for being repeated:
headings, lines and boxes that an article's pages share are its text. There only branches of low importance go that are
no text in themselves, with links for half of their characters or more. The elements that hold the article (and what is
above them) and branches with half of a page's text or more are never removed, nor are text blocks when they are half of
what the branches leave, so near copies of a page on one host don't lose their text.

Then markup, for what a tree can't know (a host with few pages, menus that differ on all of them): elements and roles
that mean navigation, notices, adverts, forms or comments go, and elements whose class or id says so with all of its
words (``FURNITURE_WORDS`` and neutral ones). Where a page marks its article, and that has half of the text that is
left, text outside of it goes unless the tree judged its node and found it important.

Pages are parsed in Arrow batches twice; between, only path, content and page hashes are counted, combined before the
shuffle. The verdicts are sent to the tasks where their number, which is counted, is at most ``BROADCAST_ROWS``; else
the pages' own nodes are joined with them, and what each page gets is bounded by its own nodes.

Defined results: a null or empty html gives an empty text, an empty table an empty table; a null url is a host of its own; broken markup is read as
browsers read it in the main (unclosed, stray and overlapping tags); ``br`` is white space; elements nested deeper
than ``DEEPEST`` levels count as their ancestor at that level in paths, their text stays; rows given twice come out
twice; a null ``page_id`` is kept; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm.common import checkpointed, table

#: How far a branch's importance may lie below the main branch's, and the importance below which a text block goes.
GAP, CUT = 0.05, 0.3
#: Pages of a host that must have a node before it is judged by the tree, and levels of elements that paths tell apart.
LEAST_PAGES, DEEPEST = 5, 60
#: Verdicts that are sent to all tasks.
BROADCAST_ROWS = 100_000

# Fixed values of the markup language, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
FURNITURE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist respond disqus reply replies pagination pager masthead toolbar widget widgets skip copyright".split()
)
#: Words that say nothing about what an element holds, beside words that do.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box buttons button column container content contents entry form global group header icons inner item items label layer left link links list "
    "module outer page panel post posts primary right row secondary section site slot small strip tag text title top unit view wrap wrapper zone".split()
)
#: Words that name readers' comments, and words of a class or id after which the rest describes the element.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies".split())
DESCRIBING = frozenset("no non not without has with".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that markup never condemns, and those that it doesn't condemn when they hold an article.
EXEMPT, WRAPPING = ARTICLE | {"html", "body"}, frozenset(["form", "header"])
#: What condemns an element: nothing, a class or id word, such a word for comments, its tag, role or hiding.
FREE, WORDS, COMMENTS, MARKUP = range(4)
#: Elements that are text blocks, not branches of a page.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
#: One attribute after the other, name and value, so that nothing is found inside another one's name or value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    rule: int
    article: bool
    depth: int
    parent: "Element | None"
    children: list
    #: The tag of an article or main element below, main first.
    holds: str = ""


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    #: Characters of it in links.
    linked: int = 0


def _named(value: str) -> set[str]:
    """The furniture words of a class or id, where a name has no other words than neutral ones: "ad-box" is named, "related-work" is not."""
    words = set()
    for name in value.split():
        mine = []
        for word in WORD.findall(name):
            if word in DESCRIBING:
                break
            mine.append(word)
        if all(word in FURNITURE_WORDS or word in NEUTRAL_WORDS for word in mine):
            words.update(FURNITURE_WORDS.intersection(mine))
    return words


def _described(tag: str, attributes: str) -> tuple[str, int]:
    """The element's name in paths, and by what its markup marks it as furniture."""
    name, rule, given = tag, MARKUP if tag in FURNITURE_TAGS else FREE, {}
    if not attributes or attributes.isspace():
        return name, rule
    for m in ATTRIBUTE.finditer(attributes):
        given.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    for kind, value in given.items():
        if kind in ("class", "id"):
            if words := _named(value):
                rule = max(rule, COMMENTS if words & COMMENT_WORDS else WORDS)
            name += ("." if kind == "class" else "#") + "-".join(WORD.findall(value))
        elif (kind == "role" and value in FURNITURE_ROLES) or kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            rule = MARKUP
    return name, FREE if tag in EXEMPT else rule


def parse(source: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    source = source or ""
    root = Element("", "", FREE, False, 0, None, [])
    now, blocks, parts, linked, link, at, end = root, [], [], 0, False, 0, len(source)

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            blocks.append(Block(now, text, linked))
        parts.clear()
        linked = 0

    def scope(tags: frozenset, until: frozenset) -> Element | None:
        """The nearest open element with one of ``tags``, not looking above ``until``."""
        e = now
        while e.parent is not None and e.tag not in until:
            if e.tag in tags:
                return e
            e = e.parent
        return None

    while at < end:
        m = TAG.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
            linked += len(parts[-1].strip()) if link else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                close = _CLOSE[tag].search(source, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = not closing
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            link = False
            if (e := scope(frozenset([tag]), frozenset())) is not None:
                now = e.parent
            continue
        if (e := scope(CLOSED_BY_BLOCK, frozenset("table button td th".split()))) is not None:
            now = e.parent
        if tag in SIBLINGS:
            while (e := scope(*SIBLINGS[tag])) is not None:
                now = e.parent
        name, rule = _described(tag, attributes)
        if tag == "header" and not now.article:
            rule = MARKUP
        now.children.append(tag)
        depth = now.depth + 1
        if tag in ARTICLE:
            above = now
            while above.parent is not None and above.holds not in (tag, "main"):
                above.holds, above = tag, above.parent
        now = Element(tag, f"{now.path}/{name}" if depth <= DEEPEST else now.path, rule, now.article or tag in ARTICLE, depth, now, [])
    flush()
    return blocks


def chain(element: Element) -> Iterator[Element]:
    """The element and those above it, without the root."""
    while element.parent is not None:
        yield element
        element = element.parent


def without_furniture(blocks: list[Block]) -> tuple[list[Block], bool]:
    """The blocks outside of furniture, and whether those in articles are the page's text.

    Class and id words are guesses: what they condemn stays if it holds the only article, or more than half of the
    text that is left without them (comments: all of it). An only article below such a word marks the page's text
    when it has more than half of it.
    """
    above: dict[int, list[Element]] = {}
    for b in blocks:
        if id(b.element) not in above:
            above[id(b.element)] = list(chain(b.element))
    sure = {id(e) for es in above.values() for e in es if e.rule == MARKUP and not (e.holds and (e.tag in WRAPPING or e.holds == "main"))}
    words = {id(e): e for es in above.values() for e in es if e.rule in (WORDS, COMMENTS) and e.holds != "main"}
    out = lambda b, gone: all(id(e) not in gone for e in above[id(b.element)])
    blocks = [b for b in blocks if out(b, sure)]
    articles = [b for b in blocks if b.element.article]
    if articles and not any(out(b, words) for b in articles):
        if sum(len(b.text) for b in articles) <= sum(len(b.text) for b in blocks) / 2:
            articles = []
        words = {k: e for k, e in words.items() if not e.holds}
    sizes: Counter = Counter()
    for b in articles or blocks:
        for e in above[id(b.element)]:
            sizes[id(e)] += len(b.text)
    most = sum(len(b.text) for b in articles or blocks) / 2
    words = {k: e for k, e in words.items() if e.rule == COMMENTS or sizes[k] <= most}
    if not any(out(b, words) for b in articles or blocks):
        words = {k: e for k, e in words.items() if sizes[k] <= most}
    blocks = [b for b in blocks if out(b, words)]
    inside = sum(len(b.text) for b in blocks if b.element.article)
    return blocks, bool(articles) and 2 * inside >= sum(len(b.text) for b in blocks)


def _digest(*parts: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def without_low(blocks: list[Block], low: frozenset[str], linked: frozenset[str], repeated: frozenset[int]) -> list[Block]:
    """The blocks outside of branches at ``low`` paths, and at ``linked`` ones if links are half of them, and without
    ``repeated`` ones, which digests of path and text name."""
    if (low or linked) and blocks:
        held = {b.element.path: [e.path for e in chain(b.element)] for b in blocks}
        sizes, links = Counter(), Counter()
        for b in blocks:
            for path in held[b.element.path]:
                sizes[path] += len(b.text)
                links[path] += b.linked
        # Branches with half of the text or more, which are those above the largest one and it, stay.
        most = sum(len(b.text) for b in blocks) / 2
        gone = {path for path, n in sizes.items() if n < most and (path in low or path in linked and 2 * links[path] >= n)}
        blocks = [b for b in blocks if gone.isdisjoint(held[b.element.path])]
    if repeated and blocks:
        new = [b for b in blocks if _digest(b.element.path, b.text) not in repeated]
        if 2 * sum(len(b.text) for b in new) > sum(len(b.text) for b in blocks):
            return new
    return blocks


def main_text(
    source: str | None, low: frozenset[str] = frozenset(), linked: frozenset[str] = frozenset(), repeated: frozenset[int] = frozenset(), important: frozenset[str] = frozenset()
) -> str:
    """The text of a page: first by the tree's verdicts, then without furniture."""
    blocks, marked = without_furniture(without_low(parse(source), low, linked, repeated))
    if marked:
        blocks = [b for b in blocks if b.element.article or b.element.path in important]
    return "\n".join(b.text for b in blocks)


def counted(source: str | None) -> tuple[int, set[tuple[str, int, int, int]]]:
    """The page's digest, and (path, kind, what, characters) of its nodes: 0 a text block, 1 a sequence of child elements."""
    seen, elements, blocks = set(), {}, parse(source)
    for b in blocks:
        seen.add((b.element.path, 0, _digest(b.element.path, b.text), len(b.text)))
        for e in chain(b.element):
            elements.setdefault(e.path, e)
    for path, e in elements.items():
        seen.add((path, 1, _digest(",".join(e.children)), 0))
    return _digest(*(b.text for b in blocks)), seen


def _host(pages: DataFrame, url: str):
    return F.coalesce(F.lower(F.regexp_extract(pages[url], r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts: (host, path, m, own, content, chars, importance) of elements, and (host, path,
    what, k, m) of the text blocks of which some are alike."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = set()
            for host, source in zip(frame["host"], frame["source"]):
                page, nodes = counted(source)
                seen.update((host, *node, page) for node in nodes)
            yield pd.DataFrame(list(seen), columns=["host", "path", "kind", "what", "chars", "page"])

    seen = pages.select(_host(pages, url).alias("host"), pages[html].alias("source")).mapInPandas(batches, "host string, path string, kind int, what long, chars long, page long")
    by_what = checkpointed(seen.distinct().groupBy("host", "path", "kind", "what", "chars").agg(F.count(F.lit(1)).alias("k")))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    # A page has one sequence of children by path, so those count the pages of a node.
    nodes = by_what.groupBy("host", "path").agg(
        of(1, F.col("k")).alias("m"), of(0, F.col("k")).alias("blocks"), of(0, F.col("k") * F.col("chars")).alias("chars"),
        of(0, F.col("k") * F.ln("k")).alias("repeated"), of(1, F.col("k") * F.ln("k")).alias("styled"),
    )
    nodes = checkpointed(nodes.where("m > 1"))
    own = nodes.select("host", "path", "m", (1 - F.col("styled") / (F.col("m") * F.ln("m"))).alias("own"), *(F.lit(0).cast(t).alias(c) for c, t in (("blocks", "long"), ("chars", "long"), ("content", "double"))))
    steps = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))
    none = lambda t: F.lit(None).cast(t)
    content = nodes.where("blocks > 0").select("host", above.alias("path"), none("long").alias("m"), none("double").alias("own"), "blocks", "chars", (F.col("blocks") - F.col("repeated") / F.ln("m")).alias("content"))
    tree = own.unionByName(content).groupBy("host", "path").agg(F.max("m").alias("m"), F.max("own").alias("own"), F.sum("chars").alias("chars"), (F.sum("content") / F.sum("blocks")).alias("content"))
    tree = tree.where("m is not null").withColumn("importance", 1 - (1 - F.coalesce("content", F.lit(1.0))) * (1 - F.col("own")))
    blocks = by_what.where("kind = 0 and k > 1").join(nodes.select("host", "path", "m"), ["host", "path"]).select("host", "path", "what", "k", "m")
    return checkpointed(tree), blocks


def verdicts(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, repeated, within, important) of the judged nodes: branches of low importance, repeated text blocks
    (``repeated`` is a digest of path and text) and important nodes. ``within``: in the main branch or an article."""
    tree, blocks = style_tree(pages, url, html)
    # The main branch: the deepest one with half of the host's text, by what lies at the top of its pages.
    total = tree.groupBy("host").agg(F.max("chars").alias("total"))
    half = 2 * F.col("chars") >= F.col("total")
    place = F.struct(half.alias("half"), F.when(half, F.size(F.split("path", "/"))).alias("depth"), "chars", "path")
    main = tree.join(total, "host").groupBy("host").agg(F.max_by(F.struct("importance", "path"), place).alias("x"))
    # Where it ends in text blocks, what holds them counts.
    at = F.regexp_replace("x.path", rf"(/({'|'.join(sorted(TEXT_TAGS))})([.#][^/]*)?)+$", "")
    main = main.select("host", F.col("x.importance").alias("main"), at.alias("at"))
    name = F.regexp_extract("path", r"([^/.#]*)[^/]*$", 1)
    branch = ~name.isin(*sorted(TEXT_TAGS | ARTICLE | {"html", "body", ""}))
    poor = F.col("importance") < F.col("main") - GAP
    # A page as a whole is no main branch: then only articles are known to hold text.
    named = ~F.regexp_extract("at", r"([^/.#]*)[^/]*$", 1).isin("html", "body", "")
    within = named & ((F.col("path") == F.col("at")) | F.col("path").startswith(F.concat("at", F.lit("/"))))
    if ARTICLE:
        within = within | F.col("path").rlike(rf"/({'|'.join(sorted(ARTICLE))})([.#/]|$)")
    judged = tree.where(F.col("m") >= least_pages).join(main, "host").where(branch | ~poor)
    judged = judged.select("host", "path", F.lit(None).cast("long").alias("repeated"), within.alias("within"), (~poor).alias("important"))
    same = blocks.where((F.col("m") >= least_pages) & (1 - F.ln("k") / F.ln("m") < CUT)).join(main, "host").where(named & ~within)
    return judged.unionByName(same.select("host", "path", F.col("what").alias("repeated"), F.lit(False).alias("within"), F.lit(False).alias("important")))


KINDS = ("low", "linked", "again", "important")


def _kind(row) -> str:
    return "again" if row["repeated"] is not None else "important" if row["important"] else "linked" if row["within"] else "low"


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    told = checkpointed(verdicts(pages, url, html, least_pages))
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("source"), _host(pages, url).alias("host"))
    schema = "page_id long, url string, text string"
    output = lambda frame, texts: pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts})
    if told.count() > BROADCAST_ROWS:
        given = _joined(rows, told)

        def one_by_one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                sets = zip(*([frozenset(x) if x is not None else frozenset() for x in frame[c]] for c in KINDS))
                yield output(frame, [main_text(s, *x) for s, x in zip(frame["source"], sets)])

        return given.mapInPandas(one_by_one, schema)
    by_host: dict = {}
    for row in told.collect():  # at most BROADCAST_ROWS, as counted
        by_host.setdefault(row["host"], {}).setdefault(_kind(row), set()).add(row["path"] if row["repeated"] is None else row["repeated"])
    sent = pages.sparkSession.sparkContext.broadcast({host: tuple(frozenset(kinds.get(c, ())) for c in KINDS) for host, kinds in by_host.items()})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield output(frame, [main_text(s, *sent.value.get(host, ())) for s, host in zip(frame["source"], frame["host"])])

    return rows.mapInPandas(batches, schema)


def _joined(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with the verdicts on each page's own nodes, by joins of nodes and of whole pages' digests."""

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(host, key, path, what if kind == 0 else None) for host, key, source in zip(frame["host"], frame["key"], frame["source"]) for path, kind, what, _ in counted(source)[1]]
            yield pd.DataFrame(found, columns=["host", "key", "path", "what"]).astype({"what": "Int64"})

    keyed = rows.withColumn("key", F.unhex(F.md5(F.coalesce("source", F.lit("")))))
    own = keyed.select("host", "key", "source").mapInPandas(nodes, "host string, key binary, path string, what long").distinct()
    met = own.join(told, ["host", "path"]).where(F.col("repeated").isNull() | (F.col("repeated") == F.col("what")))
    path = F.col("repeated").isNull()
    these = lambda c, test: F.collect_set(F.when(test, F.col(c))).alias
    low = path & ~F.col("important")
    sets = met.groupBy("host", "key").agg(these("path", low & ~F.col("within"))("low"), these("path", low & F.col("within"))("linked"), these("repeated", ~path)("again"), these("path", path & F.col("important"))("important"))
    return keyed.join(checkpointed(sets), ["host", "key"], "left").select("page_id", "url", "source", *KINDS)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_extract": op10_html_extract}
