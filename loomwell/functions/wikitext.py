"""Wiki markup read in one pass: infobox fields, lead, sections, link targets and the plain text of values.

The marks of a page are walked once with a stack of open templates, links and tags. What closes is resolved at once into
two texts, one by the rules of a page and one by those of an infobox value, and handed to what holds it; what never
closes stays as it is written. So the work grows with the length of a page, however many templates it has or however
deep they lie.

Rules of a page: a template ``s`` becomes its first value in parentheses and ``nihongo`` its first value (names in any
case), all others go. Rules of a value: the same for ``S``, ``Nihongo`` and ``W`` with these very names, and ``<br>`` is
a line end. For both: comments, ``ref``, ``gallery`` and ``references`` go with what is in them; links leave their label
or target, links to other sites their label; marks of bold and italic text, of lists, tables and rules and other tags
go; character references are decoded; ``nowiki`` text stays as written.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"""</?[a-zA-Z][^<>]*>|\{\{|\}\}|\[\[|\]\]|\[(?:https?://|ftp://|mailto:|//)[^\s\[\]<>"|{}]*[ \t]*|\]|\||=|'{2,}|&(?:\#\d+|\#[xX][0-9a-fA-F]+|\w+);|\n""")
#: What may stand at the start of a line: marks of lists and rules, a table's marks, a heading.
LINE = re.compile(r"[*#:;]+|-{4,}|\{\|[^\n]*|\|\}|\|[-+][^\n]*|(={1,6})([^\n]+?)(={1,6})[ \t]*(?=\n|\Z)")
LIST_MARKS = ("*", "#", ":", ";")
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
#: Tags that go with their contents, tags whose contents are no markup, and those of them that show nothing.
CUT = frozenset(["ref", "gallery", "references"])
RAW = frozenset("nowiki pre source syntaxhighlight math score timeline templatedata graph imagemap inputbox categorytree".split())
UNSEEN = RAW - frozenset(["nowiki", "pre", "source", "syntaxhighlight"])
#: Titles of sections that are left out; prefixes of links that are no pages.
LEFT_OUT = ("references", "gallery", "external links", "navigation")
NO_PAGE = ("Category:", "File:", "Image:", "es:", "de:", "ru:", "zh:", "pt-br:", "vi:", "id:", "pl:", "tr:")

#: Characters of a template's name or a link's target that are read; what is longer is no link.
LONGEST = 1000
#: Pages that are Python objects at a time.
STEP_PAGES = 64
#: Stands before a list's mark that was a character reference, which marks no list, until a value is finished.
KEPT = "\ufdd0"

PARSED = pa.struct([
    ("fields", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("lead", pa.string()),
    ("sections", pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("path", pa.string()), ("content", pa.string())]))), ("links", pa.list_(pa.string())), ("error", pa.string()),
])
SPARK_PARSED = (
    T.StructType().add("fields", T.ArrayType(T.StructType().add("key", "string").add("value", "string"))).add("lead", "string")
    .add("sections", T.ArrayType(T.StructType().add("title", "string").add("level", "integer").add("path", "string").add("content", "string")))
    .add("links", T.ArrayType(T.StringType())).add("error", "string")
)


def without_comments(source: str) -> str:
    parts, at = [], 0
    while (start := source.find("<!--", at)) >= 0 and (end := source.find("-->", start + 4)) >= 0:
        parts.append(source[at:start])
        at = end + 3
    return "".join([*parts, source[at:]])


class Text:
    """A growing text under both rules; quotation marks of bold and italic text wait for their partner on the line."""

    __slots__ = ("page", "value", "styles")

    def __init__(self) -> None:
        self.page: list[str] = []
        self.value: list[str] = []
        self.styles: dict[str, tuple[int, int]] = {}

    def add(self, page: str, value: str | None = None) -> None:
        self.page.append(page)
        self.value.append(page if value is None else value)

    def style(self, marks: str) -> None:
        over = len(marks) - 5 if len(marks) > 5 else len(marks) == 4
        self.add("'" * over)
        if self.styles.pop(marks[over:], None) is None:
            self.styles[marks[over:]] = (len(self.page), len(self.value))
            self.add("")

    def line_ends(self) -> None:
        for marks, (i, j) in self.styles.items():
            self.page[i] = self.value[j] = marks
        self.styles = {}

    def texts(self) -> tuple[str, str]:
        self.line_ends()
        return "".join(self.page), "".join(self.value)


class Frame:
    """An open template, link or tag: what opened it, and its parts so far as (name, page text, value text)."""

    __slots__ = ("kind", "opened", "start", "begins", "head", "name", "text", "parts", "token")

    def __init__(self, kind: str, opened: str, start: int, begins: int, token: int) -> None:
        self.kind, self.opened, self.start, self.begins, self.token = kind, opened, start, begins, token
        #: The first part as written: a template's name or a link's target.
        self.head = ""
        self.name: str | None = None
        self.text = Text()
        self.parts: list[tuple[str | None, str, str]] = []

    def part_ends(self, source: str, end: int, begins: int) -> None:
        self.head = self.head if self.parts else source[self.begins : min(end, self.begins + LONGEST + 1)]
        self.parts.append((self.name, *self.text.texts()))
        self.name, self.text, self.begins = None, Text(), begins


class Page:
    """One walk over a source. ``whole``: headings part it into sections; else it is a value or a title."""

    def __init__(self, source: str, whole: bool = True) -> None:
        self.source, self.whole = without_comments(source), whole
        self.links: list[tuple[int, str]] = []
        self.box: tuple[int, list[tuple[str, str]]] | None = None
        #: (level, title, text) of each section; the lead has level 0.
        self.sections: list[tuple[int, str, Text]] = [(0, "", Text())]
        self.stack: list[Frame] = []
        #: How many frames of a kind are open, and the tokens that opened frames.
        self.kinds: Counter = Counter()
        self.opened: set[int] = set()
        self.tables = 0
        self._walk()

    @property
    def text(self) -> Text:
        return self.stack[-1].text if self.stack else self.sections[-1][2]

    def _tokens(self) -> tuple[list[re.Match], dict[int, int], dict[int, str]]:
        """The marks, which template marks belong together, and the contents of tags that hold no markup."""
        tokens, pairs, raw, waiting, unclosed, at = [], {}, {}, [], set(), 0
        while (m := TOKEN.search(self.source, at)) is not None:
            at, mark = m.end(), m[0]
            if mark == "{{":
                waiting.append(len(tokens))
            elif mark == "}}" and waiting:
                pairs[waiting[-1]], pairs[len(tokens)] = len(tokens), waiting[-1]
                waiting.pop()
            elif mark[0] == "<" and mark[1] != "/" and mark[-2] != "/" and (tag := TAG.match(mark)[1].lower()) in RAW and tag not in unclosed:
                close = _closing(tag).search(self.source, at)
                if close is None:
                    unclosed.add(tag)
                else:
                    raw[len(tokens)] = "" if tag in UNSEEN else self.source[at : close.start()]
                    at = close.end()
            tokens.append((m.start(), at, mark))
        return tokens, pairs, raw

    def _walk(self) -> None:
        tokens, pairs, raw = self._tokens()
        source, at = self.source, self._line(0)
        for i, (start, end, mark) in enumerate(tokens):
            if end <= at:
                continue
            if start < at:
                start, mark = at, source[at:end]
            if start > at:
                self.text.add(source[at:start])
            at = end
            top = self.stack[-1] if self.stack else None
            if i in raw:
                self.text.add(raw[i])
            elif mark == "\n":
                if top is not None and top.kind == "[":
                    self._give_up(self._depth(lambda f: f.kind != "[") + 1)
                self.text.line_ends()
                self.text.add("\n")
                at = self._line(end)
            elif mark == "{{" and i in pairs or mark == "[[":
                self._push(mark, mark, start, end, i)
            elif mark == "}}" and pairs.get(i) in self.opened:
                self._give_up(self._depth(lambda f: f.token == pairs[i]) + 1)
                self._template(start, end)
            elif mark[0] == "]" and top is not None and top.kind == "[":
                self._pop()
                top.part_ends(source, start, end)
                self.text.add(*top.parts[0][1:])
                at = start + 1
            elif mark == "]]" and top is not None and top.kind == "[[":
                self._link(start, end)
            elif len(mark) > 2 and mark[0] == "[":
                self._push("[", mark, start, end, i)
            elif mark == "|" and top is not None and (top.kind == "{{" or top.kind == "[[" and not top.parts):
                top.part_ends(source, start, end)
            elif mark == "=" and top is not None and top.kind == "{{" and top.parts and top.name is None:
                top.name, top.text = source[top.begins : start], Text()
            elif mark == "|" and top is None and self.tables:
                pass
            elif mark[:2] == "''":
                self.text.style(mark)
            elif mark[0] == "&":
                shown = html.unescape(mark)
                self.text.add(shown, KEPT + shown if shown in LIST_MARKS else shown)
            elif mark[0] == "<" and len(mark) > 2 and (tag := TAG.match(mark)) is not None:
                self._tag(tag[1].lower(), mark, start, end, i)
            else:
                self.text.add(mark)
        self.text.add(source[at:])
        self._give_up(0)

    def _line(self, at: int) -> int:
        """Where what a line's start says ends."""
        m = LINE.match(self.source, at)
        if m is None:
            return at
        if m[1]:
            if self.stack or not self.whole:
                return at
            level, title = min(len(m[1]), len(m[3])), "=" * (len(m[1]) - len(m[3])) + m[2] + "=" * (len(m[3]) - len(m[1]))
            inner = Page(title, whole=False)
            self.links += [(m.start(2) + i, target) for i, target in inner.links]
            self.sections.append((level, title.strip(), Text()))
            self.text.add(inner.sections[0][2].texts()[0])
            return m.end()
        if m[0][0] in "{|":
            if self.kinds["{{"]:
                return at
            if m[0][:2] == "{|" or m[0] == "|}":
                self.tables += 1 if m[0][0] == "{" else -1 if self.tables else 0
            elif not self.tables:
                return at
        return m.end()

    def _give_up(self, depth: int) -> None:
        """What never closes is text: the frames from ``depth`` on."""
        frames = [self._pop() for _ in range(len(self.stack) - depth)]
        for frame in reversed(frames):
            frame.part_ends(self.source, frame.begins, 0)
            written = lambda k, f=frame: f.opened + "|".join((p[0] + "=" if p[0] is not None else "") + p[k] for p in f.parts)
            self.text.add(written(1), written(2))

    def _push(self, kind: str, opened: str, start: int, begins: int, token: int) -> None:
        self.stack.append(Frame(kind, opened, start, begins, token))
        self.kinds[kind] += 1
        self.opened.add(token)

    def _pop(self) -> Frame:
        frame = self.stack.pop()
        self.kinds[frame.kind] -= 1
        self.opened.discard(frame.token)
        return frame

    def _depth(self, found) -> int:
        """The place of the innermost frame that ``found`` takes, or -1."""
        return next((d for d in range(len(self.stack) - 1, -1, -1) if found(self.stack[d])), -1)

    def _template(self, start: int, end: int) -> None:
        frame = self._pop()
        frame.part_ends(self.source, start, end)
        name, values = frame.head.strip(), frame.parts[1:]
        low, page, value = name.lower(), "", ""
        if values:
            first = values[0][1].strip(), values[0][2].strip()
            page = f" ({first[0]})" if low == "s" else first[0] if low == "nihongo" else ""
            value = f" ({first[1]})" if name == "S" else first[1] if name in ("Nihongo", "W") else ""
        self.text.add(page, value)
        if "infobox" in low and (self.box is None or frame.start < self.box[0]):
            fields, place = {}, 0
            for key, _, text in values:
                place += key is None
                if text := finished_value(text):
                    fields[str(place) if key is None else key.strip()] = text
            self.box = (frame.start, list(fields.items()))

    def _link(self, start: int, end: int) -> None:
        frame = self.stack[-1]
        head = frame.head if frame.parts else self.source[frame.begins : min(start, frame.begins + LONGEST + 1)]
        if "\n" in head or len(head) > LONGEST:
            self._give_up(len(self.stack) - 1)
            self.text.add("]]")
            return
        self._pop()
        frame.part_ends(self.source, start, end)
        self.links.append((frame.start, frame.head.strip()))
        self.text.add(frame.parts[-1][1], frame.parts[-1][2].strip() or frame.parts[0][2].strip())

    def _tag(self, tag: str, mark: str, start: int, end: int, i: int) -> None:
        if tag in CUT and mark[-2] != "/":
            if mark[1] != "/":
                self._push(tag, mark, start, end, i)
            elif self.kinds[tag]:
                self._give_up(self._depth(lambda f: f.kind == tag) + 1)
                self._pop()
        elif tag == "br":
            self.text.add("", "\n")


@lru_cache(maxsize=None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


def finished_value(text: str) -> str:
    text = re.sub(r"(?m)^[ \t]*[*#:;]+", "", text.strip())
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", "", re.sub(f"{KEPT}(?=[*#:;])", "", text))).strip()


def section_text(text: str) -> str:
    """Lines stripped, blank ones left out, runs of spaces and tabs as one space."""
    return re.sub(r"[ \t]+", " ", "\n".join(line.strip() for line in text.split("\n") if line.strip())).strip()


def value_text(source: str) -> str:
    """The plain text of an infobox value."""
    return finished_value(Page(source, whole=False).sections[0][2].texts()[1])


def parsed_page(source: str) -> dict:
    """Infobox fields, lead, sections with their paths, and links of a page.

    A heading closes all sections of its level or deeper; one that is left out changes no path. A section's content
    begins with its title.
    """
    page = Page(source)
    open_: list[tuple[int, str]] = []
    sections, links = [], dict.fromkeys(t for _, t in sorted(page.links) if t and not t.startswith(NO_PAGE))
    for level, title, text in page.sections[1:]:
        if title.lower() in LEFT_OUT:
            continue
        open_ = [*((n, t) for n, t in open_ if n < level), (level, title)]
        if content := section_text(text.texts()[0]):
            sections.append({"title": title, "level": level, "path": " > ".join(t for _, t in open_), "content": content})
    fields = [{"key": k, "value": v} for k, v in (page.box[1] if page.box else ())]
    return {"fields": fields, "lead": section_text(page.sections[0][2].texts()[0]), "sections": sections, "links": list(links), "error": None}


@F.arrow_udf(SPARK_PARSED)
def parsed(raw: pa.Array) -> pa.Array:
    """Parsed pages; a page that the parser fails on tells the error and nothing else. Some pages at a time become Arrow
    rows, so that a worker holds few of them as objects, however many a batch has."""
    pieces = [pa.array([], PARSED)]
    for at in range(0, len(raw), STEP_PAGES):
        rows = []
        for source in raw.slice(at, STEP_PAGES).to_pylist():
            try:
                rows.append(parsed_page(source or ""))
            except Exception as error:  # noqa: BLE001
                rows.append({"fields": [], "lead": "", "sections": [], "links": [], "error": f"{type(error).__name__}: {error}"})
        pieces.append(pa.array(rows, PARSED))
    return pa.concat_arrays(pieces)


@F.arrow_udf(T.StringType())
def value(raw: pa.Array) -> pa.Array:
    return pa.array([None if source is None else value_text(source) for source in raw.to_pylist()], pa.string())


def literal(line: Column) -> Column:
    """Markup that shows a line without brackets as it is, also in a template: its other marks as character references."""
    for mark, shown in (("&", "&amp;"), ("=", "&#61;"), ("'", "&#39;")):
        line = F.replace(line, F.lit(mark), F.lit(shown))
    for mark in "#:;":
        line = F.regexp_replace(line, rf"^(\s*){mark}", f"$1&#{ord(mark)};")
    return line


def fields_map(page: Column) -> Column:
    return F.map_from_entries(page["fields"])
