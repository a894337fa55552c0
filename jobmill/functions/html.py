"""HTML as a column: one small vectorised tokenizer, everything else as Spark expressions.

``tokenize(html)`` turns a page into an array of tokens in document order.  An element is an
``open`` token whose ``close`` field is the position of its ``close`` token (its own position for
an element without an end tag), so every subtree is a contiguous slice.  Selecting, cleaning, reading text and writing
HTML back are array expressions on that column: pages never leave their partition and no
shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import brand_scrub, contains_any, let, normalize_spaces, strip_spaces
from jobmill.functions.urls import url_absolute

TOKEN_TYPE = ("array<struct<pos:int,close:int,parent:int,depth:int,kind:string,tag:string,"
              "attrs:map<string,string>,text:string>>")
_ARROW_COLUMNS = (("pos", pa.int32()), ("close", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
                  ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
                  ("text", pa.string()))
_ARROW_TYPE = pa.list_(pa.struct(list(_ARROW_COLUMNS)))


class _Tokens(HTMLParser):
    """Collects (pos, close, parent, depth, kind, tag, attrs, text) rows of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.named: dict[str, int] = {}  # how many open elements have a name
        self.raw = self.kept = 0  # how many of them hold raw text, or keep their blanks

    def add(self, kind: str, tag: str = "", attrs: dict | None = None, text: str = "") -> int:
        pos = len(self.rows)
        parent = self.open[-1] if self.open else -1
        self.rows.append([pos, pos, parent, len(self.open), kind, tag, list((attrs or {}).items()), text])
        return pos

    def count(self, tag: str, step: int) -> None:
        self.named[tag] = self.named.get(tag, 0) + step
        self.raw += step * (tag in K.RAW_TEXT_TAGS)
        self.kept += step * (tag in K.KEEP_SPACE_TAGS)

    def handle_starttag(self, tag, attrs):
        pos = self.add("open", tag, {k: v or "" for k, v in attrs})
        if tag not in K.VOID_TAGS:
            self.open.append(pos)
            self.count(tag, 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # Closes the nearest open element of that name and all that is open inside it.
        if self.named.get(tag):
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        start = self.open.pop()
        tag = self.rows[start][5]
        self.count(tag, -1)
        self.rows[start][1] = self.add("close", tag)
        return tag

    def handle_data(self, data):
        kind = "raw" if self.raw else "text"
        if not self.kept and not data.strip(" \t\r\n\f\v"):
            data = "\n" if "\n" in data else " "
        last = self.rows[-1] if self.rows else None
        if last and last[4] == kind:
            last[7] += data
        else:
            self.add(kind, text=data)

    def handle_comment(self, data):
        self.add("comment", text=data)

    def handle_decl(self, decl):
        self.add("decl", text=decl)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self.shut()
        return self.rows


# The tags of a page that ``_read_plain`` can read: every value in double quotes and without entities.
_TAG = re.compile(r"(<[^<>]*>)")
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>")
_PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*)[ \t\n]*>""")
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z0-9_-]+)="([^"]*)\"""")
_OWN_RULES = frozenset(("iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "title", "xmp"))  # what follows may be no markup
MOST_TAGS, MOST_CHARS = 10_000, 300  # that are remembered, and of one that is
_tags: dict[str, tuple | None] = {}


def _plain_tag(text: str) -> tuple | None:
    """(name, attributes or None for an end tag, has no content, raw text, keeps blanks) of a plain tag, None for any other text."""
    if found := _PLAIN_END.fullmatch(text):
        tag, attrs = found[1].lower(), None
    elif found := _PLAIN_START.fullmatch(text):
        tag, attrs = found[1].lower(), [*{name.lower(): value for name, value in _PLAIN_ATTRIBUTE.findall(found[2])}.items()]
    else:
        return None
    return None if tag in _OWN_RULES else (tag, attrs, tag in K.VOID_TAGS, tag in K.RAW_TEXT_TAGS, tag in K.KEEP_SPACE_TAGS)


def _read_plain(html: str) -> list[list] | None:
    """The token rows of a page of plain tags and texts, as ``_Tokens`` makes them; None for any other page.

    The parser looks at every tag and attribute by many small steps, most of a page's time; here equal tags of all pages are read once.
    """
    rows: list[list] = []
    opened: list[tuple] = []  # (row, name, raw text, keeps blanks)
    named: dict[str, int] = {}  # how many open elements have a name
    top = -1  # the row of the innermost open element
    raw = kept = 0
    parts = _TAG.split(html)
    for data, piece in zip(parts[::2], [*parts[1::2], ""], strict=True):
        if data:
            if "<" in data:
                return None
            if "&" in data:
                data = unescape(data)
            if not kept and not data.strip(" \t\r\n\f\v"):
                data = "\n" if "\n" in data else " "
            pos, kind = len(rows), "raw" if raw else "text"
            if pos and rows[-1][4] == kind:  # after an end tag of nothing
                rows[-1][7] += data
            else:
                rows.append([pos, pos, top, len(opened), kind, "", [], data])
        if not piece:
            break
        if piece in _tags:
            found = _tags[piece]
        else:
            found = _plain_tag(piece)
            if len(piece) <= MOST_CHARS:
                if len(_tags) >= MOST_TAGS:
                    _tags.clear()
                _tags[piece] = found
        if found is None:
            return None
        tag, attrs, void, is_raw, keeps = found
        if attrs is not None:
            pos = len(rows)
            rows.append([pos, pos, top, len(opened), "open", tag, attrs, ""])
            if not void:
                opened.append((pos, tag, is_raw, keeps))
                named[tag] = named.get(tag, 0) + 1
                top = pos
                raw += is_raw
                kept += keeps
            continue
        ends = bool(named.get(tag))
        while ends:
            start, name, is_raw, keeps = opened.pop()
            named[name] -= 1
            raw -= is_raw
            kept -= keeps
            top = opened[-1][0] if opened else -1
            pos = rows[start][1] = len(rows)
            rows.append([pos, pos, top, len(opened), "close", name, [], ""])
            ends = name != tag
    while opened:
        start, name, *_ = opened.pop()
        pos = rows[start][1] = len(rows)
        rows.append([pos, pos, opened[-1][0] if opened else -1, len(opened), "close", name, [], ""])
    return rows


def tokenize_page(html: str) -> list[list]:
    """The token rows (pos, close, parent, depth, kind, tag, attrs, text) of one page."""
    rows = _read_plain(html)
    if rows is not None:
        return rows
    parser = _Tokens()
    parser.feed(html)
    return parser.finish()


STEP_PAGES, STEP_CHARS = 64, 1 << 20


def _steps(pages: pa.Array) -> Iterator[pa.Array]:
    """Token lists of an Arrow batch, some pages at a time, so that few tokens are alive, however many pages a batch has."""
    start, sizes = 0, pc.fill_null(pc.utf8_length(pages), 0).to_pylist()
    while start < len(pages):
        end, held = start + 1, sizes[start]
        while end < len(pages) and end - start < STEP_PAGES and held + sizes[end] <= STEP_CHARS:
            held += sizes[end]
            end += 1
        yield _tokenize_slice(pages.slice(start, end - start))
        start = end


def _tokenize_slice(pages: pa.Array) -> pa.Array:
    offsets, rows = [0], []
    for html in pages.to_pylist():
        rows.extend(tokenize_page(html or ""))
        offsets.append(len(rows))
    fields = list(zip(*rows)) if rows else [[] for _ in _ARROW_COLUMNS]
    columns = [pa.array(list(values), type=kind) for values, (_, kind) in zip(fields, _ARROW_COLUMNS)]
    tokens = pa.StructArray.from_arrays(columns, fields=[pa.field(n, t) for n, t in _ARROW_COLUMNS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens).cast(_ARROW_TYPE)


def tokenize(html: Column | str) -> Column:
    @F.arrow_udf(TOKEN_TYPE)
    def html_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield from _steps(pages) if len(pages) else [pa.array([], _ARROW_TYPE)]

    return html_tokens(html)


# ----------------------------------------------------------------- selecting


@dataclass(frozen=True)
class Select:
    """An element test: tag names, classes, id, attribute text, and optionally an ancestor test."""

    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    id: str = ""
    class_pattern: str = ""
    attr: str = ""
    attr_contains: str = ""
    attr_starts: str = ""
    inside: "Select | None" = None
    child: bool = False
    or_else: "Select | None" = None

    def test(self, token: Column) -> Column:
        return self._own(token) | self.or_else.test(token) if self.or_else else self._own(token)

    def _own(self, token: Column) -> Column:
        ok = token.kind == "open"
        if self.tags:
            ok = ok & token.tag.isin(*self.tags)
        if self.classes:
            names = F.split(normalize_spaces(token.attrs["class"]), " ")
            for name in self.classes:
                ok = ok & F.array_contains(names, name)
        if self.id:
            ok = ok & (token.attrs["id"] == self.id)
        if self.class_pattern:
            ok = ok & token.attrs["class"].rlike("(?i)" + self.class_pattern)
        if self.attr:
            value = token.attrs[self.attr]
            ok = ok & value.isNotNull()
            if self.attr_contains:
                ok = ok & value.contains(self.attr_contains)
            if self.attr_starts:
                ok = ok & value.startswith(self.attr_starts)
        return F.coalesce(ok, F.lit(False))


def select(tokens: Column, what: Select) -> Column:
    """Matching ``open`` tokens in document order."""
    found = F.filter(tokens, what.test)
    if what.inside is None:
        return found

    def nested(around: Column, token: Column) -> Column:
        return F.exists(around, lambda a: (a.pos < token.pos) & (token.pos <= a.close) & (
            (token.parent == a.pos) if what.child else F.lit(True)))

    return let(select(tokens, what.inside),
               lambda around: F.filter(found, lambda token: nested(around, token)))


def subtree(tokens: Column, node: Column) -> Column:
    """The slice of ``tokens`` that ``node`` spans; ``tokens`` may itself be a subtree slice."""
    start = F.get(tokens, F.lit(0)).pos
    return F.slice(tokens, node.pos - start + 1, node.close - node.pos + 1)


def text_of(tokens: Column, separator: str = " ") -> Column:
    """Stripped text pieces joined by ``separator``."""
    pieces = F.transform(F.filter(tokens, lambda t: t.kind == "text"), lambda t: strip_spaces(t.text))
    return F.coalesce(F.array_join(F.filter(pieces, lambda p: p != ""), separator), F.lit(""))


def whole_text(tokens: Column) -> Column:
    """Text as it stands, without stripping."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: t.kind == "text"), lambda t: t.text), "")


def node_text(tokens: Column, node: Column) -> Column:
    return normalize_spaces(text_of(subtree(tokens, node)))


def nth_text(tokens: Column, what: Select, nth: int = 0) -> Column:
    """Text of the nth match, '' if there is none."""
    return let(F.get(select(tokens, what), F.lit(nth)),
               lambda found: F.when(found.isNull(), "").otherwise(node_text(tokens, found)))


def nth_attr(tokens: Column, what: Select, attr: str, nth: int = 0) -> Column:
    return F.coalesce(F.get(select(tokens, what), F.lit(nth)).attrs[attr], F.lit(""))


def all_texts(tokens: Column, what: Select) -> Column:
    return F.transform(select(tokens, what), lambda n: node_text(tokens, n))


def looks_like_html(value: Column) -> Column:
    return value.contains("<") & value.contains(">")


# ----------------------------------------------------------------- writing


def _escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _attribute(entry: Column) -> Column:
    value = _escape(entry.value)
    quoted = F.when(~value.contains('"'), F.concat(F.lit('"'), value, F.lit('"'))).when(
        ~value.contains("'"), F.concat(F.lit("'"), value, F.lit("'"))).otherwise(
        F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"')))
    return F.concat(F.lit(" "), entry.key, F.lit("="), quoted)


def _written(token: Column) -> Column:
    attributes = F.array_join(F.transform(F.map_entries(token.attrs), _attribute), "")
    tail = F.when(token.tag.isin(*K.VOID_TAGS), "/>").otherwise(">")
    return (
        F.when(token.kind == "open", F.concat(F.lit("<"), token.tag, attributes, tail))
        .when(token.kind == "close", F.concat(F.lit("</"), token.tag, F.lit(">")))
        .when(token.kind == "text", _escape(token.text))
        .when(token.kind == "comment", F.concat(F.lit("<!--"), token.text, F.lit("-->")))
        .when(token.kind == "decl", F.concat(F.lit("<!"), token.text, F.lit(">")))
        .otherwise(token.text)
    )


def to_html(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, _written), "")


# ----------------------------------------------------------------- cleaning


def spans(tokens: Column, test: Callable[[Column], Column]) -> Column:
    """Spans of the elements that pass ``test``."""
    found = F.filter(tokens, lambda t: (t.kind == "open") & F.coalesce(test(t), F.lit(False)))
    return F.transform(found, lambda t: F.struct(t.pos.alias("pos"), t.close.alias("close")))


def _outermost(found: Column) -> Column:
    """Spans not inside an earlier one; ``found`` is sorted by position and spans do not cross.

    The span at place i is outermost if the i spans before it have all closed, that is if the i-th smallest close
    lies before it: one sort and one filter.
    """
    return let(F.array_sort(F.transform(found, lambda s: s.close)),
               lambda closes: F.filter(found, lambda s, i: (i == 0) | (F.get(closes, i - 1) < s.pos)))


def without(tokens: Column, found: Column) -> Column:
    """``tokens`` minus the spans: the gaps between the outermost spans, glued together.

    Costs one pass over the tokens, however many spans there are.
    """
    first = F.get(tokens, F.lit(0)).pos
    last = F.try_element_at(tokens, F.lit(-1)).pos

    def gap(outer: Column, k: Column) -> Column:
        start = F.coalesce(F.get(outer, k - 1).close + 1, first)
        stop = F.coalesce(F.get(outer, k).pos, last + 1)
        return F.slice(tokens, start - first + 1, F.greatest(stop - start, F.lit(0)))

    return let(_outermost(found), lambda outer: F.when(F.size(outer) == 0, tokens).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(outer)), lambda k: gap(outer, k)))))


def _rewrite(token: Column, **changes: Column) -> Column:
    fields = ("pos", "close", "parent", "depth", "kind", "tag", "attrs", "text")
    return F.struct(*[changes.get(f, token[f]).alias(f) for f in fields])


def _outward_link(token: Column, base: Column) -> Column:
    """An anchor with an absolute address that opens in a new tab."""
    added = {"target": "_blank", "rel": "nofollow noopener"}
    kept = F.transform_values(
        token.attrs, lambda k, v: F.when(k == "href", url_absolute(v, base)).when(
            k == "target", added["target"]).when(k == "rel", added["rel"]).otherwise(v))
    extra = F.map_filter(F.create_map(*[F.lit(x) for pair in added.items() for x in pair]),
                         lambda k, v: ~F.map_contains_key(token.attrs, k))
    return _rewrite(token, attrs=F.map_concat(kept, extra))


def clean_fragment(tokens: Column, base: Column, drop_tags: tuple[str, ...] = K.OFFICIAL_DROP_TAGS) -> Column:
    """Drop the listed elements and make the links absolute; returns tokens."""
    kept = without(tokens, spans(tokens, lambda t: t.tag.isin(*drop_tags)))
    is_link = lambda t: (t.kind == "open") & (t.tag == "a") & F.map_contains_key(t.attrs, "href")
    return F.transform(kept, lambda t: F.when(is_link(t), _outward_link(t, base)).otherwise(t))


def is_social(url: Column) -> Column:
    return let(F.lower(F.coalesce(url, F.lit(""))), lambda u: contains_any(u, K.SOCIAL_HOSTS))


def junk_spans(tokens: Column, root: bool = True) -> Column:
    """Elements dropped by tag name or by a junk word in class or id."""
    junk = "(?iu)" + K.JUNK_CLASS

    def test(t: Column) -> Column:
        by_name = F.coalesce(t.attrs["class"], F.lit("")).rlike(junk) | F.coalesce(
            t.attrs["id"], F.lit("")).rlike(junk)
        return t.tag.isin(*K.DEEP_DROP_TAGS) | by_name

    found = spans(tokens, test)
    return found if root else F.filter(found, lambda s: s.pos > F.get(tokens, F.lit(0)).pos)


def foreign_spans(kept: Column, is_competitor: Callable[[Column], Column]) -> Column:
    """Links and images of competitors, social sites and app stores among ``kept`` tokens."""
    def link_text(i: Column, t: Column) -> Column:
        # Dropping only shortens a subtree, so its tokens lie within its original length.
        inner = F.filter(F.slice(kept, i + 1, t.close - t.pos + 1), lambda x: x.pos <= t.close)
        return F.lower(text_of(inner, ""))

    def names_app(i: Column, t: Column) -> Column:
        return let(link_text(i, t), lambda words: contains_any(words, K.APP_PHRASES))

    indexed = F.transform(kept, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    opened = F.filter(indexed, lambda x: (x.t.kind == "open") & x.t.tag.isin("a", "img"))

    def test(x: Column) -> Column:
        href, src = x.t.attrs["href"], x.t.attrs["src"]
        bad_link = is_competitor(href) | is_social(href) | names_app(x.i, x.t)
        bad_image = is_competitor(src) | contains_any(
            F.lower(F.coalesce(x.t.attrs["alt"], F.lit(""))), K.IMAGE_ALT_BRANDS)
        return F.when(x.t.tag == "a", bad_link).otherwise(bad_image)

    return F.transform(F.filter(opened, test),
                       lambda x: F.struct(x.t.pos.alias("pos"), x.t.close.alias("close")))


def scrub_tokens(tokens: Column, house: str = K.DEFAULT_HOUSE) -> Column:
    """Brand names out of texts and visible attributes, tracking attributes off plain web links.

    A comment whose text changes becomes page text, as it does in the data this must agree with.
    """
    def scrub(t: Column) -> Column:
        href = F.coalesce(t.attrs["href"], F.lit(""))
        plain_link = (t.tag == "a") & href.startswith("http") & ~href.contains("gov.in") & ~href.contains("nic.in")
        attrs = F.map_filter(t.attrs, lambda k, v: ~(plain_link & k.isin(*K.DROPPED_LINK_ATTRIBUTES)))
        attrs = F.transform_values(attrs, lambda k, v: F.when(
            k.isin(*K.SCRUBBED_ATTRIBUTES), brand_scrub(v, house)).otherwise(v))
        opened = _rewrite(t, attrs=attrs)
        kind = lambda clean: F.when((t.kind == "comment") & (clean != t.text), "text").otherwise(t.kind)
        return F.when(t.kind == "open", opened).when(t.kind == "close", t).otherwise(
            let(brand_scrub(t.text, house), lambda clean: _rewrite(t, text=clean, kind=kind(clean))))

    return F.transform(tokens, scrub)
