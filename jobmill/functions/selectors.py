"""Cards of a page by selectors that come as data.

A selector is a list of alternatives (comma), each a path of tests joined by descendant (blank) or child (``>``); a test
names a tag, classes (``.a``), an id (``#a``) and attributes (``[a]``, ``[a=b]``, ``[a*=b]``, ``[a^=b]``).  All selectors of one set are
compiled into one automaton over the elements of a page: an element's state says how far each path has come at it, and
states are made the first time they occur and then looked up.  So a page costs one pass, however many selectors there are.

The rules of a site are rows (card, card_sel, field, sel, attr, nth, every, fallback, words); ``card_values`` reads them from a
column, so every page may have its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.functions.html import STEP_PAGES, tokenize_page

CARDS = "array<struct<card:int,values:map<string,string>>>"
_ARROW = pa.list_(pa.struct([("card", pa.int32()), ("values", pa.map_(pa.string(), pa.string()))]))
#: What a rule row consists of besides its site.
RULE = ("card", "card_sel", "field", "sel", "attr", "nth", "every", "fallback", "words")

_TEST = re.compile(r"""\s*(?:(?P<comma>,)|(?P<child>>)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]|(?P<tag>\*|[\w-]+))""")


class Test(NamedTuple):
    """What one element of a path must be like."""

    child: bool  # of the element before it, not just inside it
    tag: str
    classes: tuple[str, ...]
    id: str
    attrs: tuple[tuple[str, str, str], ...]

    def fits(self, tag: str, classes: frozenset[str], name: str, attrs: dict[str, str]) -> bool:
        return (self.tag in ("", "*", tag) and (not self.id or self.id == name) and classes.issuperset(self.classes)
                and all(holds(attrs, a) for a in self.attrs))


def holds(attrs: dict[str, str], test: tuple[str, str, str]) -> bool:
    name, op, wanted = test
    value = attrs.get(name)
    if value is None:
        return False
    return {"": True, "=": value == wanted, "*=": bool(wanted) and wanted in value, "^=": bool(wanted) and value.startswith(wanted)}[op]


def parse(selector: str) -> list[list[Test]]:
    """The alternatives of a selector, each a path of tests."""
    paths, path, now, at, child = [], [], {}, 0, False

    def close() -> None:
        nonlocal now, child
        if now:
            path.append(Test(child, now.get("tag", ""), tuple(now.get("classes", ())), now.get("id", ""), tuple(now.get("attrs", ()))))
            now, child = {}, False

    selector = selector.rstrip()
    while at < len(selector):
        found = _TEST.match(selector, at)
        if not found:
            raise ValueError(f"no selector: {selector!r}")
        kind, apart = found.lastgroup, found.start() < found.end() and selector[found.start()].isspace()
        if kind in ("comma", "child"):
            close()
            if not path or child:
                raise ValueError(f"no selector: {selector!r}")
            if kind == "comma":
                paths.append(path)
                path = []
            else:
                child = True
        else:
            if apart or kind == "tag":
                close()
            if kind == "tag":
                now["tag"] = found["tag"].lower()
            elif kind == "cls":
                now.setdefault("classes", []).append(found["cls"])
            elif kind == "id":
                now["id"] = found["id"]
            else:
                value = next((found[g] for g in ("dq", "sq", "bare") if found[g] is not None), "")
                now.setdefault("attrs", []).append((found["attr"].lower(), found["op"] or "", value))
        at = found.end()
    close()
    if not path or child:
        raise ValueError(f"no selector: {selector!r}")
    return [*paths, path]


class Automaton:
    """All paths of some selectors at once; ``step`` goes from an element to one of its children."""

    def __init__(self, selectors: list[str]) -> None:
        self.paths = [(number, path) for number, selector in enumerate(selectors) for path in parse(selector)]
        self.tests = sorted({a for _, path in self.paths for test in path for a in test.attrs})
        self.names = sorted({a[0] for a in self.tests})
        self.states: list[frozenset] = [frozenset((p, 0, False) for p in range(len(self.paths)))]
        self.numbers = {self.states[0]: 0}
        self.known: dict[tuple, tuple[tuple[int, ...], int]] = {}

    def step(self, state: int, tag: str, attrs: dict[str, str]) -> tuple[tuple[int, ...], int]:
        """The selectors that an element matches, and the state for its children."""
        if attrs:
            key = (state, tag, attrs.get("class"), attrs.get("id"), tuple([holds(attrs, a) for a in self.tests]) if self.tests else ())
        else:
            key = (state, tag)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._made(state, tag, attrs)
        return found

    def _made(self, state: int, tag: str, attrs: dict[str, str]) -> tuple[tuple[int, ...], int]:
        matched, after = set(), set()
        attrs = attrs or {}
        classes = frozenset(attrs.get("class", "").split())
        for path, place, child in self.states[state]:
            number, tests = self.paths[path]
            if not child:
                after.add((path, place, False))
            if tests[place].fits(tag, classes, attrs.get("id", ""), attrs):
                if place + 1 == len(tests):
                    matched.add(number)
                else:
                    after.add((path, place + 1, tests[place + 1].child))
        after = frozenset(after)
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return tuple(sorted(matched)), self.numbers[after]


def spaced(text: str) -> str:
    return " ".join(text.split())


class Rules:
    """The compiled rules of one site."""

    def __init__(self, rows: list[dict]) -> None:
        self.cards = sorted({(r["card"], r["card_sel"]) for r in rows})
        self.fields = {card: [r for r in rows if (r["card"], r["card_sel"]) == card] for card in self.cards}
        self.outer = Automaton([selector for _, selector in self.cards])
        self.inner = {card: Automaton([r["sel"] for r in own if r["sel"]]) for card, own in self.fields.items()}
        self.places = {}
        for card, own in self.fields.items():
            with_selector = [i for i, r in enumerate(own) if r["sel"]]
            self.places[card] = {field: number for number, field in enumerate(with_selector)}

    def read(self, rows: list[list]) -> list[dict]:
        """The cards among the token rows of a page, by card selector and then in document order."""
        state_of: dict[int, int] = {}
        active: list[tuple] = []  # (card, first row, last row, states, matches by selector)
        found: list[tuple] = []
        step, inner = self.outer.step, self.inner
        for pos, close, parent, _, kind, tag, attrs, _ in rows:
            if kind != "open":
                continue
            if attrs:
                attrs = dict(attrs)
            cards, state_of[pos] = step(state_of.get(parent, 0), tag, attrs)
            while active and pos > active[-1][2]:  # elements do not cross: the last ones end first
                active.pop()
            for number in cards:
                card = self.cards[number]
                active.append((card, pos, close, {}, [[] for _ in self.places[card]]))
                found.append(active[-1])
            for card, _, _, states, matches in active:
                hits, states[pos] = inner[card].step(states.get(parent, 0), tag, attrs)
                for number in hits:
                    matches[number].append(pos)
        found.sort(key=lambda f: (f[0][0], f[1]))
        return [{"card": card[0], "values": list(self._values(rows, card, first, last, matches).items())} for card, first, last, _, matches in found]

    def _values(self, rows, card, first, last, matches) -> dict[str, str]:
        def pieces(start: int, stop: int) -> list[str]:
            return [p for r in rows[start:stop + 1] if r[4] == "text" and (p := r[7].strip())]

        def read(pos: int, attr: str) -> str:
            if attr:
                return next((value for name, value in rows[pos][6] if name == attr), "")
            return " ".join([word for r in rows[pos + 1:rows[pos][1]] if r[4] == "text" for word in r[7].split()])

        out = {}
        for place, rule in enumerate(self.fields[card]):
            if rule["words"]:  # the first text piece that holds one of the words
                value = next((q for p in pieces(first, last) if any(w in (q := spaced(p)).lower() for w in rule["words"])), "")
            elif not rule["sel"]:  # the card itself
                value = read(first, rule["attr"])
            else:
                hits = matches[self.places[card][place]]
                if rule["every"]:
                    value = ",".join(read(pos, rule["attr"]) for pos in hits)
                else:
                    value = read(hits[rule["nth"]], rule["attr"]) if len(hits) > rule["nth"] else ""
            out[rule["field"]] = value or rule["fallback"]
        return out


_compiled: dict[str, Rules] = {}


def _rules(text: str) -> Rules:
    if text not in _compiled:
        if len(_compiled) > 1000:
            _compiled.clear()
        _compiled[text] = Rules(json.loads(text))
    return _compiled[text]


def card_values(html: Column | str, rules: Column | str) -> Column:
    """The cards of each page: its card selector's number and the values of its fields."""
    @F.arrow_udf(CARDS)
    def cards(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, texts in batches:
            for start in range(0, max(len(pages), 1), STEP_PAGES):  # few pages and cards alive, however many a batch has
                part = zip(pages.slice(start, STEP_PAGES).to_pylist(), texts.slice(start, STEP_PAGES).to_pylist(), strict=True)
                yield pa.array([[] if html is None or text is None else _rules(text).read(tokenize_page(html)) for html, text in part], _ARROW)

    return cards(html, rules)


def rules_by_site(rules: DataFrame) -> DataFrame:
    """(site, _rules): all rule rows of a site as one text."""
    row = F.struct(*[F.col(c) for c in RULE])
    return rules.groupBy("site").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("_rules"))
