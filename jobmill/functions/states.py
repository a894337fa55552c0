"""State tagging: which states a listing talks about, its label and its portal."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import UNICODE, brand_scrub, has_word, normalize_spaces, quote, slice_text

ENTRIES = [e for e in K.STATE_DIRECTORY if e[1] in ("state", "ut")]
PORTALS = {name: portal for name, _, portal, _ in ENTRIES}
SCOPE_PORTALS = {name: portal for name, kind, portal, _ in K.STATE_DIRECTORY if kind == "central"}


def alias_pattern(aliases: list[str]) -> str:
    """An alias counts when no letter touches it; digits may."""
    return "(?<![a-z])(?:" + "|".join(quote(a.lower()) for a in aliases) + ")(?![a-z])"


def scope_text(title: Column, body: Column, house: str = K.DEFAULT_HOUSE, length: int | None = K.TEXT_SLICE) -> Column:
    """Scrubbed title plus the first ``length`` characters of the body (None: all), lowercase, single blanks."""
    title = brand_scrub(title, house)
    return F.lower(normalize_spaces(F.concat_ws(" ", title, slice_text(body, length))))


def _words(alias: str) -> list[str]:
    return re.findall("[a-z]+", alias.lower())


def _key_word(alias: str) -> str:
    """The longest word of an alias; it must stand in the text as a word of its own."""
    return max(_words(alias), key=len)


KEY_WORDS = sorted({_key_word(a) for _, _, _, aliases in ENTRIES for a in aliases})


def state_words(text: Column) -> Column:
    """The words of ``text`` that any state alias could be found by; empty for most texts."""
    return F.array_distinct(F.filter(F.split(text, "[^a-z]+"), lambda word: word.isin(*KEY_WORDS)))


def matched_states(text: str, words: str) -> Column:
    """Array of matched state names in directory order; both arguments name columns.

    ``text`` comes from :func:`scope_text` and ``words`` from :func:`state_words`.  A projection of
    literal patterns: nothing explodes and nothing shuffles, and a pattern is only searched where
    one of its words occurs.  Written as one SQL expression, which is quicker to build than several
    hundred column objects.
    """
    def literal(value: str) -> str:
        return 'r"' + value + '"'

    tests = []
    for name, _, _, aliases in ENTRIES:
        near = ", ".join(literal(w) for w in sorted({_key_word(a) for a in aliases}))
        tests.append(f"CASE WHEN arrays_overlap({words}, array({near})) AND {text} RLIKE {literal(alias_pattern(aliases))} "
                     f"THEN {literal(name)} END")
    return F.expr(f"CASE WHEN size({words}) = 0 THEN cast(array() AS array<string>) ELSE array_compact(array({', '.join(tests)})) END")


def _lookup(name: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, name), F.lit(""))


def scope_kind(text: Column) -> Column:
    """'remote', 'everywhere', 'central' or '': the first scope whose words the text holds."""
    return (F.when(has_word(text, K.REMOTE_WORDS, UNICODE), "remote")
            .when(has_word(text, K.ALL_INDIA_WORDS, UNICODE), "everywhere")
            .when(has_word(text, K.CENTRAL_WORDS, UNICODE), "central").otherwise(""))


def tag_states(kind: Column, states: Column) -> dict[str, Column]:
    """Columns ``states``, ``state_label`` and ``official_state_portal``.

    ``kind`` comes from :func:`scope_kind` and ``states`` from :func:`matched_states`; pass
    materialised columns so the patterns run once.
    """
    none = F.array().cast("array<string>")
    remote, everywhere, central = kind == "remote", kind == "everywhere", kind == "central"
    count = F.size(states)
    label = (
        F.when(remote, "Remote").when(everywhere, "All India")
        .when(count > 3, "All States").when(count > 0, F.array_join(states, " / "))
        .when(central, "Central Govt").otherwise("All India")
    )
    portal = (
        F.when(remote, "").when(everywhere, SCOPE_PORTALS["All India"])
        .when(count == 1, _lookup(F.get(states, F.lit(0)), PORTALS)).when(count > 1, "")
        .when(central, SCOPE_PORTALS["Central Govt"]).otherwise(SCOPE_PORTALS["All India"])
    )
    return {
        "states": F.when(remote | everywhere, none).otherwise(states),
        "state_label": label,
        "official_state_portal": portal,
    }
