"""Text columns.  Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill import constants as K

# Unicode-aware \s \d \b, to agree with the data's non-ASCII spaces and digits.
UNICODE = "(?U)"
UNICODE_ANY_CASE = "(?iU)"
_SPACE = r"[\s\x1c-\x1f]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; array lambdas would otherwise repeat its expression.

    A fold over nothing, started with ``value``: taking it out of an array again would look up the type of all of ``body`` for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def present(value: Column | str) -> Column:
    """NULL for both forms of missing: NULL and the empty string."""
    return F.nullif(col(value), F.lit(""))


def first_present(*values: Column | str) -> Column:
    return F.coalesce(*[present(v) for v in values])


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def strip_spaces(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"{UNICODE}^{_SPACE}+|{_SPACE}+$", "")


def normalize_spaces(value: Column | str) -> Column:
    """Runs of white space become one blank, ends are trimmed, NULL becomes ''."""
    return F.trim(F.regexp_replace(text_or_empty(value), f"{UNICODE}{_SPACE}+", " "))


def quote(literal: str) -> str:
    """Regex-quote a literal for java.util.regex."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in literal)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """Whether any literal occurs.  One alternation, so ``text`` appears once in the plan."""
    return text.rlike("|".join(quote(n) for n in needles))


def has_word(text: Column, words: Sequence[str], flags: str = UNICODE_ANY_CASE) -> Column:
    """Whether any of the words or phrases stands there as whole words."""
    return text.rlike(flags + r"\b(?:" + "|".join(words) + r")\b")


def brand_scrub(value: Column | str, house: str = K.DEFAULT_HOUSE) -> Column:
    """Replace brand names by the house name, then delete app-store phrases.

    Both steps are ordered passes, because a deletion may join its neighbours into a later
    phrase.  Every pattern needs one of a few short strings; where none occurs the passes are skipped, and
    so are those of a step none of whose patterns the text at hand matches, as the first would change nothing.
    """
    def hinted(text: Column) -> Column:
        return let(F.lower(text), lambda lowered: reduce(lambda a, b: a | b, [lowered.contains(hint) for hint in K.SCRUB_HINTS]))

    def passes(text: Column, flags: str, patterns: Sequence[str], new: str) -> Column:
        clean = text
        for pattern in patterns:
            clean = F.regexp_replace(clean, flags + pattern, new)
        return F.when(text.rlike(flags + "(?:" + "|".join(patterns) + ")"), clean).otherwise(text)

    def scrub(text: Column) -> Column:
        branded = passes(text, UNICODE_ANY_CASE, K.BRAND_PATTERNS, house)
        return let(branded, lambda clean: passes(clean, "(?iu)", [quote(p) for p in K.APP_PHRASES], ""))

    return let(text_or_empty(value), lambda text: F.when(hinted(text), scrub(text)).otherwise(text))


def escape_html(value: Column | str) -> Column:
    text = text_or_empty(value)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def type_label(kind: Column | str) -> Column:
    kind = col(kind)
    return F.when(kind == "ut", "UT").when(kind == "central", "Central").otherwise("State")


def state_key(value: Column | str) -> Column:
    return F.lower(strip_spaces(F.replace(text_or_empty(value), F.lit("+"), F.lit(" "))))


def strip_size_note(value: Column | str) -> Column:
    return strip_spaces(F.regexp_replace(col(value), UNICODE_ANY_CASE + K.SIZE_NOTE_PATTERN, ""))


def without_expanders(value: Column | str) -> Column:
    """A card title without the words of its expander."""
    return normalize_spaces(F.regexp_replace(text_or_empty(value), UNICODE + K.CARD_NOISE_PATTERN, " "))


def without_badge(value: Column | str) -> Column:
    """A card title without a leading ``new`` badge, which is taken off whatever follows it."""
    words = normalize_spaces(text_or_empty(value))
    return F.when(words.startswith("new"), strip_spaces(F.substring(words, 4, 1 << 30))).otherwise(words)


#: The rule of each site that has one; the others' titles stay.
CARD_TITLES = {"freshersworld": without_expanders, "indeed": without_badge}


def clean_card_title(value: Column | str, site: Column | str) -> Column:
    """The title rule of the card's site."""
    title, site = normalize_spaces(text_or_empty(value)), col(site)
    for name, rule in CARD_TITLES.items():
        title = F.when(site == name, rule(value)).otherwise(title)
    return title


def split_company_role(title: Column | str, default_company: str = "We Work Remotely") -> Column:
    """Struct (company, role) split at the first ``': '``."""
    title = col(title)
    cut = F.instr(title, F.lit(": "))
    return F.when(
        cut > 0,
        F.struct(F.substring(title, F.lit(1), cut - 1).alias("company"),
                 F.substring(title, cut + 2, F.length(title)).alias("role")),
    ).otherwise(F.struct(F.lit(default_company).alias("company"), title.alias("role")))


def split_qualification(value: Column | str) -> Column:
    parts = F.transform(F.split(text_or_empty(value), ","), strip_spaces)
    return F.filter(parts, lambda p: p != "")


def clean_skills(skills: Column | str, house: str = K.DEFAULT_HOUSE) -> Column:
    cleaned = F.transform(F.coalesce(col(skills), F.array().cast("array<string>")),
                          lambda s: brand_scrub(s, house))
    return F.filter(cleaned, lambda s: s != "")


def slice_text(value: Column | str, length: int | None = K.TEXT_SLICE) -> Column:
    """The first ``length`` characters; None keeps them all."""
    return text_or_empty(value) if length is None else F.substring(text_or_empty(value), 1, length)
