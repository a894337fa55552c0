"""SQL fragments shared by the DuckDB oracles."""

from __future__ import annotations

from jobmill import constants as K


def spaces(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def scrub(x: str, house: str = K.DEFAULT_HOUSE) -> str:
    for pattern in K.BRAND_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{house}', 'gi')"
    for phrase in K.APP_PHRASES:
        x = f"regexp_replace({x}, '{phrase.replace('.', '[.]')}', '', 'gi')"
    return x


def any_of(x: str, words: tuple[str, ...] | list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def norm_url(x: str) -> str:
    return f"split_part(trim({x}), '#', 1)"


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def path(x: str) -> str:
    return f"lower(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"


def social(x: str) -> str:
    return any_of(f"lower({x})", K.SOCIAL_HOSTS)


def same_domain(x: str, site: str, domains: dict[str, str]) -> str:
    return "(" + " OR ".join(f"({site} = '{s}' AND contains({host(x)}, '{d}'))" for s, d in domains.items()) + ")"


def signal(title: str, url: str, category: str) -> str:
    text = f"lower({title} || ' ' || {url})"
    terms = " OR ".join(f"({category} = '{c}' AND {any_of(text, t)})" for c, t in K.SIGNAL_TERMS.items())
    return f"(regexp_matches({text}, '{K.SIGNAL_YEAR}') OR {terms})"


def skipped(x: str, site: str) -> str:
    tests = []
    for s, skips in K.SKIP_PATHS.items():
        one = " OR ".join(f"{path(x)} = '{p.rstrip('/')}' OR starts_with({path(x)}, '{p}')" for p in skips)
        tests.append(f"({site} = '{s}' AND ({one}))")
    return "(" + " OR ".join(tests) + ")"


def candidate(title: str, url: str, site: str, category: str, domains: dict[str, str] = K.SITE_DOMAINS) -> str:
    clean = spaces(title)
    titles = ", ".join(f"'{t}'" for t in K.SKIP_TITLES)
    return (f"({title} <> '' AND {url} <> '' AND length({clean}) >= 10 AND lower({clean}) NOT IN ({titles}) "
            f"AND NOT {social(url)} AND {scheme(url)} IN ('http', 'https') AND NOT {skipped(url, site)} "
            f"AND {same_domain(url, site, domains)} AND {signal(clean, url, category)})")


def first_group(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1, 'i'), '')"


def last_date(text: str) -> str:
    hits = ", ".join(first_group(text, p) for p in K.LAST_DATE_PATTERNS)
    return f"coalesce(trim(coalesce({hits})), '{K.INFO_DEFAULTS['last_date']}')"


def vacancies(text: str) -> str:
    return f"coalesce({first_group(text, K.VACANCY_PATTERN)}, 'Various')"


def exam_date(text: str) -> str:
    return f"coalesce({first_group(text, K.EXAM_DATE_PATTERN)}, 'As per Schedule')"


def title_label(title: str) -> str:
    whens = " ".join(f"WHEN contains(lower({title}), '{n.lower()}') THEN '{n}'" for n in K.TITLE_LABELS)
    return f"CASE {whens} ELSE 'Central Govt' END"


def indian(x: str) -> str:
    s = f"cast({x} AS string)"
    return (f"CASE WHEN length({s}) <= 3 THEN {s} ELSE ltrim(reverse(regexp_replace(reverse(left({s}, length({s}) - 3)), "
            f"'(\\d{{2}})', '\\1,', 'g')), ',') || ',' || right({s}, 3) END")


def count_of(number: str, unit: str) -> str:
    factor = f"CASE lower({unit}) " + " ".join(
        f"WHEN '{u}' THEN {f}" for u, f in K.UNIT_FACTORS.items()) + " ELSE 1 END"
    return (f"coalesce(cast(round_even(try_cast(replace({number}, ',', '') AS double) * ({factor}), 0) AS bigint), 0)")


def applicants(text: str) -> str:
    """SQL list of struct(basis, n) in pattern order, hits above zero only."""
    hits = []
    for basis, shape in K.APPLICANT_PATTERNS:
        pattern = shape.replace("{n}", K.COUNT_TOKEN)
        number = f"regexp_extract({text}, '{pattern}', 1, 'i')"
        unit = f"regexp_extract({text}, '{pattern}', 2, 'i')"
        hits.append(f"{{'basis': '{basis}', 'n': {count_of(number, unit)}}}")
    return f"list_filter([{', '.join(hits)}], lambda h: h.n > 0)[1]"


def applicant_label(basis: str) -> str:
    whens = " ".join(f"WHEN '{b}' THEN '{label}'" for b, label in K.APPLICANT_LABELS.items())
    return f"CASE {basis} {whens} ELSE 'Not officially disclosed' END"


def applicant_note(basis: str, shown: str) -> str:
    return (f"CASE WHEN {basis} IS NULL THEN '{K.INFO_DEFAULTS['applicant_metric_note']}' ELSE "
            f"'Source page mentions ' || {shown} || ' candidates ' || {basis} || '.' END")


def alias_hit(text: str, aliases: list[str]) -> str:
    body = "|".join(a.replace("&", "[&]") for a in aliases)
    return f"regexp_matches({text}, '(^|[^a-z])({body})([^a-z]|$)')"


def states(text: str) -> str:
    tests = [f"CASE WHEN {alias_hit(text, aliases)} THEN '{name}' END"
             for name, kind, _, aliases in K.STATE_DIRECTORY if kind != "central"]
    return f"list_filter([{', '.join(tests)}], lambda s: s IS NOT NULL)"


def words(text: str, found: tuple[str, ...]) -> str:
    return "regexp_matches({}, '\\b(?:{})\\b', 'i')".format(text, "|".join(found))


def state_label(text: str, found: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '\\bremote\\b') THEN 'Remote' "
            f"WHEN {words(text, K.ALL_INDIA_WORDS)} THEN 'All India' "
            f"WHEN len({found}) > 3 THEN 'All States' WHEN len({found}) > 0 THEN array_to_string({found}, ' / ') "
            f"WHEN {words(text, K.CENTRAL_WORDS)} THEN 'Central Govt' ELSE 'All India' END")


def portal(text: str, found: str) -> str:
    portals = " ".join(f"WHEN '{n}' THEN '{p}'" for n, k, p, _ in K.STATE_DIRECTORY if k != "central")
    scope = {n: p for n, k, p, _ in K.STATE_DIRECTORY if k == "central"}
    return (f"CASE WHEN regexp_matches({text}, '\\bremote\\b') THEN '' "
            f"WHEN {words(text, K.ALL_INDIA_WORDS)} THEN '{scope['All India']}' "
            f"WHEN len({found}) = 1 THEN CASE {found}[1] {portals} END WHEN len({found}) > 1 THEN '' "
            f"WHEN {words(text, K.CENTRAL_WORDS)} THEN '{scope['Central Govt']}' ELSE '{scope['All India']}' END")


def kept_states(text: str, found: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, '\\bremote\\b') OR {words(text, K.ALL_INDIA_WORDS)} "
            f"THEN '' ELSE array_to_string({found}, ' / ') END")


def values(rows: list[tuple], columns: str) -> str:
    """Inline table: (VALUES ...) AS t(columns) body for a FROM clause."""
    def text(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


DIRECTORY = values([(n, k, p, i) for i, (n, k, p, _) in enumerate(K.STATE_DIRECTORY)], "name, type, portal_url, dir_pos")
ALIASES = values([(n, a, i) for i, (n, k, _, aliases) in enumerate(K.STATE_DIRECTORY) if k != "central"
                  for a in aliases], "name, alias, dir_pos")
CATEGORY_TABLE = values([(c, i) for i, c in enumerate(K.CATEGORIES)], "category, category_rank")

CURRENCY = """CASE WHEN lo <> 0 AND hi <> 0 THEN '$' || format('{:,}', lo) || ' - $' || format('{:,}', hi)
  WHEN lo <> 0 THEN 'From $' || format('{:,}', lo) WHEN hi <> 0 THEN 'Up to $' || format('{:,}', hi) ELSE '' END"""


def whole(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+$') THEN cast(trim({x}) AS bigint) ELSE 0 END"


def market_date(x: str) -> str:
    """ISO stamps and the one mail form of the inputs."""
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') "
            f"THEN strftime(cast(left({x}, 10) AS date), '%d %b %Y') "
            f"WHEN regexp_matches({x}, '^[A-Z][a-z]{{2}}, [0-9]') THEN "
            f"strftime(strptime(regexp_extract({x}, ', ([0-9]+ [A-Za-z]+ [0-9]+)', 1), '%d %b %Y'), '%d %b %Y') ELSE {x} END")


PAGE_TEXT = r"""array_to_string(list_filter(list_transform(string_split_regex(
  regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '<x>', 'gs'), '<[^>]*>'),
  lambda p: trim(replace(replace(replace(replace(p, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
                 ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), ' ')"""
