"""URL columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill.functions.text import col, strip_spaces, text_or_empty

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"


def url_normalize(url: Column | str) -> Column:
    """Trim and drop the fragment."""
    return F.split_part(strip_spaces(text_or_empty(url)), F.lit("#"), F.lit(1))


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), _SCHEME, 1))


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), _AUTHORITY, 1))


def url_path(url: Column | str) -> Column:
    """Lowercase path without the parameters of the last segment."""
    path = F.regexp_extract(text_or_empty(url), _PATH, 1)
    return F.lower(F.regexp_replace(path, r";[^/]*$", ""))


def url_parts(url: Column | str) -> Column:
    return F.struct(url_scheme(url).alias("scheme"), url_host(url).alias("host"),
                    url_path(url).alias("path"))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` with one fold over the path segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    inner = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))
    kept = F.filter(F.concat(inner, F.array(last)), lambda s: s != "")
    folded = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(last.isin("", ".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(folded, tail), "/"))


def url_absolute(href: Column | str, base: Column | str) -> Column:
    """Resolve ``href`` against the page it stands on, then drop the fragment."""
    href, base = strip_spaces(text_or_empty(href)), strip_spaces(text_or_empty(base))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.concat(scheme, F.lit("//"), F.regexp_extract(base, _AUTHORITY, 1))
    base_path = F.regexp_extract(base, _PATH, 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    query = F.regexp_extract(href, _QUERY, 1)
    resolved = (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when((path == "") & (query == ""), base)
        .when(path == "", F.concat(root, base_path, query))
        .when(path.startswith("/"), F.concat(root, _without_dot_segments(path), query))
        .otherwise(F.concat(root, _without_dot_segments(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), query))
    )
    return url_normalize(resolved)


def join_site_path(href: Column | str, home: str) -> Column:
    """Homepage rule: absolute links stay, others are glued to the home address."""
    href = col(href)
    return F.when(href.startswith("http"), href).otherwise(
        F.concat(F.lit(home.rstrip("/") + "/"), F.regexp_replace(href, r"^/+", "")))


def listing_id(category: Column | str, url: Column | str) -> Column:
    """md5 of ``category:url``, over the url as given."""
    return F.md5(F.concat(col(category), F.lit(":"), col(url)))
