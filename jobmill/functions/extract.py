"""Facts read out of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.numbers import format_indian, parse_count
from jobmill.functions.text import UNICODE_ANY_CASE, col, present, strip_spaces, text_or_empty


def _first_group(text: Column, pattern: str) -> Column:
    return present(F.regexp_extract(text, UNICODE_ANY_CASE + pattern, 1))


def extract_last_date(text: Column | str) -> Column:
    hits = [_first_group(text_or_empty(text), p) for p in K.LAST_DATE_PATTERNS]
    return F.coalesce(strip_spaces(F.coalesce(*hits)), F.lit(K.INFO_DEFAULTS["last_date"]))


def extract_vacancies(text: Column | str) -> Column:
    return F.coalesce(_first_group(text_or_empty(text), K.VACANCY_PATTERN),
                      F.lit(K.INFO_DEFAULTS["vacancies"]))


def extract_exam_date(text: Column | str) -> Column:
    return F.coalesce(strip_spaces(_first_group(text_or_empty(text), K.EXAM_DATE_PATTERN)),
                      F.lit(K.INFO_DEFAULTS["exam_date"]))


def classify_title(title: Column | str) -> Column:
    lowered = F.lower(text_or_empty(title))
    label = F.when(F.lit(False), F.lit(""))
    for name in K.TITLE_LABELS:
        label = label.when(lowered.contains(name.lower()), name)
    return label.otherwise(K.INFO_DEFAULTS["info_category"])


def max_year(text: Column | str) -> Column:
    """Largest 20dd year in the text, NULL if there is none."""
    years = F.regexp_extract_all(text_or_empty(text), F.lit("(?U)" + K.ANY_YEAR), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int"))).cast("bigint")


def extract_notice_dates(text: Column | str) -> Column:
    text = text_or_empty(text)

    def one(pattern: str) -> Column:
        return strip_spaces(F.regexp_extract(text, UNICODE_ANY_CASE + pattern, 1))

    return F.struct(one(K.UPDATED_PATTERN).alias("updated"), one(K.CLOSING_PATTERN).alias("closing"),
                    one(K.POSTED_PATTERN).alias("posted"))


def extract_applicants(text: Column | str) -> Column:
    """Struct of the first applicant total, by pattern order, whose count is above zero.

    ``text`` should be normalised by :func:`normalize_spaces` and a plain column, as the patterns
    refer to it many times.  A pattern is only searched where its own word occurs; number and unit
    are then read from the short match.  Words such as "over" before the number are optional and
    change neither, so they are not searched for.
    """
    content = text_or_empty(text)
    lowered = F.lower(content)
    hits = []
    for basis, shape in K.APPLICANT_PATTERNS:
        pattern = UNICODE_ANY_CASE + shape.replace("{n}", K.COUNT_TOKEN)
        hit = F.when(lowered.contains(basis.split(" ")[-1]), F.regexp_extract(content, pattern, 0)).otherwise("")
        hits.append(F.struct(F.lit(basis).alias("basis"), F.lit(K.APPLICANT_LABELS[basis]).alias("label"), hit.alias("hit")))
    token = UNICODE_ANY_CASE + K.COUNT_TOKEN
    counted = F.transform(F.filter(F.array(*hits), lambda h: h.hit != ""), lambda h: F.struct(
        h.basis.alias("basis"), h.label.alias("label"),
        parse_count(F.regexp_extract(h.hit, token, 1), F.regexp_extract(h.hit, token, 2)).alias("n")))
    return F.get(F.filter(counted, lambda h: h.n > 0), F.lit(0))


def applicant_columns(hit: Column | str) -> dict[str, Column]:
    """The five listing columns made from the result of :func:`extract_applicants`."""
    hit = col(hit)
    default = K.INFO_DEFAULTS
    shown = format_indian(hit.n)
    note = F.concat(F.lit("Source page mentions "), shown, F.lit(" candidates "), hit.basis, F.lit("."))
    return {
        "applicant_count": hit.n,
        "applicant_count_display": F.coalesce(shown, F.lit(default["applicant_count_display"])),
        "applicant_metric_label": F.coalesce(hit.label, F.lit(default["applicant_metric_label"])),
        "applicant_metric_note": F.coalesce(note, F.lit(default["applicant_metric_note"])),
        "applicant_metric_basis": F.coalesce(hit.basis, F.lit(default["applicant_metric_basis"])),
    }
