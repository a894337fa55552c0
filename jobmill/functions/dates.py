"""Date columns.  Calendar arithmetic only, never through a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill.functions.text import col, let, normalize_spaces

_ISO = r"^(\d{4}-?\d{2}-?\d{2})T\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?$"
_RFC = (r"(?i)^(?:[a-z]{3,},?\s+)?(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
        r"[a-z]*\s+(\d{4}|\d{2})\s+\d{1,2}[:.]\d{1,2}")


def format_market_date(value: Column | str) -> Column:
    """ISO or mail date -> ``21 Apr 2026`` as written, without a zone shift; else unchanged."""
    def full(year: Column) -> Column:
        return F.when(F.length(year) == 4, year).when(
            year.try_cast("int") > 68, F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))

    def shown(raw: Column) -> Column:
        # Tested first, as a date that cannot be read costs an exception.
        iso = F.try_to_date(F.replace(F.regexp_extract(raw, _ISO, 1), F.lit("-"), F.lit("")), "yyyyMMdd")
        rfc = F.try_to_date(
            F.concat_ws(" ", F.lpad(F.regexp_extract(raw, _RFC, 1), 2, "0"),
                        F.initcap(F.regexp_extract(raw, _RFC, 2)), let(F.regexp_extract(raw, _RFC, 3), full)),
            "dd MMM yyyy")
        day = F.when(raw.rlike(_ISO), iso).when(raw.rlike(_RFC), rfc)
        return F.coalesce(F.date_format(day, "dd MMM yyyy"), raw)

    return let(normalize_spaces(value), shown)


def age_ymd(born: Column | str, as_of: Column | str) -> Column:
    """Years, months and days between two dates, with the totals derived from them.

    A negative day count borrows the length of the month before ``as_of``, once; so
    2000-01-31 to 2026-03-01 keeps -2 days.
    """
    born, as_of = col(born), col(as_of)
    months = (F.year(as_of) - F.year(born)) * 12 + F.month(as_of) - F.month(born)
    days = F.dayofmonth(as_of) - F.dayofmonth(born)
    borrow = days < 0
    months = months - borrow.cast("int")
    days = days + F.when(borrow, F.dayofmonth(F.last_day(F.add_months(as_of, -1)))).otherwise(0)
    total_days = F.datediff(as_of, born)
    return F.struct(
        F.floor(months / 12).cast("bigint").alias("years"),
        F.pmod(months, F.lit(12)).cast("bigint").alias("months"),
        days.cast("bigint").alias("days"),
        total_days.cast("bigint").alias("total_days"),
        F.floor(total_days / 7).cast("bigint").alias("total_weeks"),
        months.cast("bigint").alias("total_months"),
        (total_days * 24).cast("bigint").alias("total_hours"),
        (total_days * 1440).cast("bigint").alias("total_minutes"),
        F.date_format(born, "EEEE").alias("birth_weekday"),
        F.datediff(_next_birthday(born, as_of), as_of).cast("bigint").alias("days_to_birthday"),
    )


def _next_birthday(born: Column, as_of: Column) -> Column:
    """First birthday after ``as_of``; 29 February rolls over to 1 March in common years."""
    def in_year(year: Column) -> Column:
        month_start = F.make_date(year, F.month(born), F.lit(1))
        return F.date_add(month_start, F.dayofmonth(born) - 1)

    this_year = in_year(F.year(as_of))
    # Moving an already rolled-over 1 March by a year keeps 1 March.
    rolled = F.make_date(F.year(as_of) + 1, F.month(this_year), F.dayofmonth(this_year))
    return F.when(this_year <= as_of, F.coalesce(rolled, in_year(F.year(as_of) + 1))).otherwise(this_year)


def age_years(born: Column | str, as_of: Column | str) -> Column:
    born, as_of = col(born), col(as_of)
    before = (F.month(as_of) < F.month(born)) | (
        (F.month(as_of) == F.month(born)) & (F.dayofmonth(as_of) < F.dayofmonth(born)))
    return (F.year(as_of) - F.year(born) - before.cast("int")).cast("bigint")


def age_text(born: Column | str, as_of: Column | str) -> Column:
    return F.coalesce(F.concat(age_years(born, as_of).cast("string"), F.lit(" years")), F.lit(""))


def format_long_date(day: Column | str) -> Column:
    return F.coalesce(F.date_format(col(day), "dd MMMM yyyy"), F.lit(""))
