"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmill import constants as K
from jobmill.functions.text import col, let, strip_spaces

#: What a text must look like to be a whole number, whatever blanks and signs are around it.
_MAYBE_WHOLE = r"^[^0-9A-Za-z.]*+[0-9]++[^0-9A-Za-z.]*+$"


def parse_count(number: Column | str, unit: Column | str) -> Column:
    """``2.5`` + ``lakh`` -> 250000.  Halves round to even; no number gives 0."""
    plain = F.replace(col(number), F.lit(","), F.lit(""))
    unit = F.lower(col(unit))
    factor = F.lit(1)
    for name, value in K.UNIT_FACTORS.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return F.coalesce(F.rint(plain.try_cast("double") * factor).try_cast("bigint"),
                      F.lit(0).cast("bigint"))


def format_indian(value: Column | str) -> Column:
    """Group digits 3-2-2: 12,34,56,789."""
    return F.regexp_replace(col(value).cast("bigint").cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def whole_number(value: Column | str) -> Column:
    """Whole number of a text such as '120000'; anything else counts as 0."""
    # Tested first, as a text that is no number costs an exception.
    number = let(col(value).cast("string"), lambda text: F.when(text.rlike(_MAYBE_WHOLE), strip_spaces(text).try_cast("bigint")))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def format_currency_range(low: Column | str, high: Column | str, symbol: str = "$") -> Column:
    def money(n: Column) -> Column:
        return F.concat(F.lit(symbol), F.format_number(n, 0))

    def shown(ends: Column) -> Column:
        low, high = ends.low, ends.high
        return (
            F.when((low != 0) & (high != 0), F.concat(money(low), F.lit(" - "), money(high)))
            .when(low != 0, F.concat(F.lit("From "), money(low)))
            .when(high != 0, F.concat(F.lit("Up to "), money(high)))
            .otherwise("")
        )

    return let(F.struct(whole_number(low).alias("low"), whole_number(high).alias("high")), shown)


def size_label(size: Column | str) -> Column:
    """Above 1 MiB one decimal in MB, else whole KB."""
    size = col(size)
    return F.when(
        size > 1024 * 1024,
        F.concat(F.format_string("%.1f", size / F.lit(1048576.0)), F.lit(" MB")),
    ).otherwise(F.concat(F.floor(size / F.lit(1024.0) + 0.5).cast("string"), F.lit(" KB")))


def file_extension(name: Column | str) -> Column:
    return F.lower(F.substring_index(col(name), ".", -1))


def file_category(name: Column | str) -> Column:
    return F.when(file_extension(name).isin(*K.PHOTO_EXTENSIONS), "photo").otherwise("other")
