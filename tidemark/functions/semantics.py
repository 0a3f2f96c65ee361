"""Column macros that make missing values, dates and three-valued logic explicit.

All are safe under ANSI mode: what can't be read is null, never an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value on reading, and after aggregation.
MISSING = ["", "NA", "N/A", "NULL", "NaN"]
MISSING_AFTER = [*MISSING, "Inf", "-Inf"]

#: Two-digit years up to this are of this century.
PIVOT = 24


def present(text: Column, tokens: Iterable[str] = MISSING) -> Column:
    """`text`, or null if it is one of the tokens for missing."""
    return F.when(~text.isin(list(tokens)), text)


def scrub(df: DataFrame, tokens: Iterable[str] = MISSING) -> DataFrame:
    """Missing tokens in text columns, and NaN and infinities in floating ones, made null; other columns as they are."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = present(c, tokens)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def number(text: Column) -> Column:
    return text.try_cast("double")


def whole(text: Column) -> Column:
    return text.try_cast("long")


def parse_date(text: Column) -> Column:
    """MM/dd/yyyy in ten characters; in eight, day and month of one or two digits and a year of two or four; else null."""
    year, month, day = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", k) for k in (3, 1, 2))
    number_ = year.try_cast("int")
    century = F.when(F.length(year) == 4, number_).when(F.length(year) == 2, F.when(number_ <= PIVOT, number_ + 2000).otherwise(number_ + 1900))
    short = F.try_to_date(F.concat_ws("-", F.lpad(century.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(F.length(text) == 10, F.try_to_date(text, "MM/dd/yyyy")).when((F.length(text) == 8) & century.isNotNull(), short)


def if_else_null(condition: Column, yes: Column, no: Column) -> Column:
    """Like CASE, but an unknown condition gives an unknown result."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def is_one_of(c: Column, values: Iterable[str]) -> Column:
    """Membership that is never null."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern found in the text, whatever its case; null texts get the default."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in rules:
        out = out.when(F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)), value)
    return out.otherwise(default)


def mapped(c: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """The value for a key; keys that are unknown or null get the default."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in mapping.items():
        out = out.when(c == key, value)
    return out.otherwise(F.lit(default).cast("string"))


def any_true(condition: Column) -> Column:
    """Aggregate: whether any row's condition is true; unknown ones aren't."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def total(c: Column) -> Column:
    """Aggregate: the sum, 0 over no or only null values."""
    return F.coalesce(F.sum(c), F.lit(0))


def last_present(value: Column, order: Column) -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def tri_state(condition: Column, unknown: Column) -> Column:
    """Aggregate: true if any row is true, null if none is but some can't tell, else false."""
    return F.when(any_true(condition), True).when(any_true(unknown), F.lit(None)).otherwise(False)


def ratio(part: Column, of: Column) -> Column:
    """part / of where `of` is above 0, else null."""
    return F.when(of > 0, part / of)


def mean_of(*columns: Column) -> Column:
    """The mean of those that aren't null."""
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / count)


def log_plus_one(c: Column) -> Column:
    return F.ln(c + 1)
