"""Typed cleaning of raw text columns. Every function maps Columns to a Column and keeps null unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_id(col: Column, width: int = 8) -> Column:
    """A numeric id as text with leading zeros; longer ids are cut to ``width``."""
    return F.lpad(col.cast("bigint").cast("string"), width, "0")


def null_sentinel(col: Column, sentinel: str) -> Column:
    """Null where the text is the sentinel that stands for no value."""
    return F.nullif(col, F.lit(sentinel))


def has_id(col: Column, sentinel: str) -> Column:
    """Whether a value other than the sentinel is there; null where the raw value is null."""
    return col != F.lit(sentinel)


def has_value(col: Column) -> Column:
    return col.isNotNull()


def flag_yes(col: Column, yes: str = "Y") -> Column:
    """Case-insensitive flag, three-valued."""
    return F.upper(col) == F.lit(yes)


def flag_yes_strict(col: Column, yes: str = "Yes") -> Column:
    """Exact flag; null counts as false."""
    return F.coalesce(col == F.lit(yes), F.lit(False))


def safe_date(col: Column, fmt: str | None = None) -> Column:
    """Text as a date, null where it is none. Without a format, ISO text of which the first ten characters count."""
    if fmt is None:
        return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(col, 1, 10).try_cast("date"))
    return month_name_date(col) if fmt == "dd-MMM-yyyy" else F.try_to_date(col, fmt)


def month_name_date(col: Column) -> Column:
    """Dates as 31-Dec-2020 whatever the case of the month."""
    day, month, year = (F.split_part(col, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", day, F.initcap(month), year), "d-MMM-yyyy")


def safe_int(col: Column) -> Column:
    return col.try_cast("int")


def normalize_text(col: Column, fallback: Column | None = None) -> Column:
    return F.upper(F.trim(col if fallback is None else F.coalesce(col, fallback)))


def trim_all(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in cols})


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_by_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Without the columns, such as translations, whose names end so."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def era_filter(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """Rows from the cutoff on, and rows without a date."""
    return df.where((F.col(date_col) >= F.lit(cutoff).cast("date")) | F.col(date_col).isNull())


def require_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def status_flags(df: DataFrame, col: str, flags: dict[str, str]) -> DataFrame:
    """One boolean for each status value: {new column: value}."""
    return df.withColumns({name: F.col(col) == F.lit(value) for name, value in flags.items()})


def prefix(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def like_prefix(col: Column, start: str) -> Column:
    return col.startswith(start)


def coerce_panel_types(df: DataFrame, dates: list[str] = [], booleans: list[str] = [], labels: list[str] = [], categories: list[str] = [], numerics: list[str] = []) -> DataFrame:  # noqa: B006
    """Panel columns to the types that models take; numbers that aren't numbers become null."""
    casts = {c: F.col(c).cast("date") for c in dates} | {c: F.col(c).cast("boolean") for c in booleans} | {c: F.col(c).cast("tinyint") for c in labels}
    casts |= {c: F.col(c).cast("string") for c in categories} | {c: F.col(c).cast("string").try_cast("double") for c in numerics}
    return df.withColumns(casts)


def month_series(start: str, end: str) -> Column:
    """Array of month starts, both ends included."""
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))


def explode_delimited(df: DataFrame, col: str, out: str = "token", sep: str = "|") -> DataFrame:
    """One row for each token of a delimited text, normalised; blanks and nulls give none."""
    tokens = F.explode(F.split(F.col(col), f"\\Q{sep}\\E"))
    return df.withColumn(out, tokens).withColumn(out, F.upper(F.trim(out))).where(F.col(out) != "")
