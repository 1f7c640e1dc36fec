"""A dimension of one row for each code from any number of side tables, and its canonical form by entity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import settled
from ..operators.windows import prefer

#: What a side table gives: the joined list of its distinct values, the first or last value by text, the value of the latest date, or the earliest date.
HOWS = ("list", "first", "last", "latest", "earliest")

#: Leaves rows of some codes alone: (rows, their column of codes) -> rows.
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass
class Side:
    """Rows of (code, value, and for latest and earliest a date ``at``), and how they become one."""

    rows: DataFrame
    how: str
    code: str = "code"
    value: str = "value"
    at: str | None = None


def _columns(name: str, side: Side, sep: str) -> tuple[Column, dict[str, Column]]:
    """What the side gathers from the rows of a code under its name, and the columns made of that."""
    value, found = F.col(side.value).cast("string"), F.col(name)
    at = F.col(side.at).cast("date") if side.at else F.lit(None).cast("date")
    if side.how in ("list", "first"):
        one = F.nullif(F.array_join(F.array_sort(found), sep), F.lit("")) if side.how == "list" else F.array_min(found)
        return F.collect_set(value), {name: one, f"{name}_count": F.when(found.isNull(), 0).otherwise(F.size(found)).cast("bigint")}
    if side.how == "last":
        return F.max(value), {name: found}
    if side.how == "earliest":
        return F.min(at), {name: found}
    latest = F.max(F.when(value.isNotNull() | at.isNotNull(), F.struct(at.alias("at"), value.alias("value"))))
    return latest, {name: found["value"], f"{name}_since": found["at"]}


def build_dimension(base: DataFrame, sides: dict[str, Side], code: str = "code", sep: str = " + ") -> DataFrame:
    """The base rows with a column for each side table (list and first also ``<name>_count`` of distinct values, latest ``<name>_since``).

    Side tables that are columns of one frame (the same object as ``rows``) are made in one pass over it: a
    row is moved once, however many they are, and a task sends one row for each code that it has met, so
    a code of very many rows is spread. Each frame is joined once. A code's distinct values of a
    list or first are held together.
    Null values and codes count nowhere, of equal latest dates the value that is last by text
    stays; a code without rows has nulls and counts of 0.
    """
    frames: dict[tuple[int, str], list[str]] = {}
    for name, side in sides.items():
        if side.how not in HOWS:
            raise ValueError(f"{name}: how must be one of {HOWS}")
        frames.setdefault((id(side.rows), side.code), []).append(name)
    made = {n: _columns(n, s, sep) for n, s in sides.items()}
    out = base
    for (_, own), names in frames.items():
        rows = sides[names[0]].rows.where(F.col(own).isNotNull())
        one = rows.groupBy(F.col(own).alias("_code")).agg(*[made[n][0].alias(n) for n in names])
        out = out.join(one, base[code] == one["_code"], "left").drop("_code")
    return out.select(*[base[c] for c in base.columns], *[col.alias(c) for _, columns in made.values() for c, col in columns.items()])


def canonical_by_entity(dimension: DataFrame, entity: str, status: str, ranking: list[str], code: str = "code") -> DataFrame:
    """One row for each entity: the code of the best status in ``ranking``, then the lowest; rows without an entity are left out."""
    return prefer(dimension.where(F.col(entity).isNotNull()), [entity], status, ranking, [code])


def canonical_dimension(base: DataFrame, sides: Callable[[Keep], dict[str, Side]], entity: str, status: str, ranking: list[str], code: str = "code", sep: str = " + ") -> DataFrame:
    """What ``canonical_by_entity`` keeps of ``build_dimension``, where the status is a side table.

    All base rows with the status alone are ranked first and the chosen ones are settled; only the side rows of
    their codes are then joined and gathered. Where each code is its own entity that is the whole dimension.
    ``sides`` makes the side tables, with what it is given called on each frame and its column of codes before joins.
    """
    own = sides(lambda rows, column: rows)[status]
    if own.how == "latest" and own.at:  # of equal values the latest date is enough, and counts of pairs need no sort
        rows = own.rows.groupBy(F.col(own.code).alias("code"), F.col(own.value).cast("string").alias("value")).agg(F.max(F.col(own.at).cast("date")).alias("at"))
        own = Side(rows, "latest", at="at")
    ranked = canonical_by_entity(build_dimension(base, {status: own}, code, sep), entity, status, ranking, code)
    chosen = settled(ranked.select(*base.columns), "chosen")
    codes = chosen.select(F.col(code).alias("_chosen"))
    return build_dimension(chosen, sides(lambda rows, column: rows.join(codes, F.col(column) == F.col("_chosen"), "left_semi")), code, sep)
