"""Exact interpolated quantiles by radix selection on an ordered whole number for each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import settled

#: Bits that a round reads: no key has more than about 2**DIGIT counts in a window, whatever its values.
DIGIT = 16
#: Fixed values of the 64-bit floating-point format: mantissa bits, exponent bias, exponent of infinity and NaN.
MANTISSA, BIAS, OUTSIDE = 52, 1023, 2047


def with_code(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds a long for a double that keeps the order: its IEEE bits, negated below zero; null for null.

    Both zeros are 0; infinity lies beyond all numbers and NaN above it. The
    exponent is guessed from the logarithm and set right by exact powers of two.
    """
    power = lambda e: F.pow(F.lit(2.0), e)
    value, size, one, top = F.col(col), F.abs(col), F.lit(float(1 << MANTISSA)), OUTSIDE << MANTISSA
    usual = (size > 0) & (size < F.lit(float("inf")))
    # one column after the other, so that none is worked out twice
    df = df.withColumn("_size", F.when(usual, size).otherwise(F.lit(1.0))).withColumn("_guess", F.floor(F.log2("_size")))
    df = df.withColumn("_guess", F.when(power(F.col("_guess")) > F.col("_size"), F.col("_guess") - 1).when(power(F.col("_guess") + 1) <= F.col("_size"), F.col("_guess") + 1).otherwise(F.col("_guess")))
    df = df.withColumn("_guess", F.greatest("_guess", F.lit(1 - BIAS).cast("bigint"))).withColumn("_scaled", F.col("_size") / power(F.col("_guess")))  # from 1 to 2, below 1 for the smallest numbers
    bits = F.when(F.col("_scaled") >= 1, F.shiftleft(F.col("_guess") + BIAS, MANTISSA) + ((F.col("_scaled") - 1) * one).cast("bigint")).otherwise((F.col("_scaled") * one).cast("bigint"))
    bits = F.when(F.isnan(value), F.lit(top + (1 << (MANTISSA - 1)))).when(size == F.lit(float("inf")), F.lit(top)).when(value == 0, F.lit(0)).otherwise(bits)
    df = df.withColumn(out, bits).withColumn(out, F.when(value.isNull(), F.lit(None)).when((value < 0) & ~F.isnan(value), -F.col(out)).otherwise(F.col(out)))
    return df.drop("_size", "_guess", "_scaled")


def _rounds(least: int, most: int) -> list[int]:
    """The shifts of the rounds: the first leaves about DIGIT bits of the values' span, each later one DIGIT bits less, the last none."""
    shift = max(0, (most - least).bit_length() - DIGIT)
    return [shift, *[max(0, shift - DIGIT * i) for i in range(1, -(-shift // DIGIT) + 1)]]


def quantiles(df: DataFrame, keys: list[str], col: str, points: dict[str, float]) -> DataFrame:
    """A row for each key (one row without keys) with the quantiles of the non-null values, interpolated between neighbours.

    The values are written once with a code, whole numbers as they are and others by
    their bits. A round counts, by the next bits of the code, the rows that agree with
    the bits found so far for a wanted rank, and moves each rank into the range that
    holds it, until each such range is one value. Neither a key's rows nor its distinct
    values ever meet in a task, and rounds are as many as the span of the values needs:
    one for small whole numbers, four at most for any doubles.

    A key without values, or no rows without keys, gives nulls. Infinities are the
    outermost numbers, NaN comes above them (a quantile that touches it is NaN, as
    is one between both infinities), -0.0 equals 0.0.
    """
    names = {k: f"_q_{i}" for i, k in enumerate(keys)}
    own = list(names.values())
    given = isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    value = F.col(f"`{col}`").cast("double") + F.lit(0.0)  # no -0.0
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], value.alias("_v"), *([F.col(f"`{col}`").cast("bigint").alias("_code")] if given else []))
    rows = settled(rows if given else with_code(rows, "_v", "_code"), "values")
    whole = F.lit(True) if given else (F.rint("_v") == F.col("_v")) & (F.abs("_v") < F.lit(float(1 << 53)))
    code = F.col("_code")
    if not given and rows.agg(F.min(whole)).first()[0]:
        code = F.col("_v").cast("bigint")
    valued = rows.where("_v is not null").select(*own, "_v", code.alias("_code"))
    least, most = valued.agg(F.min("_code"), F.max("_code")).first()
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), side(F.lit(float(p)) * (F.col("_all") - 1)).cast("bigint").alias("rank")) for i, p in enumerate(points.values()) for side in (F.floor, F.ceil)])
    found, before = None, None
    for shift in _rounds(least or 0, most or 0):
        near = valued.withColumn("_at", F.shiftright("_code", shift))
        if found is not None:
            near = near.withColumn("_in", F.shiftright("_code", before)).join(_renamed(found.select(*own, "_at"), own), _same(own) & (F.col("_in") == F.col("_at_f")), "left_semi")
        group = [*own, "_in"] if found is not None else own
        counts = near.groupBy(*group, "_at").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_value"))
        inside = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # some 2**DIGIT rows at most
        running = inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_base", F.sum("_n").over(running) - F.col("_n"))
        if found is None:
            counts = counts.withColumn("_all", F.sum("_n").over(inside)).withColumn("_ranks", ranks)
        else:
            counts = counts.join(_renamed(found.select(*own, "_at", "_all", "_ranks"), own), _same(own) & (F.col("_in") == F.col("_at_f"))).withColumnsRenamed({"_all_f": "_all", "_ranks_f": "_ranks"})
        here = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_base")) & (r["rank"] < F.col("_base") + F.col("_n")))
        found = counts.where(F.exists("_ranks", lambda r: (r["rank"] >= F.col("_base")) & (r["rank"] < F.col("_base") + F.col("_n"))))
        found = found.select(*own, "_at", "_all", "_low", "_value", F.transform(here, lambda r: F.struct(r["i"].alias("i"), (r["rank"] - F.col("_base")).alias("rank"))).alias("_ranks"))
        before = shift
        if shift:
            found = settled(found, "ranks")  # a few rows for each key; the next round reads it twice
            if found.where("not (_low <=> _value)").isEmpty():
                break  # every range left is one value
    ends = found.select(*own, "_all", "_value", F.explode("_ranks.i").alias("_i")).groupBy(*own)
    ends = ends.agg(F.max("_all").alias("_all"), *[pick(F.when(F.col("_i") == i, F.col("_value"))).alias(f"_{side}{i}") for i in range(len(points)) for side, pick in (("lo", F.min), ("hi", F.max))])
    between = {}
    for i, (name, p) in enumerate(points.items()):
        place, low, high = F.lit(float(p)) * (F.col("_all") - 1), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        between[name] = F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
    out = ends.select(*own, *[c.alias(n) for n, c in between.items()])
    if not keys:
        return out
    every = rows.select(*own).distinct()
    return every.join(_renamed(out, own), _same(own), "left").select(*[F.col(n).alias(k) for k, n in names.items()], *[F.col(f"{p}_f").alias(p) for p in points])


def _renamed(df: DataFrame, own: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_f" for c in df.columns})


def _same(own: list[str]) -> Column:
    same = F.lit(True)
    for n in own:
        same &= F.col(n).eqNullSafe(F.col(f"{n}_f"))
    return same
