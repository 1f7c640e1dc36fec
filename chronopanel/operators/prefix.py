"""Running sums inside keys of any size.

A key that holds a third of all rows would be one task's work under a window by
key. Here rows are first dealt into ranges of (key, order), whose splitters
Spark samples so that a large key takes many of them; a window then runs inside
each range, and only one row of sums for each key and range meets by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import settled


def in_ranges(df: DataFrame, keys: list[str], order: list[str], part: str, ranges: int | None = None) -> DataFrame:
    """The rows with ``part``, the number of their range of (keys, order); settled, as all readers must see the same ranges.

    There are as many ranges as shuffle partitions unless given. Nulls come first, NaN last.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(f"`{c}`") for c in [*keys, *order]])
    return settled(dealt.withColumn(part, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], totals: bool = False, ranges: int | None = None) -> DataFrame:
    """Add, for each name, the sum of its column over the key's rows up to and with this one in ascending order, nulls first.

    With ``totals`` also ``<name>_total``, the key's whole sum. Rows must be distinct in (keys,
    order); null keys are keys, null values add nothing, and a sum of nulls alone is 0.
    """
    values = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = in_ranges(df.withColumns(values), keys, order, "_part", ranges)
    per = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = {f"_b{i}": F.coalesce(F.sum(v).over(before), F.lit(0)) for i, v in enumerate(values)}
    base |= {f"_t{i}": F.sum(v).over(whole) for i, v in enumerate(values)} if totals else {}
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    per = per.withColumns(base).drop(*values).withColumnsRenamed(names | {"_part": "_of"})
    inside = Window.partitionBy(*keys, "_part").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_r{i}": F.sum(v).over(inside) for i, v in enumerate(values)})
    on = F.col("_part") == F.col("_of")
    for k, n in names.items():
        on &= F.col(f"`{k}`").eqNullSafe(F.col(n))
    joined = rows.join(per, on)
    out = {name: F.col(f"_r{i}") + F.col(f"_b{i}") for i, name in enumerate(sums)}
    out |= {f"{name}_total": F.col(f"_t{i}") for i, name in enumerate(sums)} if totals else {}
    own = [c for c in df.columns if c not in out]
    return joined.select(*[F.col(f"`{c}`") for c in own], *[c.alias(n) for n, c in out.items()])
