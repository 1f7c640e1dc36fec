"""Shared helpers: scratch tables, word patterns, ranking inside hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls \t..\r.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, as in tests, a
    session on one machine uses a folder of its warehouse; a cluster session
    raises, as no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs reread the files if an executor is lost.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as no given column has them all."""
    taken, lead = {c.lower() for c in columns}, "_"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def running(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come earlier.

    ``order`` is a uniformly distributed non-negative long. Rows of a key are cut
    into ``buckets`` ranges of it, so a key with a third of all rows is spread
    over many tasks; only one sum for each key and range meets in one place.
    """
    cut = f"_{out}_bucket"
    df = df.withColumn(cut, F.floor(F.col(order) / F.lit((1 << 62) // buckets)).cast("int")).withColumn(f"_{out}_v", value)
    sums = df.groupBy(*keys, cut).agg(F.sum(f"_{out}_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(cut).alias("_kc"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, cut).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_in", F.sum(f"_{out}_v").over(inside) - F.col(f"_{out}_v"))
    on = [df[k].eqNullSafe(sums[f"_k{i}"]) for i, k in enumerate(keys)] + [df[cut] == sums["_kc"]]
    return df.join(sums, on, "left").withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", "_kc", cut, f"_{out}_v", *[f"_k{i}" for i in range(len(keys))])


def spread(*cols: Column) -> Column:
    """A uniform non-negative long below 2**62 from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def running_over(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its column over the rows up to and with this one, in an order of all rows.

    The rows are sorted by range over many tasks; only one sum for each of them
    meets in one place. Give an order without ties.
    """
    values = {f"_v_{n}": c for n, c in sums.items()}
    rows = df.withColumns(values).orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    rows = stage_table(rows, "in-order")
    parts = rows.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values])  # one row for each task of the sort
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_base") for v in values])
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums}).join(parts, F.col("_p") == F.col("_q"))
    return rows.withColumns({n: F.col(n) + F.col(f"_v_{n}_base") for n in sums}).drop("_p", "_q", "_i", *values, *[f"{v}_base" for v in values])


def with_text_ids(df: DataFrame, run: Callable, id_col: str, rest: str) -> DataFrame:
    """mapInPandas whose first column, the id, goes through as text: pandas would turn whole numbers beside a null into doubles."""
    kind = df.schema[id_col].dataType
    out = df.withColumn(id_col, F.col(f"`{id_col}`").cast("string")).mapInPandas(run, f"`{id_col}` string, {rest}")
    return out.withColumn(id_col, F.col(f"`{id_col}`").cast(kind))
