"""Readers and writers. Schemas are declared, never inferred; reads prune columns and push filters down."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; under the warehouse in a session on one machine without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rename_parts(spark: SparkSession, directory: str, prefix: str) -> None:
    """Names the data files of a written folder ``<prefix>__<number>.csv``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for i, found in enumerate(_list(spark, f"{directory}/part-*")):
        old = path(found)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, path(old.getParent(), f"{prefix}__{i}.csv"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _list(spark: SparkSession, pattern: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(x.getPath()) for x in (found or []))


def read_tagged_csv(spark: SparkSession, pattern: str, columns: list[str], id_col: str) -> DataFrame:
    """Many yearly CSV files, with a title row above the header, as one; each row has its year label and file.

    Title and header fall out as their id is no number. The label is the part of
    the file's name before ``__``. All values stay text.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE").option("multiLine", "true").option("escape", '"').csv(pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    df = df.withColumns({"source_file": name, "source_year_label": F.regexp_replace(F.split_part(name, F.lit("__"), F.lit(1)), r"\.csv$", "")})
    return df.where(F.col(id_col).try_cast("double").isNotNull())


def read_headerless_extracts(spark: SparkSession, directory: str, entity: str, columns: list[str], statuses: dict[str, str]) -> DataFrame:
    """The files ``<entity><suffix>.txt`` of one entity, one for each status, as one; a missing file is left out.

    ``statuses`` maps the suffix to the label that its rows get. Empty text is null.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    parts = []
    for suffix, status in statuses.items():
        path = f"{directory}/{entity}{suffix}.txt"
        if _exists(spark, path):
            parts.append(spark.read.schema(schema).option("header", "false").option("nullValue", "").csv(path).withColumn("product_status_extract", F.lit(status)))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("product_status_extract", T.StringType(), False)]))
    return reduce(DataFrame.unionByName, parts)


def read_latest_json(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """The records in ``results`` of the file whose name is last."""
    paths = _list(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    whole = T.StructType([T.StructField("results", T.ArrayType(schema))])
    return spark.read.schema(whole).option("multiLine", "true").json(paths[-1]).select(F.inline("results"))


def first_of(col: Column) -> Column:
    """First element of a list; null where there is none."""
    return F.get(col, 0)


def joined(col: Column, sep: str = "|") -> Column:
    """A list as one text; null where the list is missing or empty."""
    return F.when(F.size(col) > 0, F.array_join(col, sep))


def flatten_records(df: DataFrame, plain: list[str], first: dict[str, str], lists: dict[str, str], sep: str = "|") -> DataFrame:
    """Nested records as flat rows: plain fields, first elements {out: path}, joined lists {out: path}."""
    return df.select(*plain, *[first_of(F.col(p)).alias(o) for o, p in first.items()], *[joined(F.col(p), sep).alias(o) for o, p in lists.items()])


def clean_coverage_feed(df: DataFrame, names: dict[str, str], id_col: str, dates: list[str], keep: list[str]) -> DataFrame:
    """Header names trimmed, rows without a numeric id dropped, the id padded, dates typed, columns renamed and chosen."""
    from ..functions.clean import pad_id, safe_date

    df = df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(names)
    df = df.where(F.col(id_col).cast("string").try_cast("double").isNotNull())
    df = df.withColumn(id_col, pad_id(F.col(id_col).cast("double")))
    return df.withColumns({c: safe_date(F.col(c).cast("string")) for c in dates}).select(*keep)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_report(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows, distinct keys and the share of non-null values of some columns."""
    shares = [F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(f"{c}_share") for c in columns]
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), *shares)


def read_panel(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table of metrics as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
