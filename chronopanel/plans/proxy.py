"""The star-schema tables read as entities, dated events, exits, coverage and outside signals.

A part is an entity, its brand the owner, type and size the group. Returned
items are events, accepted full-size items exits, other items coverage, urgent
orders' parts outside signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import explode_delimited

LO, HI = "1996-01-01", "2001-05-01"
SPLITS = {"train": ("1996-01-01", "1999-12-01"), "val": ("2000-04-01", "2000-09-01"), "test": ("2001-01-01", "2001-05-01")}


class Tables:
    """Lazy frames over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("entity"), "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_linestatus", "l_orderkey",
        )

    def parts(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("owner"), F.concat_ws("/", "p_type", "p_size").alias("grp"), "p_name", "p_size", "p_type", "p_retailprice")

    def entities(self, categories: bool = False) -> DataFrame:
        first = self.items().groupBy("entity").agg(F.min("d").alias("first_date"))
        gone = F.col("p_size") % 10 == 0
        df = self.parts().join(first, "entity", "left")
        kinds = [F.col("p_type").alias("type"), F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string")).alias("size_band"), F.element_at(F.split("p_name", " "), -1).alias("kind")]
        return df.select("entity", F.col("entity").alias("code"), "owner", "grp", "first_date", *(kinds if categories else []), F.when(gone, "CANCELLED POST MARKET").otherwise("MARKETED").alias("status"), F.when(gone, F.lit("2000-06-30").cast("date")).alias("status_date"))

    def events(self) -> DataFrame:
        df = self.items().where("l_returnflag = 'R'")
        end = F.when(~((F.col("l_linestatus") == "O") & (F.col("d") >= F.lit("2001-06-01").cast("date"))), F.date_add("d", F.col("q")))
        df = df.select("event_id", "entity", F.col("d").alias("start"), end.alias("end"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("reporter"))
        df = df.withColumn("duration", F.datediff("end", "start"))
        return df.join(self.parts().select("entity", "owner", "grp"), "entity", "left")

    def nations(self) -> DataFrame:
        """(reporter, nation)"""
        df = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return df.select(F.col("s_suppkey").alias("reporter"), F.col("n_name").alias("nation"))

    def exits(self) -> DataFrame:
        df = self.items().where("l_returnflag = 'A' and q = 50").select("entity", F.col("d").alias("exit_date"))
        return df.join(self.parts().select("entity", "owner", "grp"), "entity", "left")

    def coverage(self) -> DataFrame:
        df = self.items().where("l_returnflag = 'N'").join(self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
        return df.select("entity", F.col("s_nationkey").alias("jurisdiction"), F.col("l_suppkey").alias("program"), F.col("l_linestatus").alias("type"), (F.col("l_linestatus") == "F").alias("benefit"), F.col("d").alias("start"), F.date_add("d", 30 * F.col("q")).alias("end"))

    def entity_tokens(self) -> DataFrame:
        df = self.parts().select("entity", F.regexp_replace("p_name", " ", "|").alias("names"))
        return explode_delimited(df, "names").select("entity", "token").distinct()

    def foreign_events(self) -> DataFrame:
        urgent = self.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("start"))
        df = self.items().join(urgent, "l_orderkey")
        df = df.select("entity", "start", F.date_add("start", F.col("q")).alias("end")).join(self.entity_tokens(), "entity")
        return df.select("token", "start", "end").distinct()
