"""Tables as signals: rows (signal_id, i, y) with a gapless ordinal i."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def samples(df: DataFrame, key: Column, order: Column, tie: Column, value: Column, part: Column) -> DataFrame:
    """Number the rows of each key by (order, tie).

    part is a coarse, monotone function of order (the day of a timestamp). Rows
    are numbered within (key, part), and parts get their offsets from a table of
    counts, so that a key with most of the rows is not sorted in one task.
    """
    rows = df.select(key.cast("string").alias("signal_id"), order.alias("_o"), tie.alias("_t"), value.cast("double").alias("y"), part.alias("_p"))
    counts = rows.groupBy("signal_id", "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("signal_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("signal_id", "_p", F.coalesce(before, F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("signal_id", "_p").orderBy("_o", "_t")) - 1
    return rows.withColumn("_r", place).join(offsets, ["signal_id", "_p"]).select("signal_id", (F.col("_b") + F.col("_r")).cast("bigint").alias("i"), "y")


def _events(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return samples(df, F.col(key), F.col("ts"), F.col("event_id"), F.col("value"), F.date_trunc("week", F.col("ts")))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long signals: events by event_type."""
    return _events(spark, sf_dir, "event_type")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short signals: events by user_id."""
    return _events(spark, sf_dir, "user_id")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of orders, a signal for each status."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"))
    return samples(days, F.col("o_orderstatus"), F.col("day"), F.lit(0), F.col("y"), F.year("day"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows: (signal_id, w, x array<double>), the label being the signal."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("signal_id"), F.col("vec_id").alias("w"), F.col("embedding").cast("array<double>").alias("x"))
