"""Tables written in the folder that all machines share.

The folder is the one the session names in ``spark.checkpoint.dir``; only where
that is unset in local mode (tests, a laptop) one is made below the system's temp
folder; on a cluster that is an error.
A table is a plain Parquet folder: it survives lost executors, cuts lineage and
is read back with column pruning. The cluster's owner clears the folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='wavefold-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/wavefold/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write df, in a folder for each value of the column ``by`` if that is given, and read it back."""
    spark = df.sparkSession
    at = path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, by: str, buckets: int, name: str = "run") -> str:
    """Write df as a table in buckets by the column ``by``, sorted by it in each; the table's name. The caller drops it."""
    table = f"wavefold_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, by).sortBy(by).option("path", path(df.sparkSession, name)).saveAsTable(table)
    return table


def drop(spark: SparkSession, table: str) -> None:
    """Drop a table that bucketed() wrote, and its files."""
    at = spark.table(table).inputFiles()
    spark.sql(f"DROP TABLE {table}")
    if at:
        delete(spark, at[0].rsplit("/", 1)[0])


def delete(spark: SparkSession, at: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
