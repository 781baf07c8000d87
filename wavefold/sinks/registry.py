"""Named experiments and result tables: upsert, delete, history, JSON, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table (name, task_id, created_at, updated_at) with rows (name, task_id, at): new names are added, known ones get task and time.

    Names and tasks are trimmed; blank ones are refused. Of equal names in
    rows the latest counts.
    """
    clean = rows.select(F.trim("name").alias("name"), F.trim("task_id").alias("task_id"), "at")
    if not clean.filter("coalesce(name, '') = '' or coalesce(task_id, '') = ''").isEmpty():
        raise ValueError("name and task_id must not be blank")
    last = clean.groupBy("name").agg(F.max(F.struct("at", "task_id")).alias("z")).select("name", "z.task_id", "z.at")
    known = table.select("name", F.col("created_at").alias("_c"))
    new = last.join(known, "name", "left").select("name", "task_id", F.coalesce("_c", "at").alias("created_at"), F.col("at").alias("updated_at"))
    return table.join(last.select("name"), "name", "left_anti").unionByName(new)


def delete(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("name") != name)


def get(table: DataFrame, name: str) -> dict:
    row = table.filter(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    return row.asDict()


def history(results: DataFrame, info: DataFrame) -> DataFrame:
    """results (task_id, modified) with what is known of each task, defaults for the rest, newest first."""
    z = results.join(info, "task_id", "left")
    return z.select("task_id", F.coalesce("title", F.lit("untitled")).alias("title"), F.coalesce("audio1", F.lit("synthetic")).alias("audio1"), "modified").orderBy(F.col("modified").desc(), "task_id")


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    """(task_id, modified) of every folder of root that holds results.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "results.json").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/results\.json$", 1).alias("task_id"), F.col("modificationTime").alias("modified"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def safe_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_\-.]", "_", name)


def safe_name_column(name):
    return F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_")


def as_json(df: DataFrame, key: list[str], column: str = "json") -> DataFrame:
    """key and one JSON object of the other columns; NaN becomes null, arrays stay arrays."""
    rest = [f for f in df.schema if f.name not in key]
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rest]
    return df.select(*key, F.to_json(F.struct(*clean)).alias(column))


def report(df: DataFrame, title: str, most: int = 50) -> str:
    """A fixed-width text table of at most ``most`` rows in order of the first column."""
    rows = df.orderBy(df.columns[0]).limit(most).collect()
    cells = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    width = [max(len(c), *(len(r[k]) for r in cells)) if cells else len(c) for k, c in enumerate(df.columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip()
    return "\n".join([title, "=" * len(title), line(df.columns), *(line(r) for r in cells)])


def compact(df: DataFrame, keep: list[str], digits: int = 4) -> DataFrame:
    """The columns to keep (nested ones by their path), doubles rounded, NaN and infinities null: what a result page shows of a large result."""
    z = df.select(*(F.col(c).alias(c.rsplit(".", 1)[-1]) for c in keep))
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, digits))
    return z.select(*(number(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float") else f.name for f in z.schema))


def ranges_text(ranges, most: int = 3):
    """Text of an array<struct<a, b>> of times: the first ones, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(ranges, 1, most), lambda r: F.concat(F.format_string("%.1f", r["a"]), F.lit("-"), F.format_string("%.1f", r["b"]), F.lit("s"))), ", ")
    return F.when(F.size(ranges) > most, F.concat(shown, F.lit(" +"), (F.size(ranges) - most).cast("string"), F.lit(" more"))).otherwise(shown)
