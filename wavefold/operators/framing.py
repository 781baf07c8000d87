"""Frames, blocks, lag windows and embeddings of signals (signal_id, i, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import KEY, ORD, chunked, tidy


def frames(samples: DataFrame, win: int, hop: int, carry: list[str] | None = None) -> DataFrame:
    """(signal_id, w, k, i, win, ...): every sample once for each full window that holds it, at place k.

    A signal shorter than win is one window of its length, stepped by a quarter.
    """
    n = samples.groupBy(KEY).agg(F.count("*").alias("_n"))
    df = samples.join(n, KEY).withColumn("win", F.least(F.lit(win), F.col("_n"))).withColumn("_h", F.when(F.col("_n") < win, F.greatest(F.lit(1), F.floor(F.col("win") / 4))).otherwise(hop))
    last = F.floor((F.col("_n") - F.col("win")) / F.col("_h"))
    low = F.when(F.col(ORD) < F.col("win"), 0).otherwise(F.floor((F.col(ORD) - F.col("win")) / F.col("_h")) + 1)
    high = F.least(last, F.floor(F.col(ORD) / F.col("_h")))
    df = df.withColumn("w", F.explode(F.when(low <= high, F.sequence(low, high))))
    return df.select(KEY, "w", (F.col(ORD) - F.col("w") * F.col("_h")).alias("k"), ORD, "win", "_h", "y", *(carry or [])).withColumnRenamed("_h", "hop")


def frame_arrays(samples: DataFrame, win: int, hop: int) -> DataFrame:
    """(signal_id, w, ys): each window's samples in order."""
    f = frames(samples, win, hop)
    return f.groupBy(KEY, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("ys"))


def lag_windows(samples: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """(signal_id, i, x, y): lookback values from i on, and the horizon values that follow them."""
    df, w, core = chunked(samples, 0, lookback + horizon - 1)
    past = F.collect_list("y").over(w.rowsBetween(0, lookback - 1))
    ahead = F.collect_list("y").over(w.rowsBetween(lookback, lookback + horizon - 1))
    out = tidy(df.select("*", past.alias("_x"), ahead.alias("_y")), core)
    return out.filter(F.size("_y") == horizon).select(KEY, ORD, F.col("_x").alias("x"), F.col("_y").alias("y"))


def blocks(samples: DataFrame, size: int) -> DataFrame:
    """(signal_id, b, var): population variance of whole blocks of size samples; the rest is dropped."""
    return samples.groupBy(KEY, F.floor(F.col(ORD) / size).alias("b")).agg(F.var_pop("y").alias("var"), F.count("*").alias("_n")).filter(F.col("_n") == size).drop("_n")


def embed(rows: DataFrame, dim: int, delay: int, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, j, e): concatenated vectors j, j + delay, ..., where all exist."""
    df, w, core = chunked(rows, 0, (dim - 1) * delay, order=order)
    parts = [F.lead(vector, k * delay).over(w) if k else F.col(vector) for k in range(dim)]
    out = tidy(df.withColumn("e", F.concat(*parts)), core)
    return out.filter("e is not null").select(KEY, F.col(order).alias("j"), "e")


def subsequences(rows: DataFrame, length: int, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, j, s): the vectors of ``length`` rows from j on, flattened."""
    df, w, core = chunked(rows, 0, length - 1, order=order)
    out = tidy(df.withColumn("_s", F.collect_list(vector).over(w.rowsBetween(0, length - 1))), core)
    return out.filter(F.size("_s") == length).select(KEY, F.col(order).alias("j"), F.flatten("_s").alias("s"))


def pad_edge(values: Column, length: int) -> Column:
    """An array continued with its last value to at least length."""
    return F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def spread(df: DataFrame, n: Column, cap: int, order: str = ORD) -> DataFrame:
    """cap rows at equally spaced places, truncated to whole ones; all rows where n <= cap."""
    places = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.floor(k * (n - 1) / (cap - 1)))
    return df.filter((n <= cap) | F.array_contains(places, F.col(order)))


def context(series: DataFrame, peaks: DataFrame, half: int) -> DataFrame:
    """(signal_id, p, i, y): rows [p - half, p + half) round each peak (signal_id, p)."""
    wanted = peaks.select(KEY, "p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - half), F.col("p") + half - 1)).alias(ORD))
    return series.join(wanted, [KEY, ORD])
