"""Synthetic signals, seeded."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _faded(i: Column, n: int, fade: int) -> Column:
    ramp = max(fade - 1, 1)
    return F.least(F.lit(1.0), F.when(i < fade, i / ramp).otherwise(1.0), F.when(i >= n - fade, (n - 1 - i) / ramp).otherwise(1.0))


def _normalised(df: DataFrame) -> DataFrame:
    peak = df.agg(F.max(F.abs("y")).alias("_peak"))
    return df.crossJoin(F.broadcast(peak)).withColumn("y", F.col("y") / (F.col("_peak") + 1e-8)).drop("_peak")


def tone(spark: SparkSession, duration: float = 3.0, sr: int = 16000, freq: float = 440.0, noise: float = 0.05, seed: int = 0, signal_id: str = "tone") -> DataFrame:
    """Three harmonics, a hum of 100 Hz and noise; 50 ms linear fades; peak 1."""
    n = int(duration * sr)
    t = F.col("id") / sr
    wave = F.lit(0.0)
    for level, f in ((0.6, freq), (0.3, 2 * freq), (0.15, 3 * freq), (0.4, 100.0)):
        wave = wave + level * F.sin(2 * math.pi * f * t)
    if noise:
        wave = wave + noise * F.randn(seed)
    df = spark.range(n).select(F.lit(signal_id).alias("signal_id"), F.col("id").alias("i"), (wave * _faded(F.col("id"), n, int(0.05 * sr))).alias("y"))
    return _normalised(df)


def related_pair(spark: SparkSession, duration: float = 3.0, sr: int = 16000, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """A harmonic tone a, and b: a stretched by 0.85, modulated slowly, with noise."""
    a = tone(spark, duration, sr, noise=0.0, signal_id="a")
    n = int(duration * sr)
    pos = F.least(F.col("id") * 0.85, F.lit(float(n - 1)))
    at = spark.range(n).select(F.col("id").alias("k"), F.floor(pos).alias("i"), (pos - F.floor(pos)).alias("f"))
    ends = a.select("i", "y").join(a.select((F.col("i") - 1).alias("i"), F.col("y").alias("y1")), "i", "left")
    bent = at.join(ends, "i").withColumn("v", F.col("y") + F.col("f") * (F.coalesce("y1", "y") - F.col("y")))
    wave = F.col("v") * (0.7 * F.sin(2 * math.pi * 0.66 * F.col("k") / sr)) + (noise * F.randn(seed) if noise else F.lit(0.0))
    b = bent.select(F.lit("b").alias("signal_id"), F.col("k").alias("i"), wave.alias("y"))
    return a.unionByName(_normalised(b))
