"""Tables that figures need: one for each figure that computes something beyond drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as X
from ..functions.series import KEY
from . import spectral, trends

#: Heights of the labels in the segment bar.
LEVELS = {"calm": 0, "sustained": 1, "release": 2, "transition": 3, "buildup": 4, "climax": 5}


def waveform(samples: DataFrame, sr: float, most: int = 60_000) -> DataFrame:
    """(signal_id, t, y), decimated to about ``most`` points."""
    n = samples.groupBy(KEY).agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return samples.join(n, KEY).filter(F.col("i") % step == 0).select(KEY, (F.col("i") / sr).alias("t"), "y")


def spectrum(samples: DataFrame, sr: float, top: float = 5000.0) -> DataFrame:
    return spectral.fft(samples, sr).filter(F.col("freq") <= top)


def periodicity(samples: DataFrame, sr: float) -> DataFrame:
    """(signal_id, bin, freq, mag): the bin nearest to the dominant frequency."""
    d = spectral.dominant(samples, sr).select(KEY, F.col("freq").alias("f0"))
    z = spectral.fft(samples, sr).join(d, KEY)
    return z.groupBy(KEY).agg(F.min_by(F.struct("bin", "freq", "mag"), F.struct(F.abs(F.col("freq") - F.col("f0")), "bin")).alias("z")).select(KEY, "z.*")


def band_heatmap(scores: DataFrame, models: list[str]) -> DataFrame:
    """(signal_id, band, an error for each model)."""
    return scores.groupBy(KEY, "band").pivot("model", models).agg(F.avg("rmse"))


def segment_bar(labels: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(v) for kv in LEVELS.items() for v in kv))
    return labels.select(KEY, "w", "label", table[F.col("label")].cast("bigint").alias("level"))


def trend_lines(layer: DataFrame) -> DataFrame:
    """(signal_id, trend, w, x, m): each trend and its min-max scaled form."""
    return X.minmax(trends.long(layer), "x", "m", [KEY, "trend"])


def volatility_band(series: DataFrame, layer: DataFrame) -> DataFrame:
    """(signal_id, trend, w, x, low, high): the series with its volatility on either side, not under 0."""
    z = series.join(layer.select(KEY, "trend", "w", "vol"), [KEY, "trend", "w"])
    return z.select(KEY, "trend", "w", "x", F.greatest(F.lit(0.0), F.col("x") - F.col("vol")).alias("low"), (F.col("x") + F.col("vol")).alias("high"))


def persistence_words(garch: DataFrame) -> DataFrame:
    p = F.col("persistence")
    return garch.withColumn("word", F.when(p > 0.9, "strong").when(p > 0.5, "moderate").otherwise("weak"))


def top_dimensions(distances: DataFrame, names: list[str], top: int = 12) -> DataFrame:
    """(a_id, b_id, rank, name, distance): the places of the feature vector that differ most."""
    from pyspark.sql import Window

    w = Window.partitionBy("a_id", "b_id").orderBy(F.col("distance").desc(), "dim")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("dim") + 1).cast("int"))
    return distances.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top).select("a_id", "b_id", "rank", name.alias("name"), "distance")


def histogram(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """(key, bin, low, count) on 8 to 25 bins, about the root of the rows."""
    s = rows.groupBy(*key).agg(F.min(value).alias("_l"), F.max(value).alias("_h"), F.greatest(F.lit(8), F.least(F.lit(25), F.floor(F.sqrt(F.count("*"))))).alias("_k"))
    z = rows.join(s, key).withColumn("bin", F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_l"), F.col("_h") - F.col("_l")), F.lit(0.0)) * F.col("_k")), F.col("_k") - 1).cast("bigint"))
    return z.groupBy(*key, "bin", (F.col("_l") + F.col("bin") * (F.col("_h") - F.col("_l")) / F.col("_k")).alias("low")).agg(F.count("*").alias("count"))
