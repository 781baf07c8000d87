"""The trend layer: energy, brightness, complexity and rhythm of frames, their segments, summaries and similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as X
from ..functions.kernels import find_peaks, stretch
from ..functions.series import KEY, spread
from ..schemas import TRENDS
from .framing import frames
from .spectral import descriptors, magnitudes

WEIGHTS = {"energy": 0.35, "brightness": 0.25, "complexity": 0.15, "rhythm": 0.25}


def _changes(samples: DataFrame) -> DataFrame:
    """samples with ``_f``: change of the squared pre-emphasised value (y[i] - .97 y[i-1]; the first value as it is), by one window."""
    df, w, core = X.chunked(samples, 2, 0)
    one, two = F.lag("y", 1).over(w), F.lag("y", 2).over(w)
    df = df.withColumn("_1", one).withColumn("_2", two)
    now, before = F.col("y") - 0.97 * F.col("_1"), F.col("_1") - 0.97 * F.coalesce("_2", F.lit(0.0))
    return X.tidy(df.withColumn("_f", now * now - before * before), core).drop("_1", "_2")


def frame_energy(samples: DataFrame, win: int, hop: int) -> DataFrame:
    """(signal_id, w, energy, rhythm, n): root mean square, and mean absolute change of the pre-emphasised square."""
    # A change belongs to the frames that hold both of its samples: every frame of a sample but those it opens.
    f = frames(_changes(samples), win, hop, ["_f"])
    return f.groupBy(KEY, "w").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("energy"), F.avg(F.when(F.col("k") > 0, F.abs("_f"))).alias("rhythm"), F.count("*").alias("n"))


def trends(samples: DataFrame, win: int, hop: int, sr: float = 1.0, normalise: bool = True) -> DataFrame:
    """(signal_id, w, t_mid, energy, brightness, complexity, rhythm and their z-scores).

    One grouping makes both the aggregates and the frame's array, so the
    samples are shuffled once.
    """
    f = frames(_changes(samples), win, hop, ["_f"])
    g = f.groupBy(KEY, "w").agg(
        F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("energy"), F.coalesce(F.avg(F.when(F.col("k") > 0, F.abs("_f"))), F.lit(0.0)).alias("rhythm"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("ys"), F.first("hop").alias("hop"),
    )
    g = g.withColumn("n", F.size("ys")).withColumn("mag", magnitudes("ys")).withColumn("freq", F.transform("mag", lambda _, k: k * (sr / F.col("n"))))
    d = descriptors(g.withColumn("t_mid", (F.col("w") * F.col("hop") + F.col("n") / 2) / sr))
    out = d.select(KEY, "w", "t_mid", "energy", F.col("centroid").alias("brightness"), F.col("entropy_bits").alias("complexity"), "rhythm")
    if normalise:
        stats = {f"_{a}_{k}": f_(k) for k in TRENDS for a, f_ in (("m", F.avg), ("d", F.stddev_pop))}
        out = X.with_stats(out, **stats)
        out = out.select(*out.columns[:7], *(((F.col(k) - F.col(f"_m_{k}")) / (F.col(f"_d_{k}") + 1e-12)).alias(f"{k}_norm") for k in TRENDS))
    return out


def long(layer: DataFrame, names: tuple = TRENDS) -> DataFrame:
    """(signal_id, w, trend, x): one row for each trend."""
    return layer.unpivot([KEY, "w"], list(names), "trend", "x")


def segments(layer: DataFrame, high: float = 0.85, low: float = 0.25, busy: float = 0.80) -> DataFrame:
    """(signal_id, w, label): the first that fits of climax, calm, buildup, release, transition; else sustained."""
    p = layer.groupBy(KEY).agg(
        F.count("*").alias("_n"), F.percentile("energy", F.lit(high)).alias("_eh"), F.percentile("energy", F.lit(low)).alias("_el"),
        F.percentile("rhythm", F.lit(high)).alias("_rh"), F.percentile("rhythm", F.lit(low)).alias("_rl"), F.percentile("complexity", F.lit(busy)).alias("_ch"),
    )
    df = layer.select(KEY, "w", "energy", "rhythm", "complexity").join(p, KEY)
    df = X.smooth(df, "energy", "_sm", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / 10)), F.col("_n"), order="w")
    df = X.gradient(df, "_sm", "_g", order="w")
    df = X.with_stats(df, _gs=F.stddev_pop("_g")).withColumn("_d", F.col("_g") / (F.col("_gs") + 1e-12))
    label = (
        F.when(F.col("_n") < 3, "sustained").when((F.col("energy") >= F.col("_eh")) & (F.col("rhythm") >= F.col("_rh")), "climax").when((F.col("energy") <= F.col("_el")) & (F.col("rhythm") <= F.col("_rl")), "calm")
        .when(F.col("_d") > 1, "buildup").when(F.col("_d") < -1, "release").when(F.col("complexity") >= F.col("_ch"), "transition").otherwise("sustained")
    )
    return df.select(KEY, "w", label.alias("label"))


def peaks(rows: DataFrame, key: list[str], order: str, value: str, **options) -> DataFrame:
    """(key, p, value): peaks of each series, see kernels.find_peaks; prominence may be given as deviations by prominence_sd, distance as a function of the length by distance_of."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join(f"{k} {names[k]}" for k in key) + f", p bigint, {value} double"
    sd = options.pop("prominence_sd", None)
    share = options.pop("distance_share", None)
    apart = options.pop("distance_of", None)
    flip = options.pop("valleys", False)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order)
        x = df[value].to_numpy(float)
        own = dict(options)
        if sd is not None:
            own["prominence"] = sd * x.std()
        if apart is not None:
            own["distance"] = apart(len(x))
        if share is not None:
            own["distance"] = max(1, len(x) // share)
        at = find_peaks(-x if flip else x, **own)
        out = df.iloc[at][[*key, order, value]]
        return out.rename(columns={order: "p"})

    return spread(rows.select(*key, order, value), *key).groupBy(*key).applyInPandas(run, shape)


def direction(slope: Column, sd: Column, n: Column) -> Column:
    return F.when(slope > sd * 0.3 / n, "rising").when(slope < -sd * 0.3 / n, "falling").otherwise("flat")


def summary(layer: DataFrame, names: tuple = TRENDS) -> DataFrame:
    """(signal_id, trend, mean, sd, low, high, direction, range_pct)."""
    s = long(layer, names).groupBy(KEY, "trend").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), F.regr_slope("x", F.col("w").cast("double")).alias("_s")
    )
    turn = F.when(F.col("n") < 2, "flat").otherwise(direction(F.coalesce("_s", F.lit(0.0)), F.col("sd"), F.col("n")))
    spread = F.when(F.col("n") < 2, 0.0).otherwise((F.col("high") - F.col("low")) / (F.col("high") + 1e-12))
    return s.select(KEY, "trend", "mean", "sd", "low", "high", turn.alias("direction"), spread.alias("range_pct"))


def peak_counts(layer: DataFrame, names: tuple = TRENDS) -> DataFrame:
    """(signal_id, trend, n_peaks), peaks at least a tenth of the series apart."""
    found = peaks(long(layer, names), [KEY, "trend"], "w", "x", distance_share=10)
    every = long(layer, names).select(KEY, "trend").distinct()
    return every.join(found.groupBy(KEY, "trend").agg(F.count("*").alias("n_peaks")), [KEY, "trend"], "left").fillna(0, ["n_peaks"])


def pairs(spark, ids: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(ids, "a_id string, b_id string")


def all_pairs(df: DataFrame, limit_to: Column | None = None) -> DataFrame:
    """(a_id, b_id) of signals that are asked about together, a before b."""
    ids = df.select(KEY).distinct()
    out = ids.select(F.col(KEY).alias("a_id")).join(ids.select(F.col(KEY).alias("b_id")), F.col("a_id") < F.col("b_id"))
    return out.filter(limit_to) if limit_to is not None else out


def compare(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float | None, float]:
    """Pearson, Spearman, derivative correlation (none under 0), similarity of distribution and overlap of peaks of two series, interpolated to a common length of 50 to 300."""
    t = max(50, min(300, (len(x) + len(y)) // 2))
    a, b = stretch(x, t), stretch(y, t)

    def corr(u: np.ndarray, v: np.ndarray) -> float:
        d = u.std() * v.std()
        return max(0.0, float(((u - u.mean()) * (v - v.mean())).mean() / d)) if d > 0 else 0.0

    def ranks(u: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(u, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    da, db = np.gradient(a), np.gradient(b)
    pearson = corr(a, b)
    derivative = corr(da, db) if da.std() > 0 and db.std() > 0 else pearson
    bins, lo, hi = min(30, max(10, t // 5)), a.min(), a.max()
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    inside = b[(b >= lo) & (b <= hi)]
    share = [np.cumsum(np.bincount(np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1).astype(int), minlength=bins)) / max(len(v), 1) for v in (a, inside)]
    distribution = math.exp(-2 * float(np.abs(share[0] - share[1]).sum()) * (hi - lo) / bins) if len(inside) else None
    p, q = (set(find_peaks((v - v.min()) / (v.max() - v.min() + 1e-12), height=0.6, distance=max(1, t // 20)).tolist()) for v in (a, b))
    return pearson, corr(ranks(a), ranks(b)), derivative, distribution, len(p & q) / len(p | q) if p | q else 1.0


def series_similarity(series: DataFrame, pair: DataFrame) -> DataFrame:
    """(a_id, b_id, trend, pearson, spearman, derivative, distribution, overlap) of the series (signal_id, trend, w, x) of each pair.

    One shuffle by pair and trend; a group holds two series of frames, not of samples.
    """
    sides = [pair.join(series.withColumnRenamed(KEY, f"{s}_id"), f"{s}_id").select("a_id", "b_id", "trend", F.lit(s).alias("side"), "w", "x") for s in ("a", "b")]

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x, y = (df[df.side == s].sort_values("w").x.to_numpy(float) for s in ("a", "b"))
        found = [(*ids, *compare(x, y))] if len(x) and len(y) else []
        return pd.DataFrame(found, columns=["a_id", "b_id", "trend", "pearson", "spearman", "derivative", "distribution", "overlap"])

    shape = "a_id string, b_id string, trend string, pearson double, spearman double, derivative double, distribution double, overlap double"
    return spread(sides[0].union(sides[1]), "a_id", "b_id", "trend").groupBy("a_id", "b_id", "trend").applyInPandas(run, shape)


def trend_similarity(layer: DataFrame, pair: DataFrame, names: tuple = TRENDS, with_peaks: bool = True) -> DataFrame:
    """(a_id, b_id, trend, ..., score): .15 Pearson + .15 Spearman + .35 derivative + .25 peak overlap + .10 distribution."""
    out = series_similarity(long(layer, names), pair)
    out = out if with_peaks else out.withColumn("overlap", F.lit(0.0))
    score = 0.15 * F.col("pearson") + 0.15 * F.col("spearman") + 0.35 * F.col("derivative") + 0.25 * F.col("overlap") + 0.10 * F.coalesce("distribution", F.lit(0.0))
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def global_similarity(scores: DataFrame, weights: dict | None = None) -> DataFrame:
    """(a_id, b_id, similarity, dominant, coherence): weighted percent, the best trend, 1 - deviation of the scores."""
    weights = weights or WEIGHTS
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("trend")]
    place = F.create_map(*(F.lit(x) for k, name in enumerate(weights) for x in (name, -k)))[F.col("trend")]
    g = scores.groupBy("a_id", "b_id").agg(F.sum(weight * F.col("score")).alias("s"), F.max_by("trend", F.struct("score", place)).alias("dominant"), (1 - F.stddev_pop("score")).alias("coherence"))
    return g.select("a_id", "b_id", (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s"))) * 100).alias("similarity"), "dominant", "coherence")


def analyse_layer(layer: DataFrame) -> DataFrame:
    """Summary of each trend beside the number of windows with each label."""
    counts = segments(layer).groupBy(KEY).pivot("label", ["climax", "calm", "buildup", "release", "transition", "sustained"]).count().fillna(0)
    return summary(layer).join(peak_counts(layer), [KEY, "trend"]).join(counts, KEY)
