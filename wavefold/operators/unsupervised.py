"""Structure without labels: change points, motifs, recurrence, clusters, factors, anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as X
from ..functions.blocks import best_of, within
from ..functions.kernels import find_peaks, nmf
from ..functions.series import KEY, spread
from .framing import embed, subsequences
from .trends import peaks


def change_score(rows: DataFrame, half: int, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, w, score): squared distance of the means of half rows before and from w on, over their summed variances, scaled to the largest.

    Moments of each dimension come from bounded frames over the exploded vectors.
    """
    long = rows.select(KEY, order, F.posexplode(vector).alias("dim", "v"))
    df, w, core = X.chunked(long, half, half - 1, [KEY, "dim"], order)
    before, after = w.rowsBetween(-half, -1), w.rowsBetween(0, half - 1)
    df = df.select("*", F.avg("v").over(before).alias("ml"), F.avg("v").over(after).alias("mr"), F.var_pop("v").over(before).alias("vl"), F.var_pop("v").over(after).alias("vr"))
    n = rows.groupBy(KEY).agg(F.count("*").alias("n"))
    sums = X.tidy(df, core).groupBy(KEY, order).agg(F.sum((F.col("ml") - F.col("mr")) * (F.col("ml") - F.col("mr"))).alias("d"), F.sum(F.col("vl") + F.col("vr")).alias("v"))
    raw = sums.join(n, KEY).withColumn("raw", F.when((F.col(order) >= half) & (F.col(order) < F.col("n") - half), F.col("d") / (F.col("v") + 1e-12)).otherwise(0.0))
    top = raw.groupBy(KEY).agg(F.max("raw").alias("top"))
    return raw.join(top, KEY).select(KEY, order, (F.col("raw") / (F.col("top") + 1e-12)).alias("score"))


def change_points(rows: DataFrame, hop: float, min_length: float = 1.0, most: int = 8, penalty: float = 1.0, vector: str = "x") -> DataFrame:
    """(signal_id, w, score): peaks of the change score over .15 and over its 70th percentile, the ``most`` highest."""
    gap = max(3, int(min_length / hop))
    score = change_score(rows, max(3, gap // 2), vector)
    bar = score.groupBy(KEY).agg(F.greatest(F.lit(0.15), F.percentile("score", F.lit(0.7)) * penalty).alias("bar"))
    found = peaks(score, [KEY], "w", "score", distance=gap, height=0.15).join(bar, KEY).filter(F.col("score") >= F.col("bar"))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("score").desc(), "p"))).filter(F.col("_r") <= most)
    return found.select(KEY, F.col("p").alias("w"), "score")


def build_segments(points: DataFrame, layer: DataFrame, hop: float, labels: DataFrame | None = None) -> DataFrame:
    """(signal_id, start, end, windows, label, energy, brightness, rhythm): stretches between change points, described.

    Stretches under .3 s or 2 windows are left out; a climax, calm or buildup
    near the middle names the stretch, the later of these kinds first.
    """
    ends = layer.groupBy(KEY).agg(F.max("t_mid").alias("t"))
    bounds = points.select(KEY, (F.col("w") * hop).alias("t")).union(ends).union(ends.select(KEY, F.lit(0.0).alias("t"))).distinct()
    w = Window.partitionBy(KEY).orderBy("t")
    spans = bounds.withColumn("end", F.lead("t").over(w)).filter("end - t >= 0.3").withColumn("ord", F.row_number().over(w)).withColumnRenamed("t", "start")
    inside = spans.join(layer, KEY).filter((F.col("t_mid") >= F.col("start")) & (F.col("t_mid") <= F.col("end")))
    s = inside.groupBy(KEY, "start", "end", "ord").agg(F.count("*").alias("windows"), *(F.avg(c).alias(c) for c in ("energy", "brightness", "rhythm")), F.regr_slope("energy", F.col("w").cast("double")).alias("slope"), F.stddev_pop("energy").alias("sd"))
    s = s.filter("windows >= 2")
    default = F.concat(F.lit("segment_"), F.col("ord").cast("string"))
    if labels is None:
        return s.withColumn("label", default)
    marks = labels.filter(F.col("label").isin("climax", "calm", "buildup")).join(layer.select(KEY, "w", "t_mid"), [KEY, "w"]).select(KEY, "label", F.col("t_mid").alias("at"))
    near = s.select(KEY, "start", "end").join(marks, KEY).filter(F.abs(F.col("at") - (F.col("start") + F.col("end")) / 2) < F.col("end") - F.col("start"))
    rank = F.when(F.col("label") == "buildup", 3).when(F.col("label") == "calm", 2).otherwise(1)
    named = near.groupBy(KEY, "start", "end").agg(F.max_by("label", rank).alias("named"))
    return s.join(named, [KEY, "start", "end"], "left").withColumn("label", F.coalesce("named", default)).drop("named")


def characterise(s: DataFrame) -> DataFrame:
    """Words for each segment's energy, trend, brightness and rhythm."""
    energy = F.when(F.col("energy") > 0.4, "high").when(F.col("energy") > 0.15, "medium").otherwise("low")
    trend = F.when(F.col("windows") > 2, F.when(F.col("slope") > 0.3 * F.col("sd") / F.col("windows"), "rising").when(F.col("slope") < -0.3 * F.col("sd") / F.col("windows"), "falling").otherwise("flat")).otherwise("flat")
    bright = F.when(F.col("brightness") > 3000, "bright").when(F.col("brightness") > 1500, "balanced").otherwise("dark")
    rhythm = F.when(F.col("rhythm") > 0.02, "dense").when(F.col("rhythm") > 0.01, "medium").otherwise("sparse")
    return s.select("*", energy.alias("energy_word"), trend.alias("trend_word"), bright.alias("brightness_word"), rhythm.alias("rhythm_word"))


def normed(s: np.ndarray) -> np.ndarray:
    """Rows less their mean, over their deviation: summed from the first place on (the deviation by Welford), as DuckDB sums them."""
    total, mean, square = (np.zeros(len(s)) for _ in range(3))
    for k in range(s.shape[1]):
        total += s[:, k]
        gap = s[:, k] - mean
        mean += gap / (k + 1)
        square += gap * (s[:, k] - mean)
    n = s.shape[1]
    return (s - (total / n)[:, None]) / (np.sqrt(square / n) + 1e-12)[:, None]


def motif_profile(rows: DataFrame, length: int, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, j, nearest, distance): for each z-normed subsequence the nearest other one, the last of equals; distance 1 - dot product, not over the length.

    All subsequences of a signal are compared, by blocks. Which of equals is the
    nearest, SQL leaves to DuckDB's join: with one thread it takes the last.
    """
    kind = rows.schema[KEY].dataType.simpleString()

    def run(key, aw: np.ndarray, a: np.ndarray, bw: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for j, score, nearest in best_of(aw, normed(a), bw, normed(b), apart=True):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(j)), pa.array(j), pa.array(nearest), pa.array(1 - score)], names=[KEY, "j", "nearest", "distance"])

    near = within(subsequences(rows, length, vector, order), run, f"{KEY} {kind}, j bigint, nearest bigint, distance double", vector="s", order="j")
    best = near.groupBy(KEY, "j").agg(F.min(F.struct("distance", (-F.col("nearest")).alias("last"))).alias("_z"))
    return best.select(KEY, "j", (-F.col("_z.last")).alias("nearest"), F.col("_z.distance").alias("distance"))


def motifs(profile: DataFrame, seconds: float, hop: float, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Motifs (signal_id, pattern_index, length_seconds, occurrences, significance), and discords (signal_id, j, distance): the first three over the 90th percentile."""
    p = profile.groupBy(KEY).agg(F.percentile("distance", F.lit(0.15)).alias("lo"), F.percentile("distance", F.lit(0.9)).alias("hi"))
    z = profile.join(p, KEY)
    seeds = z.filter(F.col("distance") < F.col("lo"))
    r = seeds.withColumn("pattern_index", F.row_number().over(Window.partitionBy(KEY).orderBy("distance", "j")).cast("bigint")).filter(F.col("pattern_index") <= top)
    found = r.select(KEY, "pattern_index", F.lit(seconds).alias("length_seconds"), F.array_sort(F.array(F.col("j") * hop, F.col("nearest") * hop)).alias("occurrences"), (1 - F.col("distance")).alias("significance"))
    odd = z.filter(F.col("distance") > F.col("hi")).withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy("j"))).filter("_r <= 3")
    return found, odd.select(KEY, "j", "distance")


def _run_lengths(mask: np.ndarray) -> np.ndarray:
    """Lengths of the runs of True down the columns."""
    edge = np.diff(np.pad(mask.T, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    return np.nonzero(edge == -1)[1] - np.nonzero(edge == 1)[1]


def recurrence_lines(x: np.ndarray, threshold: float) -> tuple:
    """Recurrence rate, determinism, laminarity, mean diagonal and vertical line and the entropy of diagonal lines, of vectors x."""
    n = len(x)
    square = np.zeros((n, n))
    for k in range(x.shape[1]):
        gap = x[:, None, k] - x[None, :, k]
        square += gap * gap
    far = np.sqrt(square)
    near = far < threshold * far.max(initial=0.0)
    np.fill_diagonal(near, False)
    total = int(near.sum())
    # Row i is moved by i to the right, so that columns are diagonals.
    skew = np.zeros((n, 2 * n), bool)
    skew[:, :n] = near[:, ::-1]
    skew = skew.ravel()[: n * (2 * n - 1)].reshape(n, 2 * n - 1)
    out = []
    for mask in (skew, near):
        runs = _run_lengths(mask)
        runs = runs[runs >= 2]
        p = np.unique(runs, return_counts=True)[1] / (len(runs) + 1e-12)
        out.append((runs.sum() / max(total, 1), runs.mean() if len(runs) else 1.0, float(-(p * np.log(p + 1e-12)).sum())))
    return total / (n * n), out[0][0], out[1][0], out[0][1], out[1][1], out[0][2]


def recurrence(rows: DataFrame, dim: int = 3, delay: int = 2, threshold: float = 0.15, cap: int = 300, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, recurrence_rate, determinism, laminarity, mean_diag_length, trapping_time, entropy_diag, level).

    Delay vectors are strided to under twice cap, so that a signal's pairs are
    one bounded matrix; pairs nearer than threshold times the largest distance
    are recurrent, and lines are runs of them along a diagonal or a column.
    """
    e = embed(rows, dim, delay, vector, order)
    n0 = e.groupBy(KEY).agg(F.count("*").alias("n0"))
    e = e.join(n0, KEY).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n0") / cap)))
    e = e.filter(F.col("j") % F.col("step") == 0).select(KEY, "j", "e")
    names = ["recurrence_rate", "determinism", "laminarity", "mean_diag_length", "trapping_time", "entropy_diag"]

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*ids, *recurrence_lines(np.stack(df.sort_values("j").e.to_numpy()), threshold))], columns=[KEY, *names])

    kind = rows.schema[KEY].dataType.simpleString()
    out = spread(e, KEY).groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, " + ", ".join(f"{k} double" for k in names))
    level = F.when(F.col("determinism") > 0.8, "high").when(F.col("determinism") > 0.5, "medium").when(F.col("determinism") > 0.2, "low").otherwise("random")
    return out.withColumn("level", F.concat(level, F.when(F.col("laminarity") > 0.6, "+laminar").otherwise("")))


def mahalanobis_2d(rows: DataFrame, a: str, b: str, order: str = "w") -> DataFrame:
    """(signal_id, w, score): distance from the mean in units of the sample covariance (+ 1e-6 on the diagonal), in closed form for two features."""
    m = rows.groupBy(KEY).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) + 1e-6).alias("vaa"), (F.var_samp(b) + 1e-6).alias("vbb"), F.covar_samp(a, b).alias("vab"))
    z = rows.join(m, KEY)
    da, db = F.col(a) - F.col("ma"), F.col(b) - F.col("mb")
    det = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    q = F.try_divide(F.col("vbb") * da * da - 2 * F.col("vab") * da * db + F.col("vaa") * db * db, det)
    return z.select(KEY, order, F.sqrt(q).alias("score"))


def mahalanobis(rows: DataFrame, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, w, score) for vectors of any size: moments are summed natively, one inverse for each signal, then a map over rows."""
    long = rows.select(KEY, order, F.posexplode(vector).alias("p", "u"))
    means = long.groupBy(KEY, "p").agg(F.avg("u").alias("m"))
    centred = long.join(means, [KEY, "p"]).select(KEY, order, "p", (F.col("u") - F.col("m")).alias("c"))
    arrays = centred.groupBy(KEY, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda s: s["c"]).alias("c"))

    def partial(batches):
        for df in batches:
            for key, part in df.groupby(KEY):
                z = np.stack(part.c.to_numpy())
                yield pd.DataFrame({KEY: [key], "s": [(z.T @ z).ravel()], "n": [len(z)]})

    def inverse(df: pd.DataFrame) -> pd.DataFrame:
        s, n = np.sum(np.stack(df.s.to_numpy()), 0), int(df.n.sum())
        d = int(round(len(s) ** 0.5))
        return pd.DataFrame({KEY: [df[KEY].iloc[0]], "inv": [np.linalg.pinv(s.reshape(d, d) / max(n - 1, 1) + 1e-6 * np.eye(d)).ravel()], "n": [n]})

    inv = arrays.select(KEY, "c").mapInPandas(partial, f"{KEY} string, s array<double>, n bigint").groupBy(KEY).applyInPandas(inverse, f"{KEY} string, inv array<double>, n bigint")

    @F.pandas_udf("double")
    def form(c: pd.Series, inv: pd.Series) -> pd.Series:
        out = [float(np.sqrt(max(0.0, np.asarray(x) @ np.asarray(m).reshape(len(x), -1) @ np.asarray(x)))) for x, m in zip(c, inv)]
        return pd.Series(out)

    return arrays.join(inv.filter("n >= 5"), KEY).select(KEY, order, form("c", "inv").alias("score"))


def anomalies(scores: DataFrame, share: float = 0.05, top: int | None = 10, order: str = "w") -> DataFrame:
    """Rows whose score is over its percentile, the first ``top`` by place, or all if it is None."""
    p = scores.groupBy(KEY).agg(F.percentile("score", F.lit(1 - share)).alias("_p"))
    z = scores.join(p, KEY).filter(F.col("score") > F.col("_p"))
    if top is None:
        return z.drop("_p")
    return z.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(order))).filter(F.col("_r") <= top).drop("_r", "_p")


def clusters(rows: DataFrame, k: int = 4, seed: int = 42, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, w, cluster) of all rows together, standardised as one matrix."""
    s = rows.select(F.explode(vector).alias("u")).agg(F.avg("u").alias("m"), F.stddev_pop("u").alias("d")).first()
    m, d = s.m or 0.0, (s.d or 0.0) + 1e-12
    z = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: (x - m) / d)))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=20).fit(z)
    return model.transform(z).select(KEY, order, F.col("cluster").cast("bigint").alias("cluster"))


def cluster_profile(assigned: DataFrame, rows: DataFrame, vector: str = "x", order: str = "w") -> DataFrame:
    """(cluster, size, fraction, first, last, mean): what is in each cluster."""
    z = assigned.join(rows, [KEY, order])
    dims = z.select("cluster", F.posexplode(vector).alias("p", "u")).groupBy("cluster", "p").agg(F.avg("u").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("mean"))
    n = z.groupBy("cluster").agg(F.count("*").alias("size"), F.min(order).alias("first"), F.max(order).alias("last"))
    total = assigned.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).join(dims, "cluster").select("cluster", "size", (F.col("size") / F.col("_t")).alias("fraction"), "first", "last", "mean")


def silhouette(assigned: DataFrame, rows: DataFrame, block: int = 512, vector: str = "x", order: str = "w") -> DataFrame:
    """(silhouette): mean of (b - a) / max(a, b) by Euclidean distance over all rows, compared by blocks of about block rows; singletons count 0."""
    z = assigned.join(rows, [KEY, order]).select(KEY, order, "cluster", vector).persist()
    blocks = F.pmod(F.xxhash64(KEY, order), F.lit(1 + z.count() // block)).alias("_k")
    packed = z.groupBy(blocks).agg(F.collect_list(F.struct(F.col(KEY).alias("_s"), F.col(order).alias("_o"), F.col("cluster").alias("_c"), F.col(vector).alias("_x"))).alias("_a"))
    spread = packed.crossJoin(packed.select(F.col("_a").alias("_b")))

    def partial(batches):
        for df in batches:
            for left, right in zip(df["_a"], df["_b"]):
                x, y = (np.array([list(r["_x"]) for r in side], float) for side in (left, right))
                c = np.array([r["_c"] for r in right])
                d = np.stack([np.sqrt(((y - v) ** 2).sum(1)) for v in x])
                for k in np.unique(c):
                    yield pd.DataFrame({"_s": [r["_s"] for r in left], "_o": [r["_o"] for r in left], "_c": [r["_c"] for r in left], "cluster": k, "d": d[:, c == k].sum(1), "n": int((c == k).sum())})

    d = spread.select("_a", "_b").repartition(z.sparkSession.sparkContext.defaultParallelism).mapInPandas(partial, f"_s string, _o {dict(z.dtypes)[order]}, _c bigint, cluster bigint, d double, n bigint")
    m = d.groupBy("_s", "_o", "_c", "cluster").agg(F.sum("d").alias("sum"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("_c")
    s = m.groupBy("_s", "_o").agg(F.max(F.when(own, F.try_divide(F.col("sum"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("sum") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    value = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return s.agg(F.avg(value).alias("silhouette"))


def factors(rows: DataFrame, k: int = 4, vector: str = "x", order: str = "w") -> DataFrame:
    """(signal_id, component, weight, character, peaks, basis, relative_error): non-negative factors of each signal's matrix, shifted to its least value."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order)
        x = np.stack(df[vector].to_numpy()).astype(float).T
        x = x - x.min()
        w, h, _ = nmf(x, k)
        error = float(np.mean((x - w @ h) ** 2) / (np.mean(x * x) + 1e-12))
        top = h.max(1) + 1e-12
        w, h = w * top, h / top[:, None]
        share = w.sum(0) / (w.sum() + 1e-12)
        f = np.linspace(0, 8000, len(w))
        out = []
        for j in range(w.shape[1]):
            b = w[:, j] / (w[:, j].sum() + 1e-12)
            third = max(1, len(b) // 3)
            character = "low" if b[:third].sum() > 0.5 else "high" if b[-third:].sum() > 0.4 else "bright" if f @ b > 2000 else "mid"
            at = find_peaks(h[j], distance=max(1, h.shape[1] // 10))
            at = np.sort(at[np.argsort(-h[j][at], kind="stable")[:5]])
            out.append((df[KEY].iloc[0], j, float(share[j]), character, df[order].to_numpy()[at].tolist(), w[:, j].tolist(), error))
        return pd.DataFrame(out, columns=[KEY, "component", "weight", "character", "peaks", "basis", "relative_error"])

    return rows.select(KEY, order, vector).groupBy(KEY).applyInPandas(run, f"{KEY} string, component bigint, weight double, character string, peaks array<bigint>, basis array<double>, relative_error double")


def principal(rows: DataFrame, vector: str = "x") -> DataFrame:
    """(signal_id, component, variance, share): principal components of each signal, from summed outer products."""

    def partial(batches):
        for df in batches:
            for key, part in df.groupby(KEY):
                z = np.stack(part[vector].to_numpy()).astype(float)
                yield pd.DataFrame({KEY: [key], "n": [len(z)], "s": [z.sum(0)], "q": [(z.T @ z).ravel()]})

    def run(df: pd.DataFrame) -> pd.DataFrame:
        n, s, q = df.n.sum(), np.sum(np.stack(df.s.to_numpy()), 0), np.sum(np.stack(df.q.to_numpy()), 0)
        c = (q.reshape(len(s), -1) - np.outer(s, s) / n) / max(n - 1, 1)
        v = np.maximum(np.linalg.eigvalsh(c)[::-1], 0)
        return pd.DataFrame({KEY: df[KEY].iloc[0], "component": np.arange(len(v)), "variance": v, "share": v / (v.sum() + 1e-300)})

    sums = rows.select(KEY, vector).mapInPandas(partial, f"{KEY} string, n bigint, s array<double>, q array<double>")
    return sums.groupBy(KEY).applyInPandas(run, f"{KEY} string, component bigint, variance double, share double")
