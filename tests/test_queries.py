"""Every registered analysis query that has SQL, against DuckDB on the same tables; the others run and keep their schema."""

import os

import duckdb
import numpy as np
import pytest

from wavefold import catalog
from wavefold.operators import discovery, unsupervised

SF = os.environ.get("WAVEFOLD_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want[list(got.columns)])
    spark.catalog.clearCache()


QUICK = ("window_features", "pca_variance", "nmf_components", "kmeans_profile", "model_forecasts", "related_pair", "mfcc", "pattern_report", "similarity_report", "ensemble_report", "garch_fit", "corresponding_segments", "pair_overview", "hmm_states", "lag_profile", "lookback_insights")


@pytest.mark.parametrize("name", QUICK)
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_hmm_forecast_takes_every_user(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    few = [r.user_id for r in events.select("user_id").distinct().orderBy("user_id").limit(2).collect()]
    moved = (events.user_id + 1000).cast(events.schema["user_id"].dataType)
    events.filter(events.user_id.isin(few)).withColumn("user_id", moved).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.signal_id for r in catalog.QUERIES["hmm_forecast"](spark, str(tmp_path)).collect()} == {str(u + 1000) for u in few}


def test_self_motifs_search_every_lag(spark):
    """Against plain numpy, on signals whose least lag is over 12 and whose motifs come late."""
    from wavefold.functions.kernels import find_peaks

    rng = np.random.default_rng(5)
    rows, want = [], set()
    for name, n in (("a", 160), ("b", 140), ("c", 9)):
        x = rng.standard_normal((n, 4)) if name == "b" else np.eye(4)[np.arange(n) * 4 // n] + 0.05 * rng.standard_normal((n, 4))
        if name == "a":
            x[150:] = x[:10]
        rows += [(name, w, *map(float, v)) for w, v in enumerate(x)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        all_ = [(name, lag, int(p)) for lag in range(max(3, n // 10), n - 2) for p in find_peaks(np.diag(u @ u.T, lag), height=0.85, distance=3)]
        want |= set(all_[:20] if n >= 10 else [])
    names = ", ".join(f"{t}_norm double" for t in discovery.TRENDS)
    got = discovery.self_motifs(spark.createDataFrame(rows, f"signal_id string, w bigint, {names}"), block=8).collect()
    assert want and max(k for _, k, _ in want) > 12 and {(r.signal_id, r.lag, r.p) for r in got} == want


def test_silhouette_and_outliers_take_every_row(spark):
    rng = np.random.default_rng(6)
    c = np.r_[np.zeros(400), np.ones(300), 2].astype(int)
    x = rng.standard_normal((701, 3)) + c[:, None]
    rows = spark.createDataFrame([("s", w, v.tolist()) for w, v in enumerate(x)], "signal_id string, w bigint, x array<double>")
    assigned = spark.createDataFrame([("s", w, int(k)) for w, k in enumerate(c)], "signal_id string, w bigint, cluster bigint")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    value = []
    for i, k in enumerate(c):
        a = d[i, c == k].sum() / max(1, (c == k).sum() - 1)
        b = min(d[i, c == j].mean() for j in range(3) if j != k)
        value.append((b - a) / max(a, b) if (c == k).sum() > 1 else 0.0)
    assert abs(unsupervised.silhouette(assigned, rows, block=100).first()[0] - np.mean(value)) < 1e-9
    scores = spark.range(30000).selectExpr("'s' AS signal_id", "id AS w", "double(id) AS score")
    assert unsupervised.anomalies(scores, top=None).count() == 1500
