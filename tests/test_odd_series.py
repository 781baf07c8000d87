"""Queries against their SQL on small tables that the driver's tables don't resemble: equal neighbours, values at the mean, many windows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wavefold import catalog


def series_folder(path, series):
    """A folder with an events table: one user a series, a second between samples."""
    events = [(u, v) for u, ys in series.items() for v in ys]
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(events)), unit="s")
    pd.DataFrame({"event_id": np.arange(len(events)), "ts": ts.astype("datetime64[us]"), "user_id": [u for u, _ in events], "event_type": "view", "value": [float(v) for _, v in events], "props": "{}"}).to_parquet(f"{path}/events.parquet")
    return str(path)


def both(spark, folder, name, table="events"):
    """Rows of a query and of its SQL."""
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = duck.sql(catalog.ORACLES[name]).df()[got.columns]
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    return sorted(tuple(map(plain, r)) for r in got.collect()), sorted(tuple(map(plain, r)) for r in want.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["find_peaks", "peak_context"])
def test_equal_neighbours_are_no_peak(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    flat = [1, 2, 9, 9, 1, 2, 3, 1, 0, 5, 8, 8, 8, 2, 1, 7, 1, 2, 1]
    got, want = both(spark, series_folder(tmp_path, {1: flat, 2: rng.integers(0, 5, 200)}), name)
    assert want and got == want


def vector_folder(path, n, labels=1, dims=4, seed=2):
    """A folder with an embeddings table in which some vectors, and stretches of three, occur twice."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype("float32")
    x[n // 2 : n // 2 + n // 5] = x[: n // 5]
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": (np.arange(n) % labels).astype("int32")}).to_parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["motif_profile", "motif_report", "discord_report"])
def test_motifs_compare_every_subsequence(spark, tmp_path, name):
    """Over the 600 subsequences at which a stride began."""
    got, want = both(spark, vector_folder(tmp_path, 701), name, "embeddings")
    assert len(want) > 0 and got == want


def coarse_folder(path, n=200, copies=3):
    """Vectors of few whole numbers, the whole table several times over: distances that are equal, or would be but for their rounding."""
    x = np.tile(np.random.default_rng(3).integers(0, 3, (n, 4)), (copies, 1)).astype("float32")
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), "int32")}).to_parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["motif_report", "discord_report"])
def test_motifs_round_as_sql(spark, tmp_path, name):
    """Motifs and discords that only the last bits of distances tell apart, and the nearest of equals (of DuckDB with one thread)."""
    folder = coarse_folder(tmp_path)
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = duck.sql(catalog.ORACLES[name]).select(*got.columns).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_dots_round_as_sql():
    from wavefold.functions.blocks import distinct, dots
    from wavefold.operators.unsupervised import normed

    x = np.random.default_rng(9).standard_normal((50, 64))
    rows = pd.DataFrame({"i": range(50), "x": list(x), "y": list(x[::-1])})  # noqa: F841
    want = duckdb.sql("SELECT list_inner_product(x, y) AS d, list_transform(x, lambda q: (q - list_avg(x)) / (list_stddev_pop(x) + 1e-12)) AS z FROM rows ORDER BY i").df()
    assert (dots(x, x[::-1]) == want.d).all() and (normed(x) == np.stack(want.z)).all()
    assert dots(np.array([[1e308], [np.inf], [0.0]]), np.array([[10.0], [1.0], [1.0]])).tolist() == [np.inf, np.inf, 0.0]
    assert distinct(np.array([[1.0, 2], [1, 2], [3, 4], [1, 2], [3, 4]]), 2).tolist() == [0, 1, 2, 4]


def test_motifs_by_several_blocks(spark, monkeypatch):
    from wavefold.functions import blocks
    from wavefold.operators import unsupervised

    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 2))
    z = np.hstack([x[:-2], x[1:-1], x[2:]])
    z = (z - z.mean(1, keepdims=True)) / (z.std(1, keepdims=True) + 1e-12)
    far = 1 - z @ z.T
    np.fill_diagonal(far, np.inf)
    small = blocks.within
    monkeypatch.setattr(unsupervised, "within", lambda *a, **k: small(*a, **k, size=20))
    monkeypatch.setattr(blocks, "PIECE", 64)
    rows = spark.createDataFrame([("s", w, v.tolist()) for w, v in enumerate(x)], "signal_id string, w bigint, x array<double>")
    got = {r.j: (r.nearest, r.distance) for r in unsupervised.motif_profile(rows, 3).collect()}
    assert len(got) == 88 and all(got[j][0] == far[j].argmin() and abs(got[j][1] - far[j].min()) < 1e-9 for j in got)


@pytest.mark.parametrize("name", ["runs_test", "zero_crossing"])
def test_values_at_the_mean(spark, tmp_path, name):
    """Of a series whose mean is one of its values: that value is over the mean and no crossing, in whatever order the values are summed."""
    events = series_folder(tmp_path, {7: [0.2, 0.1, 0.3]})
    row = catalog.QUERIES[name](spark, events).first()
    assert row["runs"] == 3 if name == "runs_test" else row["zcr"] == 1


def test_runs_sum_as_sql(spark, tmp_path):
    """At values that are the mean, or nearly, the order of summing decides (that of DuckDB with one thread); also with a null, one value only, and sums that cancel."""
    rng = np.random.default_rng(5)
    series = {u: rng.integers(0, 60, n) / 10 for u, n in enumerate([10, 40, 67, 68, 69, 400, 2000] * 12)}
    for ys in series.values():
        ys[0] += np.round(len(ys) * np.round(np.mean(ys), 1) - np.sum(ys), 1)
    series |= {1000: [5.1] * 30, 1001: [0.1] * 3 + [np.nan] + [0.3] * 20, 1002: [1e16, 1, -1e16] * 8 + [0.0]}
    folder = series_folder(tmp_path, series)
    got = catalog.QUERIES["runs_test"](spark, folder)
    duck = duckdb.connect(config={"threads": 1})
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = duck.sql(catalog.ORACLES["runs_test"]).select(*got.columns).fetchall()
    assert len(want) == len(series) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_crossings_near_the_mean_as_sql(spark, tmp_path):
    """Values at the mean and some bits beside it, of sums that are the same in every order; no number has no sign."""
    flat, bit = [5, 7, 7, 5, 7, 3, 3, 3, 5, 5], 2.0**-45
    beside = {u: [y + d * bit if k == 3 else y for k, y in enumerate(flat)] for u, d in enumerate((-2, -1, 0, 1, 2))}
    odd = {10: [5.1] * 30, 11: [0.5] * 3 + [np.nan] + [0.25] * 20, 12: [np.inf, 1, 2] * 9, 13: [1, np.inf, 2], 14: [1, np.nan, 2], 15: [4]}
    got, want = both(spark, series_folder(tmp_path, beside | odd), "zero_crossing")
    assert len(want) == 11 and len({zcr for u, zcr in want if int(u) < 5}) > 1 and got == want


def test_crossings_sum_in_order(spark, tmp_path):
    """Where the order of the sum decides, SQL leaves it open, and the signal's own order is taken."""
    rng = np.random.default_rng(7)
    zcr = lambda ys, order: round(np.abs(np.diff(np.sign(ys - np.cumsum(order)[-1] / len(ys)))).sum() / len(ys), 6)
    series = {}
    for u, n in enumerate([10, 40, 67, 400] * 10):
        ys = rng.integers(0, 60, n) / 10
        ys[0] += np.round(n * np.round(np.mean(ys), 1) - np.sum(ys), 1)
        series[u] = ys
    assert sum(len({zcr(ys, rng.permutation(ys)) for _ in range(20)}) > 1 for ys in series.values()) >= 10
    got = catalog.QUERIES["zero_crossing"](spark, series_folder(tmp_path, series)).collect()
    assert {int(r.signal_id): r.zcr for r in got} == {u: zcr(ys, ys) for u, ys in series.items()}


@pytest.mark.parametrize("name", ["similarity_matrix", "best_match", "entropy_weighted_match"])
def test_similarity_by_blocks(spark, tmp_path, monkeypatch, name):
    """With copies, so that the first of equal matches counts wherever it stands."""
    small_blocks(monkeypatch)
    got, want = both(spark, vector_folder(tmp_path, 200, labels=10, dims=3), name, "embeddings")
    assert want and got == want


def small_blocks(monkeypatch):
    from wavefold.functions import blocks
    from wavefold.operators import similarity

    crossed = blocks.crossed
    monkeypatch.setattr(similarity, "crossed", lambda *a, **k: crossed(*a, **k, size=6))
    monkeypatch.setattr(blocks, "PIECE", 16)


def window_rows(spark, sizes, dims, seed=4):
    rng = np.random.default_rng(seed)
    x = {k: rng.standard_normal((n, dims)) * np.arange(1, dims + 1) + np.arange(dims) for k, n in sizes.items()}
    return x, spark.createDataFrame([(k, w, v.tolist()) for k, z in x.items() for w, v in enumerate(z)], "signal_id string, w bigint, x array<double>")


def brute(x, y):
    x, y = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12) for z in (x, y))
    return np.exp(-3 * (1 - x @ y.T) ** 2)


def test_nearest_both_ways(spark, monkeypatch):
    from wavefold.operators import similarity, trends

    small_blocks(monkeypatch)
    x, rows = window_rows(spark, {"a": 25, "b": 17, "c": 3}, 4)
    x["a"][20:] = x["a"][:5]
    rows = spark.createDataFrame([(k, w, v.tolist()) for k, z in x.items() for w, v in enumerate(z)], rows.schema)
    got = {(r.a_id, r.b_id, r.a_w): (r.b_w, round(r.sim, 9)) for r in similarity.nearest(rows, trends.pairs(spark, [("a", "b"), ("c", "a")]), back=True).collect()}
    want = {}
    for p, q in (("a", "b"), ("b", "a"), ("c", "a"), ("a", "c")):
        s = brute(x[p], x[q]).round(12)
        want |= {(p, q, w): (int(s[w].argmax()), round(float(s[w].max()), 9)) for w in range(len(s))}
    assert got == want


@pytest.mark.parametrize("name", ["similarity_matrix", "whitened"])
def test_matrices_are_handed_over_as_arrays(spark, monkeypatch, name):
    """A row of a with arrays of b, of which the JVM makes the rows; null where a vector is."""
    from wavefold.operators import similarity, trends

    shapes, crossed = [], similarity.crossed
    monkeypatch.setattr(similarity, "crossed", lambda rows, pair, run, shape, **k: shapes.append(shape) or crossed(rows, pair, run, shape, **k))
    x = [("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 1.0]), ("b", 2, [0.0, 1.0]), ("b", 3, [1.0, 0.0])] + [("b", 4, None)] * (name == "similarity_matrix")
    rows = spark.createDataFrame(x, "signal_id string, w bigint, x array<double>")
    got = {(r.a_w, r.b_w): r.sim for r in getattr(similarity, name)(rows, trends.pairs(spark, [("a", "b")]), digits=6).collect()}
    assert "array<double>" in shapes[0] and set(got) == {(i, j) for i in (0, 1) for j in (2, 3, 4)[: len(x) - 2]}
    if name == "similarity_matrix":
        assert got[0, 3] == 1 and got[0, 2] == round(float(np.exp(-3)), 6) and got[0, 4] is None and got[1, 4] is None


def test_whitened_holds_no_whole_matrix(spark, monkeypatch):
    """A row of a comes with the rows of one block of b, and a batch holds one piece, or one row of a; all pairs are there."""
    from wavefold.operators import similarity, trends

    small_blocks(monkeypatch)
    monkeypatch.setattr(similarity, "_listed", lambda arrays: arrays)
    x, rows = window_rows(spark, {"a": 60, "b": 40}, 4)
    got = similarity.whitened(rows, trends.pairs(spark, [("a", "b")])).collect()
    assert max(len(r.bs) for r in got) < 20 and sorted((r.a_w, w) for r in got for w in r.bs) == [*np.ndindex(60, 40)]
    batches = list(similarity._matrix(("a", "b"), np.arange(60), x["a"], np.arange(7), x["b"][:7], None))
    assert sum(len(b["sims"].flatten()) for b in batches) == 60 * 7 and max(len(b["sims"].flatten()) for b in batches) <= 16


def test_whitened_by_blocks(spark, monkeypatch):
    """Against the whole matrices of each pair; a side of 5 rows is only standardised."""
    from wavefold.operators import similarity, trends

    small_blocks(monkeypatch)
    x, rows = window_rows(spark, {"a": 25, "b": 17, "c": 5}, 4)
    got = {(r.a_id, r.b_id, r.a_w, r.b_w): r.sim for r in similarity.whitened(rows, trends.pairs(spark, [("a", "b"), ("c", "a")])).collect()}
    assert len(got) == 25 * 17 + 5 * 25
    for p, q in (("a", "b"), ("c", "a")):
        z = np.vstack([x[p], x[q]])
        z = (z - z.mean(0)) / z.std(0)
        if p == "a":
            value, basis = np.linalg.eigh(np.cov(z.T))
            value, basis = value[::-1], basis[:, ::-1]
            k = max(3, int(np.searchsorted(np.cumsum(value) / value.sum(), 0.95)) + 1)
            z = z @ basis[:, :k] / np.sqrt(value[:k])
        s = brute(z[: len(x[p])], z[len(x[p]) :])
        assert all(abs(got[p, q, i, j] - s[i, j]) < 1e-9 for i, j in np.ndindex(s.shape))
