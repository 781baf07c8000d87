"""SQL of steps that several queries share: peaks, and errors of simple forecasts."""

from __future__ import annotations


def peaks(name: str, source: str, key: str, order: str, value: str, height: str | None = None, distance: str | None = None, prominence: str | None = None) -> str:
    """CTEs that end in ``name`` (key, p, v): peaks of each series of source, as kernels.find_peaks finds them where no neighbours are equal.

    height, distance and prominence are SQL over n (length of the series) and sd
    (its population deviation). The query has to start with WITH RECURSIVE.
    """
    parts = [
        f"{name}_0 AS (SELECT {key}, {order} AS o, {value} AS v, lag({value}) OVER w AS a, lead({value}) OVER w AS b, count(*) OVER g AS n, stddev_pop({value}) OVER g AS sd FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {order}), g AS (PARTITION BY {key}))",
        f"{name}_1 AS (SELECT {key}, o AS p, v, n, sd, row_number() OVER (PARTITION BY {key} ORDER BY v DESC, o DESC) AS rn FROM {name}_0 WHERE a < v AND b < v{f' AND v >= {height}' if height else ''})",
    ]
    last = f"{name}_1"
    if distance:
        of = " AND ".join(f"x.{k} = q.{k}" for k in key.split(", "))
        keys = ", ".join(f"q.{k}" for k in key.split(", "))
        parts += [
            f"{name}_2 AS (SELECT DISTINCT {key}, 0::BIGINT AS rn, []::BIGINT[] AS kept FROM {name}_1 UNION ALL SELECT {keys}, q.rn + 1, CASE WHEN len(list_filter(q.kept, lambda z: abs(z - x.p) < ceil({distance}))) = 0 THEN list_append(q.kept, x.p) ELSE q.kept END FROM {name}_2 q JOIN {name}_1 x ON {of} AND x.rn = q.rn + 1)",
            f"{name}_3 AS (SELECT {key}, unnest(kept) AS p FROM (SELECT {key}, arg_max(kept, rn) AS kept FROM {name}_2 GROUP BY {key}))",
            f"{name}_4 AS (SELECT {name}_1.* FROM {name}_1 JOIN {name}_3 USING ({key}, p))",
        ]
        last = f"{name}_4"
    if prominence:
        parts += [
            f"{name}_5 AS (SELECT {key}, k.p, k.v, max(t.o) FILTER (WHERE t.o < k.p AND t.v > k.v) AS lo, min(t.o) FILTER (WHERE t.o > k.p AND t.v > k.v) AS hi FROM {last} k JOIN {name}_0 t USING ({key}) GROUP BY {key}, k.p, k.v)",
            f"{name}_6 AS (SELECT {key}, k.p, k.v, k.v - greatest(min(t.v) FILTER (WHERE t.o <= k.p AND t.o > coalesce(lo, -1)), min(t.v) FILTER (WHERE t.o >= k.p AND t.o < coalesce(hi, 9e15))) AS high, any_value(t.n) AS n, any_value(t.sd) AS sd FROM {name}_5 k JOIN {name}_0 t USING ({key}) GROUP BY {key}, k.p, k.v, lo, hi)",
        ]
        last = f"(SELECT * FROM {name}_6 WHERE high >= {prominence})"
    return ", ".join(parts) + f", {name} AS (SELECT {key}, p, v FROM {last})"


def simple_errors(name: str, source: str, key: str, h: int) -> str:
    """CTEs that end in ``name`` (key, model, rmse): errors over the last h values of series (key, w, x), held against the last value before them and the mean of all before."""
    return (
        f"{name}_0 AS (SELECT {key}, x, row_number() OVER (PARTITION BY {key} ORDER BY w) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}), "
        f"{name}_1 AS (SELECT {key}, max(x) FILTER (WHERE i = n - {h}) AS naive, avg(x) FILTER (WHERE i <= n - {h}) AS mean FROM {name}_0 WHERE n >= {h} + 5 GROUP BY {key}), "
        f"{name}_2 AS (SELECT {key}, sqrt(avg((x - naive) ** 2)) AS naive, sqrt(avg((x - mean) ** 2)) AS mean FROM {name}_0 JOIN {name}_1 USING ({key}) WHERE i > n - {h} GROUP BY {key}), "
        f"{name} AS (SELECT {key}, 'naive' AS model, naive AS rmse FROM {name}_2 UNION ALL SELECT {key}, 'mean', mean FROM {name}_2)"
    )
