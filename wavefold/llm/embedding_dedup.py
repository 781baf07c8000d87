"""Embedding near-dedup by NN-descent.

Equal vectors become one node with a count. A first neighbour graph comes from
random projections: nodes sorted by the signs of projections are cut into
blocks, and each node keeps its nearest of each block. NN-descent then refines
it: every node joins its neighbours, forward and reverse, with each other, and
keeps the nearest, until little changes. A node whose whole list lies over the
threshold is saturated; lists are doubled while there are such nodes. What is
saturated at the longest list (a dense group of near copies) is compared
exactly, block by block within its component, and counted without listing
pairs. Recall is audited with a bounded set of nodes held against all rows: some
drawn at random, some that have links in the first graph, and some that have
links by other projections, which the graph never sees. It is the mean over
nodes that have links of the share found, so that dense groups weigh no more
than pairs, and it has to hold for nodes outside dense components alone as well,
and for the independent nodes alone. Below the target, more projections and rounds follow; where they
run out, the operator raises instead of returning links that are not whole.
"""

from __future__ import annotations

import functools
import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _graph, _store
from ._text import buffers

THRESHOLD, FLOOR, TABLES, BLOCK, LIST, LONGEST, ROUNDS, AUDIT, RECALL, TILE = 0.93, 0.5, 8, 64, 10, 40, 4, 1024, 0.99, 1024
#: Times that TABLES more projections are tried before the audit's failure is an error.
ATTEMPTS = 16
GRAPH = "u long, v long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows from equally long float32 binaries, in double precision."""
    raw, offsets = buffers(column)
    x = np.frombuffer(raw.tobytes(), np.float32).reshape(len(offsets) - 1, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for vec, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
            x = np.array([np.nan if v is None else v for v in vec or ()], np.float64)
            if label is None or not len(x) or not np.isfinite(x).all() or not x.any():
                rows.append((None, None, None))
                continue
            x = x / np.abs(x).max()  # the direction alone counts, and nothing over- or underflows
            data = (np.array(vec, np.float32) + np.float32(0)).tobytes()
            if not np.isfinite(np.frombuffer(data, np.float32)).all() or not 1e-18 < np.abs(np.frombuffer(data, np.float32)).max() < 1e18:
                data = x.astype(np.float32).tobytes()
            group = hashlib.blake2b(f"{label}/{len(x)}".encode(), digest_size=8).digest()
            rows.append((int.from_bytes(hashlib.blake2b(group + data, digest_size=8).digest(), "little", signed=True), int.from_bytes(group, "little", signed=True), data))
        cols = [batch.column("vec_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "node", "grp", "vec"])


def _coded(batches: Iterator[pa.RecordBatch], tables: range) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(buffers(batch.column("vec"))[1])
        for dim in np.unique(size):
            part = batch.take(pa.array(np.flatnonzero(size == dim)))
            x = _matrix(part.column("vec"))
            node = part.column("node").to_numpy()
            for t in tables:
                planes = np.random.default_rng((t % (1 << 32), x.shape[1])).standard_normal((x.shape[1], 24))
                code = ((x @ planes > 0) @ (1 << np.arange(23, -1, -1))).astype(np.int64)
                turn = (node.view(np.uint64) * np.uint64((2 * t + 3) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([part.column("grp"), pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(turn.astype(np.int64)), part.column("node"), part.column("vec")], names=["grp", "t", "code", "turn", "node", "vec"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, cut at most rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        bounds = np.r_[0, np.flatnonzero(new)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield from _cuts(table.slice(a, b - a), most)
        held = table.slice(bounds[-1])
        while most and held.num_rows >= 2 * most:
            yield held.slice(0, most)
            held = held.slice(most)
    if held is not None:
        yield from _cuts(held, most)


def _cuts(table: pa.Table, most: int | None) -> Iterator[pa.Table]:
    for a in range(0, table.num_rows, most or table.num_rows):
        yield table.slice(a, most)


def _nearest(node: np.ndarray, sim: np.ndarray, length: int, floor: float) -> list[np.ndarray]:
    """u, v, sim of each node's nearest others in a matrix of similarities."""
    np.fill_diagonal(sim, -2)
    k = min(length, len(node) - 1)
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    u = np.repeat(np.arange(len(node)), k)
    v, s = at.ravel(), np.take_along_axis(sim, at, 1).ravel()
    keep = s >= floor
    return [node[u[keep]], node[v[keep]], s[keep]]


def _emit(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(3)], names=["u", "v", "sim"])


def _joined(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None, length: int, floor: float) -> Iterator[pa.RecordBatch]:
    """The local join: nodes of each run (a block, or the neighbours of one node) are compared with each other."""
    parts, size = [], 0
    for run in _runs(batches, keys, most):
        if run.num_rows > 1:
            node = run.column("node").to_numpy()
            x = _matrix(run.column("vec"))
            parts.append(_nearest(node, x @ x.T, length, floor))
            size += len(parts[-1][0])
            if size > 50_000:
                yield _emit(parts)
                parts, size = [], 0
    if parts:
        yield _emit(parts)


def _best(edges: DataFrame, length: int, name: str = "graph") -> DataFrame:
    """The length nearest neighbours of each node."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return _store.save(edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", rank).filter(F.col("r") <= length).drop("r"), name)


def _projected(nodes: DataFrame, tables: range, length: int, floor: float, block: int) -> DataFrame:
    coded = nodes.select("node", "grp", "vec").mapInArrow(functools.partial(_coded, tables=tables), "grp long, t int, code long, turn long, node long, vec binary")
    sorted_ = coded.repartitionByRange("t", "grp", "code", "turn").sortWithinPartitions("t", "grp", "code", "turn")
    return sorted_.mapInArrow(functools.partial(_joined, keys=["t", "grp"], most=block, length=length, floor=floor), GRAPH)


def _descend(nodes: DataFrame, graph: DataFrame, length: int, floor: float) -> DataFrame:
    """One round: neighbours of each node, forward and reverse, meet at the node."""
    both = graph.select("u", "v", "sim").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v"))
    lists = both.select("u", "v").distinct().withColumn("r", rank).filter(F.col("r") <= 2 * length).drop("r")
    lists = lists.union(lists.select("u", F.col("u").alias("v")).distinct())
    met = lists.join(nodes.select(F.col("node").alias("v"), "vec"), "v").select("u", F.col("v").alias("node"), "vec")
    met = met.repartition("u").sortWithinPartitions("u")
    return met.mapInArrow(functools.partial(_joined, keys=["u"], most=None, length=length, floor=floor), GRAPH)


def _tiled(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """How many vectors each node of a pair of blocks is linked with there."""
    for run in _runs(batches, ["root", "tile"]):
        node, block, copies = (run.column(k).to_numpy() for k in ("node", "block", "copies"))
        a, b = divmod(int(run.column("tile")[0].as_py()), 1 << 20)
        x = _matrix(run.column("vec"))
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if a != b:
            linked &= np.not_equal.outer(block, block)
        n = linked @ copies
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some].astype(np.int64))], names=["node", "links"])


def _audited(batches: Iterator[pa.RecordBatch], queries: list, threshold: float) -> Iterator[pa.RecordBatch]:
    """True number of linked vectors of each query, summed over each batch."""
    by = {}
    for node, grp, data in queries:
        by.setdefault((grp, len(data)), []).append((node, data))
    by = {k: (np.array([n for n, _ in v]), _matrix(pa.array([d for _, d in v], pa.binary()))) for k, v in by.items()}
    for batch in batches:
        grp, node, copies = (batch.column(k).to_numpy() for k in ("grp", "node", "copies"))
        for (g, size), (own, q) in by.items():
            at = np.flatnonzero(grp == g)
            if len(at):
                x = _matrix(batch.column("vec").take(pa.array(at)))
                n = ((q @ x.T >= threshold) & np.not_equal.outer(own, node[at])) @ copies[at]
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(n[some].astype(np.int64))], names=["node", "links"])


def audited_recall(rows: list[tuple[int, int, bool]]) -> float | None:
    """Mean share found of the links of each query (true, found, dense) that has any: of all queries, or of those that are not dense, whichever is less; None without links."""
    share = [(min(found, true) / true, dense) for true, found, dense in rows if true]
    groups = [x for x, _ in share], [x for x, dense in share if not dense]
    return min((sum(g) / len(g) for g in groups if g), default=None)


def _drawn(nodes: DataFrame, some: DataFrame | None, limit: int) -> list[tuple]:
    """Up to limit nodes, of those in some (node) if given, in order of hash: (node, grp, vec)."""
    rows = nodes if some is None else nodes.join(some.distinct(), "node")
    return [(r.node, r.grp, r.vec) for r in rows.select("node", "grp", "vec").orderBy(F.xxhash64("node"), "node").limit(limit).collect()]


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR, tables: int = TABLES, block: int = BLOCK, length: int = LIST, longest: int = LONGEST, rounds: int = ROUNDS, audit: int = AUDIT, recall: float = RECALL, attempts: int = ATTEMPTS) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and their cosine, in double
    precision, is threshold or more. n_links counts the other rows linked
    directly, equal vectors included; component_id is the smallest vec_id
    reachable by links, itself included; kept is vec_id = component_id.

    Null labels, vectors that are null, empty or zero, that hold null or
    non-finite components, or that have another length, link with nothing and
    are kept. Repeated rows are linked copies. An empty table gives an empty
    result. Links that are reported are exact; recall is audited, and an error
    is raised if it stays under the target after all attempts.
    """
    rows = _store.save(vectors.select("vec_id", "embedding", "label").mapInArrow(_nodes, "vec_id long, node long, grp long, vec binary"), "vectors")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.min("grp").alias("grp"), F.min("vec").alias("vec"))
    nodes = _store.save(nodes, "nodes")
    graph = true = None
    for attempt in range(attempts):
        fresh = _projected(nodes, range(attempt * tables, (attempt + 1) * tables), length, floor, block)
        graph = _best(fresh if graph is None else graph.union(fresh), length)
        for _ in range(rounds):
            better = _best(graph.union(_descend(nodes, graph, length, floor)), length)
            changed = better.join(graph, ["u", "v"], "left_anti").count()
            size = better.count()
            graph = better
            # Saturated: the whole list lies over the threshold.
            full = graph.filter(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= length)
            if length < longest and not full.isEmpty():
                length = min(longest, 2 * length)
            elif changed <= 0.001 * size:
                break
        links = _store.save(graph.filter(F.col("sim") >= threshold).select("u", "v"), "links")
        full = links.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= length).select(F.col("u").alias("node"))
        roots = _store.save(_graph.components(links), "roots")
        found = _counted(nodes, links, roots, full, threshold)
        if true is None:
            other = _projected(nodes, range(-tables, 0), length, threshold, block).select(F.col("u").alias("node"))
            draws = {"random": _drawn(nodes, None, audit), "linked": _drawn(nodes, links.select(F.col("u").alias("node")), audit // 2), "independent": _drawn(nodes, other, audit // 2)}
            queries = list({q[0]: q for d in draws.values() for q in d}.values())
            true = nodes.mapInArrow(functools.partial(_audited, queries=queries, threshold=threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
            true = _store.save(true, "audit")
        dense = roots.join(full.join(roots, "node").select("root").distinct(), "root").select("node", F.lit(True).alias("dense"))
        seen = true.join(found, "node", "left").join(dense, "node", "left").select("node", "true", F.coalesce("links", F.lit(0)), F.coalesce("dense", F.lit(False))).collect()
        seen = {r[0]: tuple(r)[1:] for r in seen}
        by = {k: audited_recall([seen[q[0]] for q in d if q[0] in seen]) for k, d in draws.items()}
        reached = min((x for x in by.values() if x is not None), default=1.0)
        logging.getLogger(__name__).info("attempt %d: recall %s over %d true links", attempt, by, sum(x[0] for x in seen.values()))
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"recall is {reached:.4f} after {attempts} attempts, under {recall}")
    of = nodes.select("node", "copies", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = of.groupBy("root").agg(F.min("low").alias("component_id"))
    result = of.join(lowest, "root").join(found, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = _store.save(result, "result")
    out = rows.filter("node is not null").select("vec_id", "node").join(result, "node").select("vec_id", "n_links", "component_id")
    out = out.union(rows.filter("node is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _counted(nodes: DataFrame, links: DataFrame, roots: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(node, links): linked vectors of each node, copies counted; exact within components that have saturated nodes."""
    dense = _store.save(full.join(roots, "node").select("root").distinct(), "dense")
    light = roots.join(dense, "root", "left_anti").select(F.col("node").alias("u"))
    both = links.union(links.select("v", "u")).distinct().join(light, "u")
    few = both.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("links"))
    members = _store.save(roots.join(dense, "root"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, F.col("block")).cast("long") * (1 << 20) + F.greatest(b, F.col("block")))).alias("tile")
    dealt = members.join(nodes.select("node", "copies", "vec"), "node").select("root", "node", "copies", "vec", "block", tiles)
    dealt = dealt.repartition("root", "tile").sortWithinPartitions("root", "tile", "node")
    many = dealt.mapInArrow(functools.partial(_tiled, threshold=threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    return _store.save(few.union(many), "counts")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
