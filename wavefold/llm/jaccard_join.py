"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles. Every set samples some of its shingles,
each with a probability of so many in its size, by a hash that all sets share;
similar sets thus sample the same shingles with high probability. Sets that
sampled the same shingle form a bucket. One sample of ``runs`` / threshold
shingles stands for that many runs of the recursion, enough that a pair at the
threshold shares no bucket with a probability of exp(-runs) only. A bucket of
more than ``small`` sets is split again: its sets sample shingles by a hash
that depends on the bucket's path. Small buckets are compared by brute force.
What is still large after ``depth`` levels are groups of near copies, which
nothing separates: large buckets that overlap are one group, which is cut into
pairs of blocks, so that every pair of it meets once.

A pair meets in several small buckets; the one with the smallest path counts it,
which both sets can tell from the paths they carry, unless they are in one
group. Sets also carry a sketch of their sample: a pair whose samples share far
less than the threshold lets expect is not compared. So only sets with a pair to
compare in a bucket send their shingles there, and pairs never become rows: a
bucket reports each set's number of links and one link to its component there.

Recall is measured: up to ``audit`` texts, drawn by hash, are held against every
row while the rows are read, and the links found are counted against the true
ones. While the share found is below the target, the runs are repeated, twice as
many each time; if it stays below, that is an error.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _graph, _store
from ._spans import key_of, keyed, sifted
from ._text import U, buffers, chunks, expand, grams, mix, prefix, runs, word_hashes

WORDS, THRESHOLD, RUNS, SAMPLE, SMALL, DEPTH = 5, 0.8, 14, 32, 128, 3
#: Sets in a block of a group; share of the smaller sample that a pair must have in common to be compared: with
#: samples of 40 and 32 in common on average at the threshold, a pair falls short of it once in some 100,000.
BLOCK, COMMON = 512, 0.28
#: Texts that recall is audited with and their longest (in characters), its target, and how often runs are repeated.
AUDIT, AUDIT_TEXT, RECALL, ATTEMPTS = 256, 1 << 17, 0.99, 4
TOP = float(1 << 64)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all rows in order of (row, hash), the rows' bounds (n + 1), and a 64-bit hash of each row's word sequence.

    A row of fewer words than a shingle has, but not none, has one shingle.
    """
    h, first = word_hashes(raw, offsets)
    p = prefix(h)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, 0)
    start, row = expand(first[:-1], count)
    out = grams(p, words)[start] if len(start) else np.zeros(0, U)
    whole = runs(p, first[:-1], first[1:])
    short = np.flatnonzero((n > 0) & (n < words))
    out, row = np.r_[out, mix(whole[short] ^ U(0x5851F42D4C957F2D))], np.r_[row, short]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])] if len(out) else np.zeros(0, bool)
    out, row = out[new], row[new]
    whole ^= n.astype(U) * U(0x9E3779B97F4A7C15)
    return out, np.searchsorted(row, np.arange(len(offsets))), mix(whole)


def _longs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


class Audit:
    """Texts that are held against all rows: their nodes, and their shingles in order of hash with the text each is of."""

    def __init__(self, texts: list[str], words: int, threshold: float):
        body = [t.encode() for t in texts]
        raw, offsets = np.frombuffer(b"".join(body), np.uint8), np.r_[0, np.cumsum([len(t) for t in body])].astype(np.int64)
        h, first, node = shingles(raw, offsets, words)
        self.nodes, self.size, self.threshold = node.view(np.int64), np.diff(first), threshold
        owner = np.repeat(np.arange(len(body)), self.size)
        order = np.argsort(h, kind="stable")
        self.owner = owner[order]
        self.keys, self.start = np.unique(h[order], return_index=True)
        self.count = np.diff(np.r_[self.start, len(h)])

    def near(self, h: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
        """For every row of size shingles the texts that are linked with it."""
        q = len(self.size)
        if not len(self.keys):
            return pa.array([[]] * len(size), pa.list_(pa.int32()))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        place, own = expand(self.start[at[hit]], self.count[at[hit]])
        pair, both = np.unique(row[hit][own] * q + self.owner[place], return_counts=True)
        r, text = pair // max(q, 1), pair % max(q, 1)
        linked = both * (1 + self.threshold) >= self.threshold * (size[r] + self.size[text]) - 1e-6
        r, text = r[linked], text[linked]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(size) + 1)).astype(np.int32)), pa.array(text.astype(np.int32)))

    def recall(self, true: dict[int, int], found: dict[int, tuple[int, int]]) -> float | None:
        """Mean share found of each text's links with other texts; None if no text has any. true: rows near each text; found: links and copies by node."""
        share = []
        for k, node in enumerate(self.nodes.tolist()):
            links, copies = found.get(node, (0, 1))
            others = true.get(k, 0) - copies
            if others > 0:
                share.append((links - copies + 1) / others)
        return sum(share) / len(share) if share else None


def draw(texts: DataFrame, audit: int, words: int, threshold: float) -> Audit:
    """Up to audit different texts, those of the smallest hashes; one of more than AUDIT_TEXT characters is not drawn."""
    rows = texts.count()
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, 4 * audit / max(1, rows))) if rows > 4 * audit else (1 << 63) - 1
    some = texts.select("text", F.xxhash64("text").alias("h")).filter((F.col("h") <= bound) & (F.length("text") <= AUDIT_TEXT) & (F.length("text") > 0))
    return Audit([r.text for r in some.distinct().orderBy("h", "text").limit(audit).collect()], words, threshold)


def _sampled(batches: Iterator[pa.RecordBatch], words: int, threshold: float, runs_: float, sample: float, audit: Audit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            h, first, content = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            n = np.diff(first)
            row = np.repeat(np.arange(j - i), n)
            at = mix(h.copy()).astype(np.float64) / TOP * n[row] * threshold
            take = at < sample
            order = np.lexsort((at[take], row[take]))
            bounds = np.r_[0, np.cumsum(np.bincount(row[take], minlength=j - i))]
            chosen = np.bincount(row[at < runs_], minlength=j - i)
            cols = [batch.column(c).slice(i, j - i) for c in ("doc_id", "k1", "k2")]
            cols += [pa.array(content.view(np.int64)), pa.array(n.astype(np.int64)), _longs(h[take][order], bounds), pa.array(chosen.astype(np.int32)), audit.near(h, row, n)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "node", "n", "sample", "chosen", "near"])


def _split(batches: Iterator[pa.RecordBatch], threshold: float, rate: float) -> Iterator[pa.RecordBatch]:
    """Paths that go on from a bucket: shingles of the set's sample, chosen by a hash that the path salts."""
    for batch in batches:
        lists = batch.column("sample")
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        path = batch.column("path").to_numpy().view(U)
        h = mix(lists.flatten().to_numpy().view(U) ^ mix(path * U(0xBF58476D1CE4E5B9))[row])
        take = h.astype(np.float64) / TOP * n[row] * threshold < rate
        of = pa.array(row[take])
        yield pa.RecordBatch.from_arrays([batch.column("node").take(of), pa.array(mix(h[take] + path[row[take]]).view(np.int64))], names=["node", "path"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable) -> Iterator[pa.RecordBatch]:
    """work() of every group of rows that come next to each other; groups are bounded."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        bounds = _bounds(table, keys)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield from work(table.slice(a, b - a))
        held = table.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield from work(held)


def _bounds(table: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def _shared(table: pa.Table, column: str, below: int | None = None) -> np.ndarray:
    """Number of values that the rows' lists have in common, pair by pair."""
    lists = _flat(table.column(column))
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    own, values = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
    if below is not None:
        own, values = own[values < below], values[values < below]
    u, col = np.unique(values, return_inverse=True)
    often = np.bincount(col, minlength=len(u)) > 1
    keep = often[col]
    col, own = (np.cumsum(often) - 1)[col[keep]], own[keep]
    out = np.zeros((len(n), len(n)), np.float32)
    for a in range(0, int(often.sum()), 8192):
        b = np.zeros((len(n), 8192), np.float32)
        here = (col >= a) & (col < a + 8192)
        b[own[here], col[here] - a] = 1
        out += b @ b.T
    return out


def _flat(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _pairs(table: pa.Table, threshold: float) -> np.ndarray:
    """Which pairs this bucket counts, or this pair of blocks of a group (tile >= 0), by paths, groups and sizes."""
    size = table.column("n").to_numpy().astype(float)
    out = np.triu(np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9, 1)
    tile = int(table.column("tile")[0].as_py())
    if tile >= 0:
        block = table.column("block").to_numpy()
        if tile >> 20 != tile & ((1 << 20) - 1):
            out &= np.not_equal.outer(block, block)
        return out
    out &= _shared(table, "paths", table.column("path")[0].as_py()) == 0
    group, some = table.column("grp").to_numpy(), table.column("grouped").to_numpy(zero_copy_only=False)
    return out & ~(np.equal.outer(group, group) & some[:, None] & some[None])


def _needed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(table, threshold)
        if pairs.any():
            n = _flat(table.column("sketch")).value_lengths().to_numpy(zero_copy_only=False)
            pairs &= _shared(table, "sketch") >= COMMON * np.minimum.outer(n, n)
        wanted = np.flatnonzero(pairs.any(0) | pairs.any(1))
        if len(wanted):
            yield table.take(pa.array(wanted)).combine_chunks().to_batches()[0]

    return _groups(batches, ["path", "tile"], work)


def _texts_to_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Shingles of each set, for each bucket that wants it. Equal rows that come next to each other are one."""
    last = None
    for whole in batches:
        node = whole.column("node").to_numpy()
        if not len(node):
            continue
        new = np.r_[last != node[0], node[1:] != node[:-1]]
        last = node[-1]
        batch = whole.filter(pa.array(new))
        raw, offsets = buffers(batch.column("text"))
        lists = batch.column("buckets")
        flat, ends = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        for i, j in chunks(offsets):
            h, first, _ = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            for r in range(i, j):
                part = flat.slice(ends[r], ends[r + 1] - ends[r])
                data = h[first[r - i] : first[r - i + 1]].tobytes()
                for a in range(0, len(part), 256):
                    some = part.slice(a, 256)
                    of = pa.array(np.full(len(some), r))
                    cols = [some.field("path"), some.field("tile"), some.field("block"), *(batch.column(c).take(of) for c in CARRIED), pa.array([data] * len(some), pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "tile", "block", *CARRIED, "data"])


CARRIED = ["node", "n", "copies", "paths", "grp", "grouped"]


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        table = table.filter(pa.array(np.r_[True, node[1:] != node[:-1]]))  # rows come in order of node
        pairs = _pairs(table, threshold)
        raw, offsets = buffers(table.column("data"))
        size = np.diff(offsets) // 8
        sets = pa.table({"set": pa.ListArray.from_arrays(pa.array((offsets // 8).astype(np.int32)), pa.array(np.frombuffer(raw.tobytes(), np.int64)))})
        both = _shared(sets, "set")
        pairs &= both * (1 + threshold) >= threshold * np.add.outer(size, size) - 1e-6
        linked = pairs | pairs.T
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        root = np.arange(len(size))
        while True:  # smallest place among neighbours, until nothing changes
            low = np.minimum(root, np.where(linked, root[None, :], len(size)).min(1))
            if (low == root).all():
                break
            root = low
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array((linked @ copies)[some].astype(np.int64))], names=["u", "v", "links"])

    return _groups(batches, ["path", "tile"], work)


def linked_rows(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, run_count: float = RUNS, sample: float = SAMPLE, small: int = SMALL, depth: int = DEPTH, audit: int = AUDIT, recall: float = RECALL, attempts: int = ATTEMPTS) -> DataFrame:
    """Per row of docs: doc_id, its key (k1, k2), n, n_links, and the smallest doc_id (low) and one key of all (root) of its component. See jaccard_join()."""
    texts = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    held = draw(texts, audit, words, threshold)
    for attempt in range(attempts):
        rows, result = _joined(texts, words, threshold, run_count, max(sample, 2 * run_count), small, depth, held)
        true = {r.q: r.n for r in rows.select(F.explode("near").alias("q")).groupBy("q").agg(F.count("*").alias("n")).collect()}
        found = {r.node: (r.n_links, r.copies) for r in result.filter(F.col("node").isin(held.nodes.tolist())).collect()}
        reached = held.recall(true, found)
        logging.getLogger(__name__).info("attempt %d, %s runs: recall %s", attempt, run_count, reached)
        if reached is None or reached >= recall:
            break
        run_count *= 2
    else:
        raise RuntimeError(f"recall is {reached:.4f} after {attempts} attempts, under {recall}")
    rows = rows.drop("sample", "chosen", "near")
    out = rows.filter("n > 0").join(result, "node").select("doc_id", "k1", "k2", "n", "n_links", "low", "root")
    return out.union(rows.filter("n = 0").select("doc_id", "k1", "k2", "n", F.lit(0).cast("long"), "doc_id", F.lit(None).cast("long")))


def _joined(texts: DataFrame, words: int, threshold: float, run_count: float, sample: float, small: int, depth: int, held: Audit) -> tuple[DataFrame, DataFrame]:
    """One attempt: the rows, with sets that have no shingle, and of each set (node) its links, copies, lowest id and root."""
    shape = "doc_id long, k1 long, k2 long, node long, n long, sample array<long>, chosen int, near array<int>"
    rows = _store.save(texts.mapInArrow(functools.partial(_sampled, words=words, threshold=threshold, runs_=run_count, sample=sample, audit=held), shape), "sets")
    sets = rows.filter("n > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("k1", "k2", "n", "sample", "chosen")).alias("of"))
    sets = _store.save(sets.select("node", "copies", "low", "of.*"), "classes")

    # Paths: buckets of one set are dropped, small ones are leaves, others are split again.
    paths = sets.select("node", F.explode(F.slice("sample", 1, F.greatest("chosen", F.lit(1)))).alias("path"))
    leaves = None
    for level in range(depth):
        paths = _store.save(paths.distinct() if level else paths, "paths")
        sizes = _store.save(paths.groupBy("path").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
        found = _store.save(paths.join(sizes, "path"), "buckets")
        done = found if level == depth - 1 else found.filter(F.col("m") <= small)
        leaves = done if leaves is None else leaves.union(done)
        hot = found.filter(F.col("m") > small)
        if level == depth - 1 or hot.isEmpty():
            break
        paths = hot.select("node", "path").join(sets.select("node", "sample"), "node").mapInArrow(functools.partial(_split, threshold=threshold, rate=1.25), "node long, path long")

    # Large leaves that overlap are one group of sets; it is dealt out in pairs of blocks.
    large = leaves.filter(F.col("m") > small)
    heads = _store.save(large.join(large.groupBy("path").agg(F.min("node").alias("v")), "path").select(F.col("node").alias("u"), "v").distinct(), "heads")
    groups = _store.save(_graph.components(heads).select("node", F.col("root").alias("grp")), "groups")
    blocks = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    grouped = groups.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, F.col("block")).cast("long") * (1 << 20) + F.greatest(b, F.col("block")))
    tiled = grouped.select("node", F.col("grp").alias("path"), F.explode(tiles).alias("tile"), "block")

    # Which sets have a pair to compare in which bucket: a pair is counted in the smallest leaf it shares.
    leaves = _store.save(leaves.filter(F.col("m") <= small).select("node", "path").distinct(), "leaves")
    own = leaves.groupBy("node").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    sketch = F.transform("sample", lambda x: (F.pmod(x, F.lit(65536)) - 32768).cast("short"))
    own = own.join(groups, "node", "full").join(sets.select("node", "n", sketch.alias("sketch")), "node")
    own = own.select("node", "n", F.coalesce("paths", F.array().cast("array<long>")).alias("paths"), F.coalesce("grp", F.lit(0)).alias("grp"), F.col("grp").isNotNull().alias("grouped"), F.array_distinct("sketch").alias("sketch"))
    own = _store.save(own, "own")
    dealt = leaves.select("node", "path", F.lit(-1).cast("long").alias("tile"), F.lit(0).alias("block")).union(tiled.select("node", "path", "tile", "block")).join(own, "node")
    needed = dealt.select("path", "tile", "block", "node", "n", "paths", "grp", "grouped", "sketch").repartition("path", "tile").sortWithinPartitions("path", "tile")
    shape = "path long, tile long, block int, node long, n long, paths array<long>, grp long, grouped boolean, sketch array<short>"
    needed = _store.save(needed.mapInArrow(functools.partial(_needed, threshold=threshold), shape).select("node", "path", "tile", "block"), "needed")

    # Those send their shingles there.
    wanted = needed.groupBy("node").agg(F.collect_list(F.struct("path", "tile", "block")).alias("buckets")).join(sets.select("node", "copies", "k1", "k2"), "node").join(own.drop("sketch"), "node")
    wanted = _store.save(wanted, "wanted")
    full = sifted(texts.select("k1", "k2", "text"), wanted).filter("maybe").join(wanted, ["k1", "k2"]).select(*CARRIED, "buckets", "text")
    full = full.mapInArrow(functools.partial(_texts_to_sets, words=words), "path long, tile long, block int, node long, n long, copies long, paths array<long>, grp long, grouped boolean, data binary")
    full = full.repartition("path", "tile").sortWithinPartitions("path", "tile", "node")
    links = _store.save(full.mapInArrow(functools.partial(_linked, threshold=threshold), "u long, v long, links long"), "links")

    roots = _graph.components(links.select("u", "v"))
    of_sets = sets.select("node", "copies", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_sets = of_sets.join(links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    lowest = of_sets.groupBy("root").agg(F.min("low").alias("low"))
    result = of_sets.drop("low").join(lowest, "root").select("node", "root", "low", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows, _store.save(result, "result")


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, n_links, component_id, kept.

    Rows are linked if the Jaccard similarity of their sets of shingles of
    ``words`` words is threshold or more; n_links counts the other rows linked
    directly, copies included. component_id is the smallest doc_id reachable by
    links, itself included, null ids aside; kept is doc_id = component_id.

    Words are separated by ASCII white space and unchanged. A text of fewer
    words than a shingle has is one shingle; a null, empty or blank text has
    none, is linked with nothing and kept. Rows with equal word sequences are
    copies, whatever their ids: they become one set with a count, so a group of
    any size costs one comparison. An empty table gives an empty result; other
    columns are ignored. A component without any id has a null component_id and
    its rows are kept. Links that are reported are exact; recall is audited with
    up to ``audit`` texts, and an error is raised if it stays under ``recall``.
    """
    out = linked_rows(docs, **options)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "n_links", F.col("low").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("low")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one row of each component of jaccard_join().

    The row with the smallest doc_id stays, one without an id only if none has
    one; of equal rows one stays. Rows without words stay, but of those that are
    equal in doc_id and text one. An empty table is returned empty; all columns
    stay as they are, whatever their names.
    """
    found = linked_rows(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = found.filter("root is not null").groupBy("root").agg(F.min(order).alias("best")).select("best.k1", "best.k2", F.lit(True).alias("best"))
    keys = found.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max("n").alias("n")).join(best, ["k1", "k2"], "left")
    keys = keys.select("k1", "k2", "copies", (F.col("best").isNotNull() | (F.col("n") == 0)).alias("stays"))
    keys = _store.save(keys.filter("not stays or copies > 1"), "keys")
    k1, k2 = key_of(docs["doc_id"], docs["text"])
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    rows = sifted(rows, keys)
    some = rows.filter("maybe")
    once = rows.filter("not maybe").union(some.join(keys, ["k1", "k2"], "left_anti")).select("row.*")
    twice = keys.filter("stays").select("k1", "k2")
    if twice.isEmpty():
        return once
    return once.union(some.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
