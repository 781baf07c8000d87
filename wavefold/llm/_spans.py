"""Repeated windows of fixed length in a corpus, exactly, by synchronised samples.

A text is a run of symbols: bytes, or hashes of words. Of every ``window``
consecutive symbols, the run of ``gram`` symbols with the smallest hash is the
window's anchor; equal windows have equal anchors at equal distances. An anchor
of a text owns the windows that chose it, and these cover one span. So

* windows whose anchor occurs once in the corpus occur once;
* if a whole span occurs again at an equal anchor, all its windows are repeated;
* only spans that differ round equal anchors are compared window by window.

About one symbol in (window - gram) / 2 becomes a row. Grouping is by the
anchor's hash and always by sums or minima; where more than ``wide`` different
spans share an anchor, they are cut into blocks of windows at equal distances
from the anchor, and what all windows of a block have in common takes the
anchor's place: a much longer text, which fewer spans share. This goes on down
to single windows, so no group is compared in one task unless it is small. Rows
are told apart by 128 bits of id and text; spans count as equal if the hashes of
anchor and span, some 60 bits each, both agree.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import CHUNK, U, buffers, choosers, chunks, expand, mix, prefix, runs, sliding_min, word_hashes, words

ANCHORS = "k1 long, k2 long, ah long, sh long, lo int, nw short, ld short"
#: Keys to a word of the Bloom filter of sifted(), and its most words, some 40 MB in memory; beyond them more rows pass.
KEYS, SIEVE = 8, 1 << 20


def key_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that rows of equal doc_id and text share and, in effect, no others; a null text is empty."""
    return tuple(F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id, F.coalesce(text, F.lit(""))) for seed in ("a", "b"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (k1, k2) that tells apart all rows but equal ones."""
    k1, k2 = key_of(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (k1, k2, ...) with a column maybe: false only where keys (k1, k2) don't hold the row's key.

    Tells most rows apart where they are read, by a Bloom filter that every task gets, so that only the others have to
    be shuffled with their texts for a join with keys, which must follow.
    """
    words = max(1, min(SIEVE, keys.count() // KEYS))
    word = F.pmod(F.col("k1"), F.lit(words).cast("long")).alias("word")
    bits = functools.reduce(lambda a, b: a.bitwiseOR(b), (F.expr(f"shiftleft(1L, cast(shiftright(k2, {6 * i}) & 63 as int))") for i in range(3)))
    sieve = keys.select(word, bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("held"))
    found = rows.withColumn("word", word).join(F.broadcast(sieve), "word", "left")
    return found.select(*rows.columns, F.coalesce(F.col("held").bitwiseAND(bits) == bits, F.lit(False)).alias("maybe"))


def _symbols(raw: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    return (raw, offsets) if unit == "byte" else word_hashes(raw, offsets)


def _sample(symbols: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Anchors of the rows that first delimits: (row, anchor hash, span hash, first owned window, owned windows, anchor's distance from it), positions from the row's start."""
    count = np.maximum(0, np.diff(first) - window + 1)
    if not count.any():
        return None
    p = prefix(symbols)
    key = choosers(symbols, gram)
    low = U((1 << max(1, len(symbols).bit_length())) - 1)
    key &= ~low
    key |= np.arange(len(key), dtype=U)
    start, row = expand(first[:-1], count)
    at = (sliding_min(key, window - gram + 1) & low)[start].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    at, lo, row, n = at[new], start[new], row[new], np.diff(np.r_[new, len(start)])
    span = runs(p, lo, lo + n - 1 + window)
    span ^= (at - lo).astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U)
    return row, runs(p, at, at + gram), mix(span), lo - first[row], n, at - lo


def _anchors(batches: Iterator[pa.RecordBatch], unit: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        k1, k2 = batch.column("k1"), batch.column("k2")
        for i, j in chunks(offsets):
            found = _sample(*_symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit), window, gram)
            if found:
                row, ah, sh, lo, n, ld = found
                of = pa.array(row + i)
                cols = [k1.take(of), k2.take(of), pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(ld.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "ah", "sh", "lo", "nw", "ld"])


def anchors(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """The sample of docs (k1, k2, text), in the shape ANCHORS."""
    return docs.select("k1", "k2", "text").mapInArrow(functools.partial(_anchors, unit=unit, window=window, gram=gram), ANCHORS)


def summary(found: DataFrame) -> DataFrame:
    """Per anchor hash: how often it occurs, whether its spans differ (s1 <> s2), and the windows of the widest."""
    return found.groupBy("ah").agg(F.count("*").alias("n"), F.min("sh").alias("s1"), F.max("sh").alias("s2"), F.max("nw").alias("nw"))


def _binary(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> pa.Array:
    """symbols[start : start + length] for every row, as a binary column."""
    at, _ = expand(start, length)
    stops = np.r_[0, np.cumsum(length)] * size
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(symbols[at]).view(np.uint8))])


def _contents(batches: Iterator[pa.RecordBatch], unit: str, window: int) -> Iterator[pa.RecordBatch]:
    """Symbols of the listed spans of each row."""
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        lists = batch.column("spans")
        flat, ends = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        lo, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "nw"))
        for i, j in chunks(offsets):
            symbols, first = _symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            for a in range(ends[i], ends[j], 1024):  # offsets of binary() are 32 bits
                b = min(a + 1024, ends[j])
                start = first[row[a - ends[i] : b - ends[i]]] + lo[a:b]
                rest = flat.slice(a, b - a)
                cols = [rest.field("ah"), rest.field("sh"), rest.field("ah"), rest.field("sh"), rest.field("m"), rest.field("nw"), pa.array(np.zeros(b - a, np.int32)), rest.field("ld").cast(pa.int32()), _binary(symbols, start, n[a:b] - 1 + window, 1 if unit == "byte" else 8)]
                yield pa.RecordBatch.from_arrays(cols, names=CONTENT)


#: A span or a part of one: of whom (span, of its anchor), its own anchor and hash, spans of its anchor, windows, place of the first in the span, anchor's distance from it.
CONTENT = ["of_ah", "of_sh", "ah", "sh", "m", "nw", "i0", "lead", "symbols"]
CONTENT_SHAPE = "of_ah long, of_sh long, ah long, sh long, m int, nw short, i0 int, lead int, symbols binary"


def _read(table: pa.Table | pa.RecordBatch, unit: str) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = buffers(table.column("symbols"))
    return (raw, offsets) if unit == "byte" else (np.frombuffer(raw.tobytes(), U), offsets // 8)


def _ranges(repeated: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int) -> pa.Array:
    """Per row, the ranges [a, b) of places that are repeated."""
    r, p = row[repeated], place[repeated]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]) if len(r) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(r)] - 1 if len(r) else new
    pairs = pa.StructArray.from_arrays([pa.array(p[new].astype(np.int32)), pa.array((p[last] + 1).astype(np.int32))], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(r[new], minlength=rows))].astype(np.int32)), pairs)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def by_hash(symbols: np.ndarray, first: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows, in order of (row, start), occur in another row of their row's group."""
    start, row = expand(first[:-1], np.diff(first) - window + 1)
    h, group = runs(prefix(symbols), start, start + window), group[row]
    order = np.lexsort((h, group))
    same = np.flatnonzero((h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1]))
    repeated = np.zeros(len(h), bool)
    repeated[order[same]] = repeated[order[same + 1]] = True
    return repeated


def _compare(batches: Iterator[pa.RecordBatch], unit: str, window: int, shared: Callable) -> Iterator[pa.RecordBatch]:
    """Windows that spans of one anchor share; rows come in order of ah."""

    def told(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        symbols, first = _read(table, unit)
        start, row = expand(first[:-1], np.diff(first) - window + 1)
        repeated = shared(symbols, first, table.column("ah").to_numpy(), window)
        place = start - first[row] + table.column("i0").to_numpy()[row]
        return pa.RecordBatch.from_arrays([_flat(table.column("of_ah")), _flat(table.column("of_sh")), _ranges(repeated, row, place, table.num_rows)], names=["of_ah", "of_sh", "ranges"])

    held: list[pa.Table] = []
    size = 0
    for batch in (b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)):
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size > CHUNK:
            table = pa.concat_tables(held)
            ah = table.column("ah").to_numpy()
            cut = int(np.searchsorted(ah, ah[-1], "left"))  # the last group may go on
            if cut:
                yield told(table.slice(0, cut))
            held = [table.slice(cut)]
            size = held[0].nbytes
    if held:
        yield told(pa.concat_tables(held))


def _divide(batches: Iterator[pa.RecordBatch], unit: str, window: int, block: int) -> Iterator[pa.RecordBatch]:
    """Spans cut into blocks of windows by their distance from the anchor; a block's anchor is what its windows have in common."""
    size = 1 if unit == "byte" else 8
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            batch = whole.slice(a, 1024)
            symbols, first = _read(batch, unit)
            p = prefix(symbols)
            lead, n = batch.column("lead").to_numpy().astype(np.int64), batch.column("nw").to_numpy().astype(np.int64)
            low, high = (lead - n + 1) // block, lead // block
            b, row = expand(low, high - low + 1)
            i = np.maximum(0, lead[row] - (b + 1) * block + 1)  # first and last window of the block that the span has
            j = np.minimum(n[row] - 1, lead[row] - b * block)
            base = first[row]
            core = runs(p, base + lead[row] - b * block, base + lead[row] - (b + 1) * block + 1 + window)
            ah = mix(core ^ mix(batch.column("ah").to_numpy().view(U)[row] + b.astype(U) * U(0x9E3779B97F4A7C15)))
            sh = mix(runs(p, base + i, base + j + window) ^ mix((lead[row] - i).astype(U) * U(0x9E3779B97F4A7C15) + (j - i).astype(U)))
            of = pa.array(row)
            cols = [batch.column("of_ah").take(of), batch.column("of_sh").take(of), pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array((j - i + 1).astype(np.int16)), pa.array((batch.column("i0").to_numpy()[row] + i).astype(np.int32)), pa.array((lead[row] - i).astype(np.int32)), _binary(symbols, base + i, j - i + window, size)]
            yield pa.RecordBatch.from_arrays(cols, names=[c for c in CONTENT if c != "m"])


def repeats(docs: DataFrame, found: DataFrame, known: DataFrame, unit: str, window: int, gram: int, wide: int = 128, shared: Callable = by_hash) -> DataFrame:
    """(k1, k2, runs array<struct<s, e>>): symbols [s, e) of repeated windows, for rows that have any.

    docs: keyed(); found: anchors() of docs; known: the anchors that occur more
    than once, with the least and the greatest hash of their spans (ah, s1, s2),
    written, so that a hot anchor's partition can be split in the join; shared:
    tells which windows spans of one anchor share.
    """
    at = [F.col("k1"), F.col("k2"), F.col("lo"), F.col("nw"), F.col("ld")]
    hits = _store.save(found.join(known.select("ah", "s1", "s2"), "ah").select(*at, "ah", "sh", (F.col("s1") != F.col("s2")).alias("mixed")), "hits")
    spans = _store.save(hits.filter("mixed").groupBy("ah", "sh").agg(F.count("*").alias("c"), F.max(F.struct(*at)).alias("at")), "spans")
    sizes = _store.save(spans.groupBy("ah").agg(F.count("*").cast("int").alias("m")), "sizes")
    wanted = spans.join(sizes, "ah").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("ah", "sh", "m", "at.lo", "at.nw", "at.ld")).alias("spans"))
    content = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "spans")
    content = _store.save(content.mapInArrow(functools.partial(_contents, unit=unit, window=window), CONTENT_SHAPE), "content")

    def compared(rows: DataFrame) -> DataFrame:
        near = rows.filter(F.col("m") <= wide).select("of_ah", "of_sh", "ah", "i0", "symbols").repartition("ah").sortWithinPartitions("ah")
        near = near.mapInArrow(functools.partial(_compare, unit=unit, window=window, shared=shared), "of_ah long, of_sh long, ranges array<struct<a:int,b:int>>")
        return near.select("of_ah", "of_sh", F.explode("ranges").alias("r")).select("of_ah", "of_sh", "r.a", "r.b")

    ranges, block = compared(content), window - gram + 1
    hot = content.filter(F.col("m") > wide)
    while block > 1 and not hot.isEmpty():
        block = -(-block // 4)
        rest = [c for c in CONTENT if c != "m"]
        parts = hot.select(*rest).mapInArrow(functools.partial(_divide, unit=unit, window=window, block=block), ", ".join(x for x in CONTENT_SHAPE.split(", ") if not x.startswith("m ")))
        parts = _store.save(parts, "parts")
        twice = _store.save(parts.groupBy("ah").agg(F.count("*").alias("n"), F.min("sh").alias("s1"), F.max("sh").alias("s2")).filter("n > 1"), "twice")
        parts = _store.save(parts.join(twice, "ah").select(*rest, (F.col("s1") != F.col("s2")).alias("mixed")), "parts")
        equal = _store.save(parts.filter("mixed").groupBy("ah", "sh").agg(F.count("*").alias("c"), F.max(F.struct(*rest)).alias("one")), "equal")
        sizes = _store.save(equal.groupBy("ah").agg(F.count("*").cast("int").alias("m")), "sizes")
        again = parts.filter("mixed").select("of_ah", "of_sh", "ah", "sh", "i0", "nw").join(equal.filter("c > 1").select("ah", "sh"), ["ah", "sh"])
        sure = parts.filter("not mixed").select("of_ah", "of_sh", "i0", "nw").union(again.select("of_ah", "of_sh", "i0", "nw"))
        content = _store.save(equal.select("one.*").join(sizes, "ah").select(*CONTENT), "content")
        ranges = ranges.union(sure.select("of_ah", "of_sh", F.col("i0").alias("a"), (F.col("i0") + F.col("nw")).alias("b"))).union(compared(content))
        hot = content.filter(F.col("m") > wide)
    ranges = ranges.select(F.col("of_ah").alias("ah"), F.col("of_sh").alias("sh"), "a", "b")
    part = ranges.join(spans.filter("c = 1"), ["ah", "sh"]).select("at.k1", "at.k2", (F.col("at.lo") + F.col("a")).alias("s"), (F.col("at.lo") + F.col("b") + (window - 1)).alias("e"))
    end = F.col("lo") + F.col("nw") + (window - 1)
    whole = hits.filter("not mixed").select("k1", "k2", F.col("lo").alias("s"), end.alias("e"))
    again = hits.filter("mixed").join(spans.filter("c > 1").select("ah", "sh"), ["ah", "sh"]).select("k1", "k2", F.col("lo").alias("s"), end.alias("e"))
    return whole.union(again).union(part).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("runs"))


def covered(batch: pa.RecordBatch, first: np.ndarray, i: int, j: int) -> np.ndarray:
    """Of the symbols of rows i to j (delimited by first), which lie in the rows' runs."""
    lists = batch.column("runs").slice(i, j - i)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    base = np.repeat(first[:-1], n)
    size = first[-1] + 1
    s, e = (base + flat.field(k).to_numpy(zero_copy_only=False) for k in ("s", "e"))
    return np.cumsum(np.bincount(s, minlength=size) - np.bincount(e, minlength=size))[:-1] > 0


def _gone(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, symbols that mask has, and maximal runs of them."""
    total = np.r_[0, np.cumsum(mask)]
    opens = mask.copy()
    opens[1:] &= ~mask[:-1]
    edge = first[:-1][np.diff(first) > 0]
    opens[edge] = mask[edge]
    count = np.r_[0, np.cumsum(opens)]
    return total[first[1:]] - total[first[:-1]], count[first[1:]] - count[first[:-1]]


def _cut(batches: Iterator[pa.RecordBatch], unit: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            raw, o = raw_all[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if unit == "byte":
                first = o
                mask = covered(batch, first, i, j)
                kept, ends = raw[~mask], o - np.r_[0, np.cumsum(mask)][o]
            else:
                starts, stops, first = words(raw, o)
                mask = covered(batch, first, i, j)
                at, owner = expand(starts[~mask], (stops - starts)[~mask] + 1)  # each word and the byte after it
                kept = np.append(raw, np.uint8(32))[at]
                size = np.r_[0, np.cumsum(np.where(mask, 0, stops - starts + 1))]
                kept[size[1:][~mask] - 1] = 32
                ends = size[first]
            gone, runs_ = _gone(mask, first)
            view, trim = memoryview(np.ascontiguousarray(kept)), int(unit == "word")
            texts = [view[a : max(a, b - trim)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(gone), pa.array(runs_), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if keep_text:
                out.append(pa.array([bytes(t).decode(errors="replace") for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=CUT[: len(out)])


CUT = ["doc_id", "n_symbols", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def cut(docs: DataFrame, runs_: DataFrame, unit: str, keep_text: bool = False) -> DataFrame:
    """Every row of docs without the symbols in its runs: counts, the hash of what is left and, if asked for, the text itself (broken characters replaced)."""
    shape = "doc_id long, n_symbols long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return docs.join(runs_, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(functools.partial(_cut, unit=unit, keep_text=keep_text), shape)
