"""LM scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of the corpus: the target
model counts the texts that labels call good, the background model all texts,
with its counts scaled to the target's number of words, so that both are
smoothed alike. A text's score is the mean over its words of the loss under the
target model less that under the background model, in bits: the lower, the more
it is like the target.

Every word and every bigram is counted, however rare, by 64-bit hash. Texts are
written in chunks of some MB, as a table bucketed by chunk, and never move
again. The ids of a chunk's texts go to the labels, and the places of its target
texts come back. Each chunk then asks once for every word and bigram it holds,
with its own counts, in order of key and packed by ranges of keys. The sum over
all chunks that ask for the same one is the corpus count, and the sums go back
to each chunk in its own order. So a hot word is one entry a chunk, no counts
are broadcast, and what is counted grows with the corpus.

A caller that names a vocabulary size gets models of bounded size instead (the
most frequent words; bigrams in a table by hash), which fit a broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._spans import keyed
from ._text import U, buffers, chunks, mix, word_hashes

#: Share of the bigram estimate in a word's probability; bits of the bigram table where the vocabulary is bounded.
BIGRAM, BITS = 0.6, 19
#: Bytes and rows of text in a chunk, at most; a longer text is a chunk of its own. Buckets that chunks are dealt to, at most.
PART, ROWS, BUCKETS = 8 << 20, 1 << 16, 50_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        found = [np.unique(word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True) for i, j in chunks(offsets)]
        if found:
            u, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])


def _ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place in the sorted vocabulary, or its size for other words."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, len(vocabulary))


def _bigrams(ids: np.ndarray, first: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that follow another vocabulary word of their row, being in the vocabulary too, and the pairs' slots."""
    follows = np.ones(len(ids), bool)
    follows[first[:-1][first[:-1] < len(ids)]] = False
    at = np.flatnonzero(follows)
    at = at[(ids[at] < size) & (ids[at - 1] < size)]
    return at, (mix(ids[at - 1].astype(U) * U(1 << 32) + ids[at].astype(U)) >> U(64 - bits)).astype(np.int64)


def _pair_counts(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Unigrams (negative keys) and bigram slots of a partition's texts: of target texts, and of all."""
    size = len(vocabulary)
    one, two = np.zeros((2, size + 1), np.int64), np.zeros((2, 1 << bits), np.int64)
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for i, j in chunks(offsets):
            h, first = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = _ids(h, vocabulary)
            mine = np.repeat(good[i:j], np.diff(first))
            at, slot = _bigrams(ids, first, size, bits)
            for k, (a, b) in enumerate(((ids[mine], slot[mine[at]]), (ids, slot))):
                one[k] += np.bincount(a, minlength=size + 1)
                two[k] += np.bincount(b, minlength=1 << bits)
    for counts, key in ((one, lambda at: -1 - at), (two, lambda at: at)):
        at = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(key(at)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["key", "target", "every"])


@dataclass
class Model:
    """Counts by vocabulary place and by slot: rows are target and background, the latter scaled to the target's words."""

    vocabulary: np.ndarray
    one: np.ndarray
    two: np.ndarray
    bits: int
    bigram: float

    def losses(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits of each word under both models."""
        ids = _ids(h, self.vocabulary)
        at, slot = _bigrams(ids, first, len(self.vocabulary), self.bits)
        single = (self.one + 1) / (self.one.sum(1, keepdims=True) + self.one.shape[1])
        p = single[:, ids]
        before = self.one[:, ids[at - 1]]
        p[:, at] = self.bigram * np.minimum(self.two[:, slot], before) / np.maximum(before, 1e-9) + (1 - self.bigram) * p[:, at]
        return -np.log2(p)


def _targets(labels: DataFrame) -> DataFrame:
    """doc_id of the target texts: quality 1, not toxic; the larger labels where an id has several."""
    good = (F.coalesce(F.max("quality"), F.lit(0)) * (1 - F.coalesce(F.max("toxic"), F.lit(0)))).alias("q")
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(good).filter("q = 1").select("doc_id", F.lit(True).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, vocabulary: int, bits: int = BITS, bigram: float = BIGRAM) -> Model:
    """Both models of bounded size from all docs (doc_id, text); labels (doc_id, quality, toxic) tell the target texts: quality 1, not toxic."""
    texts = keyed(docs)
    counted = texts.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.col("n").desc(), "word").limit(vocabulary).toArrow()
    words = np.sort(top.column("word").to_numpy().view(U))
    marked = texts.join(_targets(labels), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    pairs = marked.mapInArrow(functools.partial(_pair_counts, vocabulary=words, bits=bits), "key long, target long, every long")
    pairs = _store.save(pairs.groupBy("key").agg(F.sum("target").alias("target"), F.sum("every").alias("every")), "counts").toArrow()
    key = pairs.column("key").to_numpy()
    one, two = np.zeros((2, len(words) + 1)), np.zeros((2, 1 << bits))
    for k, name in enumerate(("target", "every")):
        n = pairs.column(name).to_numpy()
        one[k, -1 - key[key < 0]] = n[key < 0]
        two[k, key[key >= 0]] = n[key >= 0]
    total = one.sum(1)
    scale = total[0] / total[1] if total[0] and total[1] else 0.0
    one[1] *= scale
    two[1] *= scale
    if not scale:
        one[:] = two[:] = 0
    return Model(words, one.astype(np.float32), two.astype(np.float32), bits, bigram)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            h, first = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(first)
            row = np.repeat(np.arange(j - i), n)
            bits = model.losses(h, first)
            target, every = (np.bincount(row, b, j - i) / np.maximum(n, 1) for b in bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(target), pa.array(every), pa.array(target - every)], names=["doc_id", "n_tokens", "ce_target", "ce_background", "score"])


def _dealt(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """One row a chunk: about part bytes of consecutive texts, compressed, with their ids."""
    held, size, rows, chunk = [], 0, 0, TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.select(["text"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.select(["text"]))
        ids = table.column("doc_id").combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "ids", "body"])

    for batch in batches:
        _, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets, part):
            for a in range(i, j, ROWS):
                b = min(a + ROWS, j)
                if held and (size + offsets[b] - offsets[a] > part or rows + b - a > ROWS):
                    yield row()
                    held, size, rows, chunk = [], 0, 0, chunk + 1
                held.append(batch.slice(a, b - a))
                size, rows = size + offsets[b] - offsets[a], rows + b - a
    if held:
        yield row()


def _keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that follow another word of their row, and the keys of these bigrams."""
    follows = np.ones(len(h), bool)
    follows[first[:-1][first[:-1] < len(h)]] = False
    at = np.flatnonzero(follows)
    return at, mix(h[at - 1] * U(0x9E3779B97F4A7C15) + h[at]) | U(1)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, which are even (those of bigrams are odd), and the index of each row's first word."""
    h, first = word_hashes(raw, offsets)
    return h & ~U(1), first


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts in target texts and in all."""
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    return key[start], np.add.reduceat(np.concatenate([n for _, n in parts], 1)[:, order], start, 1) if len(key) else np.zeros((2, 0), np.int64)


def _texts(body: pa.Scalar) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a chunk in parts: the place of the first, their bytes and offsets."""
    column = pa.ipc.open_stream(body.as_buffer()).read_all().column("text")
    raw, offsets = buffers(column)
    for i, j in chunks(offsets):
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _counted(body: pa.Scalar, good: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Every word and bigram of a chunk, in order, with its counts there: in the texts at the places good, and in all."""
    parts = [(np.zeros(0, U), np.zeros((2, 0), np.int64))]
    for at, raw, offsets in _texts(body):
        h, first = _words(raw, offsets)
        mine = np.zeros(len(offsets) - 1, np.int64)
        if good is not None:
            mine[good[(good >= at) & (good < at + len(mine))] - at] = 1
        mine = np.repeat(mine, np.diff(first))
        follow, two = _keys(h, first)
        h, mine = np.concatenate([h, two]), np.concatenate([mine, mine[follow]])
        parts.append(_summed([(h, np.stack([mine, np.ones(len(h), np.int64)]))]))
    return _summed(parts)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of their numbers, which leaves runs of zeros, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n * columns, codec="zstd"), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of each bucket's range in keys in order."""
    step = (1 << 64) // buckets + 1
    return np.r_[0, np.searchsorted(key, np.array([k * step for k in range(1, buckets)], U)), len(key)]


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """What each chunk holds, as differences of keys in order, by ranges of keys."""
    for batch in batches:
        for chunk, body, good in zip(batch.column("chunk").to_pylist(), batch.column("body"), batch.column("good")):
            key, n = _counted(body, good.values.to_numpy() if good.is_valid else None)
            bounds = _bucket(key, buckets)
            some = np.flatnonzero(np.diff(bounds))
            data = [_pack(np.diff(key[bounds[b] : bounds[b + 1]], prepend=U(0)), n[0, bounds[b] : bounds[b + 1]], n[1, bounds[b] : bounds[b + 1]]) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])


def _merged(asked: pa.Table) -> pa.Table:
    """For each chunk the corpus counts of what it asked for, in its order; and a row of chunk -1 with words in target texts, in all, and different ones."""
    parts = [_unpack(d, 3) for d in asked.column("data").to_pylist()]
    key = np.concatenate([np.cumsum(p[0].view(U), dtype=U) for p in parts])
    u, at = np.unique(key, return_inverse=True)
    n = [np.bincount(at, np.concatenate([p[k] for p in parts]), len(u)).astype(np.int64) for k in (1, 2)]
    ends = np.cumsum([len(p[0]) for p in parts])
    data = [_pack(n[0][own], n[1][own]) for own in np.split(at, ends[:-1])]
    word = u & U(1) == 0
    total = np.array([n[0][word].sum(), n[1][word].sum(), word.sum()], np.int64)
    return pa.table([pa.array([*asked.column("chunk").to_pylist(), -1], pa.int64()), pa.array([*asked.column("bucket").to_pylist(), 0], pa.int64()), pa.array([*data, total.tobytes()], pa.binary())], names=["chunk", "bucket", "data"])


def _answered(counts: pa.Table, texts: pa.Table, total: tuple[int, int, int], bigram: float) -> pa.Table:
    """Scores of a chunk's texts, from the corpus counts of its words and bigrams."""
    body, ids = texts.column("body")[0], texts.column("ids")[0].values
    key, _ = _counted(body, None)
    n = [_unpack(d, 2) for d in counts.sort_by("bucket").column("data").to_pylist()]
    n = np.concatenate([np.stack(c) for c in n], 1) if n else np.zeros((2, 0))
    if n.shape[1] != len(key):
        raise ValueError(f"{n.shape[1]} answers to {len(key)} keys")
    # The background's counts are scaled to the target's words; without target texts both models are uniform.
    n = n * np.array([1.0, total[0] / max(1, total[1])])[:, None]
    out = []
    for place, raw, offsets in _texts(body):
        h, first = _words(raw, offsets)
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        own = n[:, np.searchsorted(key, h)]
        at, two = _keys(h, first)
        p, before = (own + 1) / (total[0] + total[2] + 1), own[:, at - 1]
        p[:, at] = bigram * n[:, np.searchsorted(key, two)] / np.maximum(before, 1e-9) + (1 - bigram) * p[:, at]
        target, every = (np.bincount(row, b, len(size)) / np.maximum(size, 1) for b in -np.log2(p))
        out.append(pa.table([ids.slice(place, len(size)), pa.array(size.astype(np.int64)), pa.array(target), pa.array(every), pa.array(target - every)], names=["doc_id", "n_tokens", "ce_target", "ce_background", "score"]))
    return pa.concat_tables(out)


def exact(docs: DataFrame, labels: DataFrame, bigram: float = BIGRAM, part: int = PART) -> DataFrame:
    """lm_score() by the counts of all words and bigrams."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    buckets = 1 + docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // part
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(functools.partial(_dealt, part=part), f"chunk long, ids array<{kind}>, body binary")
    table = _store.bucketed(dealt, "chunk", min(buckets, BUCKETS), "texts")
    try:
        texts = spark.table(table)
        marks = texts.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(_targets(labels), "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("good"))
        asked = texts.hint("merge").join(marks, "chunk", "left").select("chunk", "body", "good")
        shape = "chunk long, bucket long, data binary"
        counts = _store.save(asked.mapInArrow(functools.partial(_asked, buckets=buckets), shape).groupBy("bucket").applyInArrow(_merged, shape), "counts")
        total = np.sum([np.frombuffer(r.data, np.int64) for r in counts.filter("chunk = -1").select("data").toLocalIterator()] or [np.zeros(3, np.int64)], 0)
        total = tuple(int(x) for x in total)
        answers = counts.filter("chunk >= 0").groupBy("chunk").cogroup(texts.groupBy("chunk"))
        shape = f"doc_id {kind}, n_tokens long, ce_target double, ce_background double, score double"
        return _store.save(answers.applyInArrow(lambda n, t: _answered(n, t, total, bigram), shape), "scores")
    finally:
        _store.drop(spark, table)


def lm_score(docs: DataFrame, labels: DataFrame, vocabulary: int | None = None, **options) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ce_target, ce_background, score (their difference, bits a word).

    Words are separated by ASCII white space and unchanged. A null, empty or
    blank text has no words and scores 0; without target texts both models are
    uniform and every score is 0. Repeated rows score alike and count each; a
    doc_id that is labelled twice has the larger labels. An empty table gives an
    empty result; other columns are ignored.
    """
    if vocabulary is None:
        return exact(docs, labels, **options)
    model = fit(docs, labels, vocabulary, **options)
    return keyed(docs).select("doc_id", "text").mapInArrow(functools.partial(_scored, model=model), "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
