"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (the first bytes of words),
found in a bounded sample of labelled rows next to a seed lexicon. The voters
that fire are listed for every document of the corpus; a label, where a row has
one, is one more voter. A generative model explains the lists by a hidden label:
each voter has a rate of its own for either label, estimated by EM over all
documents, and voters that fire together more often than the label explains are
correlated, and where they fire on one text, each adds so much less. Voters that
do not fire abstain; that none fires is evidence with rates of its own. The model gives posterior labels
to documents with and without a known one, and a linear classifier on hashed
words and word beginnings is trained on these posteriors. It scores every whole
text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._spans import keyed
from ._text import U, buffers, chunks, expand, mix, prefix, runs, words

#: Labelled rows that voters and classifier are fitted on, at most (the first by hash), and unlabelled ones that the classifier is fitted on, about.
MAX_LABELLED, UNLABELLED = 12_000, 12_000
#: Voters and weights of the model, at most; rows that a word or a pair of voters must have; rounds of EM.
VOTERS, KEEP, SUPPORT, ROUNDS, THRESHOLD = 2048, 4096, 5, 3, 0.7
#: Pairs of voters that are held at once.
PAIRS = 1 << 18
SEED = ("idiot", "moron", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "loser", "clown")
BEGINNINGS = (4, 5)
#: Bytes that separate words here: ASCII that is no letter.
BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[65:91] = BREAK[97:123] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows and of their first bytes, and the row of each."""
    low = FOLD[raw]
    starts, ends, first = words(low, offsets, BREAK)
    p = prefix(low)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, rows = [runs(p, starts, ends)], [row]
    for n in BEGINNINGS:
        long = ends - starts > n
        found.append(mix(runs(p, starts[long], starts[long] + n) + U(n)))
        rows.append(row[long])
    return np.concatenate(found), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], row[new]


def seeds() -> np.ndarray:
    raw = np.frombuffer("".join(SEED).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in SEED])
    return runs(prefix(raw), np.r_[0, ends[:-1]], ends)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of either label that have a feature, summed over each batch."""
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for i, j in chunks(offsets):
            h, row = _distinct(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            u, at = np.unique(h, return_inverse=True)
            pos = np.bincount(at, toxic[i:j][row], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(u)) - pos)], names=["h", "pos", "neg"])


def _fired(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The voters (places in keys, which are in order) that fire on each row, beside its other columns."""
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        for i, j in chunks(offsets):
            h, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            v, row = _distinct(at[hit].astype(U), row[hit])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), pa.array(v.astype(np.int32)))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), lists], names=[*rest, "voters"])


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many rows of either label (known) each pair of voters (and each voter, as a pair with itself) has."""
    for batch in batches:
        codes, held, known = [], 0, batch.column("known").to_numpy()
        for k, (label, voters) in enumerate(zip(known, batch.column("voters"))):
            v = voters.values.to_numpy().astype(np.int64)
            codes.append(np.add.outer((label * size + v) * size, v).ravel())
            held += len(v) ** 2
            if held > PAIRS or k + 1 == batch.num_rows:
                pair, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                codes, held = [], 0


@dataclass
class LabelModel:
    """Rates at which each voter fires in either label (rows: 0, 1), and no voter does; the share of label 1; correlations of voters within a label; rates at which a known label is 1."""

    rate: np.ndarray
    silent: np.ndarray
    prior: float
    related: np.ndarray
    told: np.ndarray

    def posterior(self, voters: np.ndarray, row: np.ndarray, rows: int, known: np.ndarray) -> np.ndarray:
        """Of label 1, for rows whose voters (with the row of each, in order) are given, and known labels (-1: none)."""
        count = np.bincount(row, minlength=rows)
        first, cost = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * count)]
        less, i = np.ones(len(voters)), 0
        while i < rows:  # all voters of a voter's row, for rows of about PAIRS pairs at a time
            j = max(i + 1, int(np.searchsorted(cost, cost[i] + PAIRS, "right")) - 1)
            at = np.arange(first[i], first[j])
            other, own = expand(first[row[at]], count[row[at]])
            less[at] += np.bincount(own, self.related[voters[at[own]], voters[other]], len(at))
            i = j
        votes = np.bincount(row, np.log(self.rate[1] / self.rate[0])[voters] / less, rows)
        none = np.bincount(row, minlength=rows) == 0
        z = np.log(self.prior / (1 - self.prior)) + np.where(none, np.log(self.silent[1] / self.silent[0]), votes)
        label = [np.log((1 - self.told[1]) / (1 - self.told[0])), np.log(self.told[1] / self.told[0]), 0.0]
        z += np.array(label)[known]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("voters")
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)


def _expected(batches: Iterator[pa.RecordBatch], model: LabelModel | None, size: int, anchored: bool) -> Iterator[pa.RecordBatch]:
    """E-step: rows of either label that each voter has (places size to size + 3: no voter; all; known; known as 1), by the model, or at first by the known labels alone (anchored) or a guess."""
    sums = np.zeros((2, size + 4))
    for batch in batches:
        n, known = batch.column("n").to_numpy(), batch.column("known").to_numpy()
        v, row = _lists(batch)
        none = np.bincount(row, minlength=len(n)) == 0
        q = model.posterior(v, row, len(n), known) if model else np.where(known >= 0, known, np.where(none, 0.05, 0.8))
        n = np.where(known >= 0, n, 0) if anchored and not model else n
        for k, mass in enumerate(((1 - q) * n, q * n)):
            sums[k, :size] += np.bincount(v, mass[row], size)
            sums[k, size:] += mass[none].sum(), mass.sum(), mass[known >= 0].sum(), mass[known == 1].sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 4)), pa.array(sums[0]), pa.array(sums[1])], names=["place", "clean", "toxic"])


def correlations(pair: np.ndarray, n: np.ndarray, rows: tuple[int, int], size: int, least: int = SUPPORT) -> np.ndarray:
    """Correlations of voters within a label, the larger of both labels', from _together() and the rows of either label; 0 for voters that least rows don't share, and under 0.1."""
    label, a, b = pair // size // size, pair // size % size, pair % size
    own = np.zeros((2, size))
    own[label[a == b], a[a == b]] = n[a == b]
    out = np.zeros((size, size), np.float32)
    for k in range(2):
        if rows[k]:
            rate = own[k] / rows[k]
            some = (label == k) & (a != b) & (n >= least)
            x, y = a[some], b[some]
            spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
            c = np.clip((n[some] / rows[k] - rate[x] * rate[y]) / (spread[x] * spread[y]), 0, 1)
            out[x, y] = np.maximum(out[x, y], np.where(c >= 0.1, c, 0))
    return out


def label_model(votes: DataFrame, size: int, related: np.ndarray, anchored: bool = True, rounds: int = ROUNDS) -> LabelModel:
    """EM over votes (voters array<int>, known, n): the driver gets the sums of each voter in each round.

    Rates start from the rows with a known label, if there are enough
    (anchored); few rounds follow, since many rounds over mostly unlabelled rows
    would drift from what labels say to whatever voters have in common.
    """
    model = None
    for _ in range(rounds if anchored else 2 * rounds):
        step = votes.mapInArrow(functools.partial(_expected, model=model, size=size, anchored=anchored), "place long, clean double, toxic double")
        got = step.groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).orderBy("place").collect()
        sums = np.array([[r.clean for r in got], [r.toxic for r in got]])
        none, every, known, ones = sums[:, size:].T
        rate = (sums[:, :size] + np.array([[0.05], [0.5]])) / (every[:, None] + 1)
        told = np.clip((ones + np.array([0.0, 1.0])) / (known + 1), [0.005, 0.9], [0.1, 0.995])
        model = LabelModel(rate, (none + 0.5) / (every + 1), float(np.clip(every[1] / max(every.sum(), 1e-9), 1e-4, 0.5)), related, told)
    return model


def _labelled(batches: Iterator[pa.RecordBatch], model: LabelModel) -> Iterator[pa.RecordBatch]:
    """Rows with the posterior of their votes."""
    for batch in batches:
        v, row = _lists(batch)
        q = model.posterior(v, row, batch.num_rows, batch.column("known").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("body")], names=["target", "text"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have a feature, and the sum of their targets."""
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        target = batch.column("target").to_numpy()
        for i, j in chunks(offsets):
            h, row = _distinct(*features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            u, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, target[i:j][row], len(u))), pa.array(np.bincount(at, minlength=len(u)))], names=["h", "pos", "n"])


def _train(batches: Iterator[pa.RecordBatch], size: int, steps: int = 500, rate: float = 0.5, decay: float = 1e-4) -> Iterator[pa.RecordBatch]:
    """Logistic regression of targets on lists of features (places up to size), by AdaGrad over all rows at once; place -1 is the bias."""
    y, col, row, base = [], [], [], 0
    for batch in batches:
        v, r = _lists(batch)
        y.append(batch.column("target").to_numpy())
        col.append(v)
        row.append(r + base)
        base += batch.num_rows
    if not base:
        return
    y, col, row = map(np.concatenate, (y, col, row))
    w, b = np.zeros(size), 0.0
    g2, gb2 = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -30, 30)))
        e = p - y
        g, gb = np.bincount(col, e[row], size) / len(y) + decay * w, e.mean()
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= rate * gb / np.sqrt(gb2)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.r_[b, w])], names=["place", "weight"])


@dataclass
class Model:
    """Weights of hashed features, in order of hash; table tells by 20 bits which hashes may be among them."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.table = np.zeros(1 << 20, bool)
        self.table[self.keys >> U(44)] = True


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        rest = [k for k in batch.schema.names if k != "text"]
        for i, j in chunks(offsets):
            h, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = model.table[h >> U(44)]
            h, row = h[some], row[some]
            z = np.full(j - i, model.bias)
            if len(model.keys):
                at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
                hit = model.keys[at] == h
                at, row = _distinct(at[hit].astype(U), row[hit])
                z += np.bincount(row, model.weights[at], j - i)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in rest), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*rest, "score"])


def find_voters(sample: DataFrame, total) -> np.ndarray:
    """Hashes, in order, of the seed lexicon and of words and beginnings that labelled rows (toxic, text) tell by."""
    keys = np.unique(seeds())
    if not total.pos:
        return keys
    odds = sample.mapInArrow(_counts, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    expected = (F.col("pos") + F.col("neg")) * F.lit(total.pos / total.n)
    sure = F.col("pos") * F.ln(F.col("pos") / expected) - F.col("pos") + expected  # a word that tells nothing reaches this by chance with exp(-it)
    odds = odds.filter((F.col("pos") >= SUPPORT) & (F.col("pos") > 9 * F.col("neg"))).filter(sure > 9)
    best = odds.orderBy(F.col("pos").desc(), "neg", "h").limit(VOTERS).select("h").collect()
    return np.unique(np.r_[keys, np.array([r.h for r in best], np.int64).view(U)])


def posteriors(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """The classifier's training rows (target, text): up to max_labelled labelled ones and about ``unlabelled`` others, none held out, with the label model's posteriors.

    Voters and their correlations come from the labelled rows, rates from the
    votes on all documents. A row's own label is a voter among others.
    """
    texts = keyed(docs)
    open_ = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = _store.save(open_.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    sample = _store.save(texts.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("long").alias("toxic"), "text"), "sample")
    total = sample.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    keys = find_voters(sample, total)
    fired = functools.partial(_fired, keys=keys)

    pairs = sample.select(F.col("toxic").alias("known"), "text").mapInArrow(fired, "known long, voters array<int>").filter(F.size("voters") > 0)
    pairs = pairs.mapInArrow(functools.partial(_together, size=len(keys)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT).collect()
    pair, n = (np.array([r[k] for r in pairs], np.int64) for k in ("pair", "n"))
    related = correlations(pair, n, (total.n - (total.pos or 0), total.pos or 0), len(keys))

    # A random share of the other rows trains the classifier; equal ones among them count once.
    rows = docs.count()
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, unlabelled / max(1, rows))) if rows > unlabelled else (1 << 63) - 1
    drawn = (F.col("k1") <= bound) & ~held_out(F.col("doc_id"))
    known = texts.join(F.broadcast(chosen.select("doc_id", F.col("toxic").cast("long").alias("known"))), "doc_id", "left")
    known = known.select("k1", "k2", F.coalesce("known", F.lit(-1).cast("long")).alias("known"), "text", drawn.alias("drawn"))
    votes = known.select("known", "text").mapInArrow(fired, "known long, voters array<int>").groupBy("voters", "known").agg(F.count("*").alias("n"))
    model = label_model(_store.save(votes, "votes"), len(keys), related, min(total.pos or 0, total.n - (total.pos or 0)) >= 50)

    train = known.filter("known < 0 and drawn").dropDuplicates(["k1", "k2"]).select("known", "text").union(sample.select(F.col("toxic").alias("known"), "text"))
    train = train.select("known", F.col("text").alias("body"), "text").mapInArrow(fired, "known long, body string, voters array<int>")
    return train.mapInArrow(functools.partial(_labelled, model=model), "target double, text string")


def train(rows: DataFrame, keep: int = KEEP) -> Model:
    """The linear classifier of rows (target, text), on the hashed words and beginnings that tell most; texts stay where they are, only lists of these meet in one task."""
    rows = _store.save(rows, "training")
    total = rows.agg(F.coalesce(F.avg("target"), F.lit(0.0)).alias("mean"), F.count("*").alias("n")).first()
    if not total.n:
        return Model(np.zeros(0, U), np.zeros(0), 0.0)
    mean = float(np.clip(total["mean"], 1e-6, 1 - 1e-6))
    told = rows.mapInArrow(_told, "h long, pos double, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT)
    tell = F.round(F.abs(F.col("pos") - mean * F.col("n")) / F.sqrt(F.col("n") * mean * (1 - mean)), 9)
    best = told.select("h", tell.alias("tell")).filter("tell > 5").orderBy(F.col("tell").desc(), "h").limit(keep).select("h").collect()
    keys = np.sort(np.array([r.h for r in best], np.int64).view(U))
    lists = rows.mapInArrow(functools.partial(_fired, keys=keys if len(keys) else np.zeros(1, U)), "target double, voters array<int>")
    weights = lists.orderBy("target", "voters").coalesce(1).mapInArrow(functools.partial(_train, size=max(1, len(keys))), "place long, weight double").collect()
    by = {r.place: r.weight for r in weights}
    return Model(keys, np.array([by[k] for k in range(len(keys))]), by[-1])


def fit(docs: DataFrame, labels: DataFrame, keep: int = KEEP, **options) -> Model:
    """Voters, label model and classifier from docs (doc_id, text) and labels (doc_id, toxic), without held-out rows; options are those of posteriors()."""
    return train(posteriors(docs, labels, **options), keep)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row of docs, from its text alone; row has all columns. A null text is empty and gets the score of no words."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(functools.partial(_scored, model=model), f"row {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Labels are used only where crc32(doc_id as text) mod 3 is not 1; held_out is
    the rest. A null doc_id is not held out and has no label; a doc_id that is
    labelled twice is toxic if either says so. Without toxic labels the seed
    lexicon votes alone. Null and empty texts, repeated rows and empty tables
    are scored like any other; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay as they are, whatever their names, and an empty table stays empty."""
    return score(docs, fit(docs, labels, **options)).filter(F.col("score") < threshold).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
