import logging
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.llm import _spans, _store
from wavefold.llm._spans import sifted
from wavefold.llm.embedding_dedup import audited_recall, embedding_dedup
from wavefold.llm.jaccard_join import Audit, jaccard_join, one_of_each, shingles as shingle_hashes

from .helpers import corpus, empty, frame, prose


def linked(items, alike):
    """Per item: number of links, and the smallest id reachable."""
    n, root = [0] * len(items), list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if alike(items[a][1], items[b][1]):
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(items):
        low[find(k)] = min((x for x in (low.get(find(k)), i) if x is not None), default=None)
    return [(i, n[k], low[find(k)]) for k, (i, _) in enumerate(items)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("options", [{}, {"small": 3}, {"small": 1, "depth": 2}])
def test_jaccard(spark, options):
    rows = corpus(3) + [(None, corpus(3)[5][1]), (None, None), (600, corpus(3)[66][1] + " more"), (309, "twice and " + corpus(3)[60][1])] * 2
    rng = random.Random(5)
    base = prose(rng, 60).split()
    for k in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{k}"
        rows.append((400 + k, " ".join(w)))
    want = linked([(i, shingles(t)) for i, t in rows], lambda a, b: bool(a and b) and len(a & b) * 5 >= 4 * len(a | b))
    got = jaccard_join(frame(spark, rows), **options).collect()
    assert Counter(want) == Counter((r.doc_id, r.n_links, r.component_id) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_copies(seed=5, pairs=150):
    """Pairs of texts a little over the threshold, and groups of near copies."""
    rng = random.Random(seed)
    rows = []
    for k in range(pairs):
        w = prose(rng, 60).split()
        rows.append((2 * k, " ".join(w)))
        w[rng.randrange(60)] = f"x{k}"
        rows.append((2 * k + 1, " ".join(w)))
    return rows


def test_jaccard_audits_recall_and_repeats_runs(spark, caplog):
    rows = near_copies()
    want = Counter((i, 1, i - i % 2) for i, _ in rows)
    with caplog.at_level(logging.INFO, logger="wavefold.llm.jaccard_join"):
        got = jaccard_join(frame(spark, rows), run_count=0.5, attempts=6, recall=0.999)
        assert Counter((r.doc_id, r.n_links, r.component_id) for r in got.collect()) == want
    seen = [r.args for r in caplog.records]
    assert len(seen) > 1 and seen[0][2] < 0.9 and seen[-1][2] == 1  # the first attempt failed the audit
    with pytest.raises(RuntimeError, match="recall"):
        jaccard_join(frame(spark, rows), run_count=0.5, attempts=1)


def test_audit_counts_links_with_other_texts():
    audit = Audit(["a b c d e f g", "p q r s t u v"], 5, 0.8)
    h, first, node = shingle_hashes(np.frombuffer(b"a b c d e f gp q r s t u v wx y", np.uint8), np.array([0, 13, 28, 31]), 5)
    size = np.diff(first)
    assert audit.near(h, np.repeat(np.arange(3), size), size).to_pylist() == [[0], [], []] and node.view(np.int64)[0] == audit.nodes[0]
    a, b = audit.nodes.tolist()
    assert audit.recall({0: 5, 1: 4}, {a: (4, 3), b: (3, 2)}) == (1 + 1) / 2 and audit.recall({0: 5, 1: 4}, {a: (2, 3), b: (2, 2)}) == (0 + 0.5) / 2
    assert audit.recall({0: 3}, {a: (2, 3)}) is None and Audit([], 5, 0.8).recall({}, {}) is None


def test_one_of_each(spark):
    docs = frame(spark, corpus()).withColumn("_kept", F.lit(3)).withColumn("row", F.lit("r"))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and {(r.k1, r.node, r._kept, r.row) for r in kept.collect()} == {("x", 1, 3, "r")}
    ids = [r.doc_id for r in kept.collect()]
    assert {304, 305, 306} <= set(ids) and ids.count(309) == 1 and 300 not in ids and 201 not in ids and 200 in ids and 311 not in ids
    assert one_of_each(empty(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3)) for i in range(300)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(90)]
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(20)] + [(3000, [3 * x for x in rows[7][1]], rows[7][2])]
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] + [1.0] * 15, 1), (4003, [None] + [1.0] * 15, 1), (4004, rows[7][1], None), (4005, [float("inf")] * 16, 1), (4006, [], 1), (4007, [1.0] * 8, 1), (4008, [1.0] * 8, 1)]
    rows += [rows[9]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def vector(e, label):
        x = np.array([np.nan if v is None else v for v in e or ()], np.float32).astype(float)
        return None if label is None or not len(x) or not np.isfinite(x).all() or not x.any() else (label, x / np.linalg.norm(x))

    want = linked([(i, vector(e, label)) for i, e, label in rows], lambda a, b: a is not None and b is not None and a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93)
    got = embedding_dedup(df, block=16, length=4, longest=8).collect()
    assert Counter(want) == Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_embedding_audit_weighs_queries_alike(spark):
    dense = [(5000, 5000, True)] * 80
    assert audited_recall(dense + [(1, 0, False)] * 30) == 0
    assert audited_recall(dense * 9 + [(1, 1, False)] * 30 + [(1, 0, False)]) < 0.99
    assert audited_recall(dense + [(2, 2, False)] * 30 + [(0, 0, False)] * 90) == 1 and audited_recall([(0, 0, False)]) is None
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 16))
    rows = [(2 * i + k, (v + k * 0.08 * rng.standard_normal(16)).tolist(), 1) for i, v in enumerate(x) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup(df, tables=1, block=2, rounds=0, attempts=1)


def test_embedding_attempts_go_on_until_the_audit_holds(spark, caplog):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 24))
    rows = [(2 * i + k, (v + k * 0.08 * rng.standard_normal(24)).tolist(), 1) for i, v in enumerate(x) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with caplog.at_level(logging.INFO, logger="wavefold.llm.embedding_dedup"):
        got = embedding_dedup(df, tables=1, block=4, rounds=0, attempts=40)
        assert all(r.n_links == 1 and r.component_id == r.vec_id - r.vec_id % 2 for r in got.collect())
    seen = [r.args for r in caplog.records]
    assert len(seen) > 1 and min(seen[0][1].values()) < 0.99 <= min(seen[-1][1].values()) and seen[0][2] >= 200


def test_sifted_keeps_every_held_key(spark, monkeypatch):
    rows = spark.range(20000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), "id")
    keys = _store.save(rows.filter("id % 10 = 0").select("k1", "k2"), "some")
    found = sifted(rows, keys)
    assert found.count() == 20000 and found.filter("maybe and id % 10 = 0").count() == 2000 and found.filter("maybe").count() < 2000 + 0.1 * 18000
    assert sifted(rows, keys.limit(0)).filter("maybe").count() == 0
    monkeypatch.setattr(_spans, "SIEVE", 4)  # too small a filter only lets more rows pass
    assert sifted(rows, keys).filter("maybe and id % 10 = 0").count() == 2000


def test_texts_of_single_documents_are_not_shuffled(spark):
    """Only near copies travel with their texts, though every join is too large to be broadcast."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(2000))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(4)] + [(2000, rows[7][1]), (2001, rows[8][1]), (2001, rows[8][1])]
    docs = _store.save(frame(spark, rows), "documents")
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before, threshold = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = one_of_each(docs, audit=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.doc_id for r in kept) == list(range(200))
    moved = sum(n for k, n in stages().items() if k not in before)
    assert 0 < moved < 0.6 * sum(len(t) for _, t in rows)
