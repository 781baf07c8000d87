import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from wavefold.llm import _spans
from wavefold.llm._text import grams, prefix, runs
from wavefold.llm.substring_dedup import ReferenceBlock, factor, repeated_windows, substring_dedup
from wavefold.llm.suffix_dedup import IndexFamily, suffix_dedup

from .helpers import corpus, empty, frame


def covered(rows, window, join):
    seen = Counter(tuple(s[k : k + window]) for s in rows for k in range(len(s) - window + 1))
    out = []
    for s in rows:
        m = [0] * len(s)
        for k in range(len(s) - window + 1):
            if seen[tuple(s[k : k + window])] > 1:
                m[k : k + window] = [1] * window
        kept = join([c for c, f in zip(s, m) if not f])
        out.append((len(s), sum(m), len(re.findall("1+", "".join(map(str, m)))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "wide", "batches"), [(40, 8, 128, 3), (40, 8, 1, 1), (200, 32, 2, 4)])
def test_bytes(spark, window, gram, wide, batches):
    rows = corpus()
    want = covered([(t or "").encode() for _, t in rows], window, bytes)
    got = suffix_dedup(frame(spark, rows), window, gram, batches, wide).collect()
    assert Counter((i, *w) for (i, _), w in zip(rows, want)) == Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


@pytest.mark.parametrize(("window", "gram", "wide"), [(12, 4, 128), (12, 4, 1), (35, 8, 2)])
def test_words(spark, window, gram, wide):
    rows = corpus(2)
    want = covered([re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows], window, lambda w: " ".join(w).encode())
    got = substring_dedup(frame(spark, rows), window, gram, wide, keep_text=True).collect()
    assert Counter((i, *w) for (i, _), w in zip(rows, want)) == Counter((r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert suffix_dedup(empty(spark)).count() == 0
    assert substring_dedup(empty(spark)).count() == 0


def test_levels_merge_geometrically_and_scan_each_batch(spark):
    docs = _spans.keyed(frame(spark, corpus()))
    every = _spans.anchors(docs, "byte", 40, 8).cache()
    counts = {r.ah: r for r in _spans.summary(every).collect()}
    with IndexFamily(spark, 40, 8, 2) as family:
        for n in range(1, 6):
            family.insert(every)
            assert [t is not None for t in family.levels] == [bool(n >> k & 1) for k in range(n.bit_length())]
            # From the second batch on, every suffix matches those of the levels.
            assert {r.ah for r in family.found[-1].collect()} == (set(counts) if n > 1 else {a for a, r in counts.items() if r.n > 1})
        for table in filter(None, family.levels):
            rows = spark.table(table).collect()
            assert len(rows) == len(counts) and all(r.n % counts[r.ah].n == 0 and (r.s1, r.s2) == (counts[r.ah].s1, counts[r.ah].s2) for r in rows)
        got = {r.ah: r for r in family.matches().collect()}
        assert all(r.length == (counts[a].nw + 39 if r.s1 == r.s2 else 8) for a, r in got.items())
        tables = list(filter(None, family.levels))
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_runs_are_sorted_by_suffix(spark):
    docs = _spans.keyed(frame(spark, corpus()))
    with IndexFamily(spark, 40, 8, 1) as family:
        family.insert(_spans.anchors(docs, "byte", 40, 8))
        order = [r.ah for r in spark.table(family.levels[0]).collect()]
    assert order == sorted(order) and len(order) == len(set(order)) > 100


def test_batches_do_not_change_matches(spark):
    docs = _spans.keyed(frame(spark, corpus()))
    found = _spans.anchors(docs, "byte", 40, 8).withColumn("b", _spans.F.pmod("k2", _spans.F.lit(5))).cache()
    want = {(r.ah, r.s1, r.s2) for r in _spans.summary(found).filter("n > 1").collect()}
    with IndexFamily(spark, 40, 8, 2) as family:
        for k in range(5):
            family.insert(found.filter(f"b = {k}"))
        assert {(r.ah, r.s1, r.s2) for r in family.matches().collect()} == want


def plain_factors(phrases, group, r):
    """Greedy factors of phrase r against the others of its group, by trying every place."""
    out, i, own = [], 0, phrases[r]
    others = [p for k, p in enumerate(phrases) if k != r and group[k] == group[r]]
    while i < len(own):
        best = 0
        for p in others:
            for j in range(len(p)):
                n = 0
                while i + n < len(own) and j + n < len(p) and own[i + n] == p[j + n]:
                    n += 1
                best = max(best, n)
        out.append((i, best))
        i += max(best, 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_greedy(seed):
    rng = random.Random(seed)
    phrases = [[rng.randrange(2 + seed) for _ in range(rng.randint(0, 30))] for _ in range(14)] + [[0] * 20, [0] * 9, [1, 0] * 8]
    group = np.array([rng.randrange(3) for _ in phrases])
    symbols, first = np.array([x for p in phrases for x in p], np.uint64), np.r_[0, np.cumsum([len(p) for p in phrases])]
    block = ReferenceBlock(symbols, first, group)
    found = factor(block)
    for r, own in enumerate(phrases):
        at = np.flatnonzero(found.row == r)
        assert [(s - first[r], n) for s, n in zip(found.start[at], found.length[at])] == plain_factors(phrases, group, r)
    for r, s, n, o in zip(found.row, found.start, found.length, found.source):
        if n:
            other = block.row[o]
            assert other != r and group[other] == group[r] and o + n <= first[other + 1] and (symbols[s : s + n] == symbols[o : o + n]).all()
    for window in (2, 5):
        some = [p for p in phrases if len(p) >= window]
        own = np.array([g for p, g in zip(phrases, group) if len(p) >= window])
        symbols, first = np.array([x for p in some for x in p], np.uint64), np.r_[0, np.cumsum([len(p) for p in some])]
        got = repeated_windows(symbols, first, own, window)
        want = [any(k != r and own[k] == own[r] and any(q[j : j + window] == p[i : i + window] for j in range(len(q) - window + 1)) for k, q in enumerate(some)) for r, p in enumerate(some) for i in range(len(p) - window + 1)]
        assert got.tolist() == want and (got <= _spans.by_hash(symbols, first, own, window)).all()


def test_hashes_tell_thue_morse_words_apart():
    t = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8)
    raw = np.r_[97 + t, 98 - t, 97 + t].astype(np.uint8)
    h = runs(prefix(raw), np.arange(3) * 4096, np.arange(1, 4) * 4096)
    assert h[0] != h[1] and h[0] == h[2]
    wide = np.where(raw == 97, np.uint64(7 << 40), np.uint64(9 << 33))
    h = runs(prefix(wide), np.arange(3) * 4096, np.arange(1, 4) * 4096)
    assert h[0] != h[1] and h[0] == h[2] and (grams(prefix(wide), 4096)[[0, 4096, 8192]] == h).all()


def test_rows_without_id_keep_their_own_text(spark):
    """Two texts without an id whose 32-bit hashes agree, one of which occurs again."""
    seen, pair = {}, None
    texts = [f"{k:x} " + " ".join(f"w{k}x{j}" for j in range(40)) for k in range(120_000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", _spans.F.hash("t").alias("h")).collect():
        if r.h in seen:
            pair = (seen[r.h], r.t)
            break
        seen[r.h] = r.t
    assert pair
    docs = frame(spark, [(None, pair[0]), (None, pair[1]), (1, pair[0])])
    got = substring_dedup(docs, keep_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got) == [(0, 0, pair[1]), (0, 41, ""), (1, 41, "")]
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in suffix_dedup(docs).collect()) == [(0, False), (0, True), (1, True)]
