"""corpus_pipeline.run end to end, and each of its stages against brute force on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from wavefold.llm import _store, pii, toxicity

from .helpers import DOCS, frame, prose
from .test_near import linked, shingles
from .test_text_models import items, toxic_corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = toxic_corpus()
    rows = [(i, t) for i, t in rows if i < 400]
    base = prose(rng, 80).split()
    passage = prose(rng, 30)
    for k in range(12):
        w = list(base)
        w[rng.randrange(80)] = f"edit{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(1100, rows[1][1]), (1101, rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), (None, None), (1102, None), (1103, ""), (1104, " \n ")]
    rows += [(1200 + k, prose(rng, 40) + " " + passage) for k in range(3)] + [(1210, prose(rng, 900) + " " + " ".join(passage.split()[:14]))]
    rows += [(1300, prose(rng, 30) + " write a.b@mail.example.com or +1 (555) 555-0134"), (1301, prose(rng, 30) + " 4111 1111 1111 1111 10.0.0.1"), (1302, prose(rng, 4000))]
    folder = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def one_each(rows):
    groups = {}
    for (i, t), (_, _, low) in zip(rows, linked([(i, shingles(t)) for i, t in rows], lambda a, b: bool(a and b) and len(a & b) * 5 >= 4 * len(a | b))):
        groups.setdefault((low, t if low is None or not shingles(t) else None), []).append((i, t))
    return Counter((i, t) for own in groups.values() for i, t in [min(own, key=lambda x: (x[0] is None, x[0] or 0))])


def contaminated(text, windows, size=13):
    w = items([(0, text)])[0]
    hit = set()
    for k in range(len(w) - size + 1):
        if tuple(w[k : k + size]) in windows:
            hit |= set(range(k, k + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def redacted(text, spans):
    marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = "", 0
    for s, e, k in marks:
        if s >= at:
            out += text[at:s] + f"[{k.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_every_stage_does_its_job(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, _store.save(stage(spark, docs, tables), name)
        seen[name] = (before, docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    before, after = seen["toxicity"]
    bad = Counter(r.doc_id for r in toxicity.toxicity(before, spark.read.parquet(f"{tables}/labels.parquet")).filter("predicted = 1").collect())
    gone = Counter(plain(before)) - Counter(plain(after))
    assert Counter(i for (i, _), n in gone.items() for _ in range(n)) == bad and sum(bad.values()) > 40 and all(i % 7 == 0 for i in bad)
    before, after = seen["near_duplicates"]
    assert Counter(plain(after)) == one_each(plain(before)) and after.count() < before.count() - 12
    before, after = seen["decontamination"]
    w = items([r for r in [(0, spark.read.parquet(f"{tables}/benchmark.parquet").filter("item_id = 1").first().text)]])[0]
    windows = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    assert Counter(plain(after)) == Counter((i, t) for i, t in plain(before) if not contaminated(t, windows)) and before.count() - after.count() == 3
    before, after = seen["pii"]
    spans = {r.doc_id: r.spans for r in pii.digest(before).collect()}
    assert Counter(plain(after)) == Counter((i, t if t is None else redacted(t, spans[i])) for i, t in plain(before))
    assert {r.doc_id: r.text for r in after.collect()}[1300].endswith("[EMAIL] or [PHONE]") and all(r.n_chars == len(r.text) for r in after.filter("doc_id in (1300, 1301)").collect())
    before, after = seen["mix"]
    assert Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in plain(before)) == Counter((r.doc_id, r.size) for r in after.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in after.collect())
    assert Counter(corpus_pipeline.run(spark, tables).collect()) == Counter(after.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
