"""Benchmark decontamination by a distributed positional inverted index.

The training texts become a stored table of token lists. From it come the
document counts of the test terms and, for the terms that are rarest in some
test window, posting lists: (term, document, position). A window's candidates
are the postings of its rarest term moved by the term's offset; they are
intersected with the moved postings of its second rarest term, and the words
round the rarest term's posting, kept with it, settle an exact match. All of it
is DataFrame functions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store
from ._spans import key_of

WINDOW, SHARE = 13, 20
#: Characters that separate words, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Test windows in a block. A block's windows and terms are broadcast: 13 words of 10 bytes each make 50 MB at most.
#: More windows are more blocks, each held against all of the index.
BLOCK = 200_000


def tokens(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, -1), lambda t: t != "")


def forward(docs: DataFrame) -> DataFrame:
    """The stored token lists: doc_id, the key (k1, k2) of equal rows, and tokens."""
    k1, k2 = key_of(F.col("doc_id"), F.col("text"))
    return _store.save(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), tokens(F.col("text")).alias("tokens")), "tokens")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and words of every window of items (item_id, text); fewer words than window, but not none, make one."""
    w = F.when(F.size("w") <= window, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window)))
    return items.select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0).select("item_id", F.explode(w).alias("words")).distinct()


def find_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block: int = BLOCK) -> DataFrame:
    """Where windows of items occur in index (forward()): k1, k2, start, length, item_id.

    With slop, near matches come too: both rarest terms occur in order, moved
    against each other by at most slop words; ``agree`` is then the share of
    the window's distinct words among the words round the rarest term.
    """
    tests = windows(items, window).withColumn("wid", F.xxhash64("words"))
    blocks = 1 + tests.count() // block
    tests = _store.save(tests.withColumn("block", F.pmod(F.xxhash64("wid"), F.lit(blocks)).cast("int")), "windows")
    parts = [_matched(index, tests.filter(F.col("block") == k).drop("block"), window, slop) for k in range(blocks)]
    return functools.reduce(DataFrame.union, parts)


def _matched(index: DataFrame, tests: DataFrame, window: int, slop: int | None) -> DataFrame:
    """find_matches() of one block of windows (item_id, words, wid)."""
    terms = tests.select(F.explode("words").alias("term")).distinct()
    counts = index.select(F.explode(F.array_distinct("tokens")).alias("term")).join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    counts = _store.save(counts, "terms")
    ranked = tests.select("item_id", "words", "wid", F.posexplode("words").alias("off", "term")).join(counts, "term")
    ranked = ranked.groupBy("item_id", "wid", "words").agg(F.array_sort(F.collect_list(F.struct("df", "term", "off"))).alias("lists")).filter(F.size("lists") == F.size("words"))
    ranked = ranked.withColumn("one", F.col("lists")[0]).withColumn("two", F.get("lists", F.lit(1)))
    ranked = _store.save(ranked.select("item_id", "words", "one.term", "one.off", F.col("two.term").alias("term2"), F.col("two.off").alias("off2")), "ranked")
    firsts, seconds = ranked.select("term", F.lit(True).alias("first")).distinct(), ranked.filter("term2 is not null").select(F.col("term2").alias("term"), F.lit(True).alias("second")).distinct()
    wanted = firsts.join(seconds, "term", "full").select("term", F.coalesce("first", F.lit(False)).alias("first"))
    reach = window - 1 + (slop or 0)
    postings = index.select("k1", "k2", "tokens", F.posexplode("tokens").alias("pos", "term")).join(F.broadcast(wanted), "term")
    context = F.when(F.col("first"), F.slice("tokens", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, 2 * reach + 1))
    postings = _store.save(postings.select("k1", "k2", "term", "pos", context.alias("context")), "postings")
    candidates = postings.filter("context is not null").join(F.broadcast(ranked), "term").withColumn("start", F.col("pos") - F.col("off"))
    moved = postings.select("k1", "k2", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    at = F.col("start") - F.greatest(F.col("pos") - reach, F.lit(0)) + 1
    whole = (F.col("start") >= 0) & (F.slice("context", F.greatest(at, F.lit(1)), F.size("words")) == F.col("words"))
    out = ["k1", "k2", "start", F.size("words").alias("length"), "item_id"]
    if slop is None:
        alone = candidates.filter("term2 is null")
        both = candidates.filter("term2 is not null and start >= 0").withColumn("pos2", F.col("start") + F.col("off2")).join(moved, ["k1", "k2", "term2", "pos2"], "left_semi")
        return alone.unionByName(both, allowMissingColumns=True).filter(whole).select(*out).distinct()
    agree = F.size(F.array_intersect("words", "context")) / F.size(F.array_distinct("words"))
    drift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("drift")
    near = candidates.filter("term2 is not null").select("*", drift).withColumn("pos2", F.col("start") + F.col("off2") + F.col("drift")).join(moved, ["k1", "k2", "term2", "pos2"], "left_semi")
    near = near.filter((F.signum(F.col("off2") - F.col("off")) == F.signum(F.col("pos2") - F.col("pos"))) | whole)
    return near.unionByName(candidates.filter("term2 is null"), allowMissingColumns=True).select(*out, agree.alias("agree"), whole.alias("exact")).distinct()


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per row of docs: doc_id, k1, k2, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words. A null text has no
    words; an item without words has no windows; repeated rows are judged
    alike; empty tables and windows that occur nowhere are fine. item_ids are
    hashed sorted as strings, joined by commas; a null item_id is left out.
    """
    index = forward(docs)
    found = find_matches(index, items, window)
    # The furthest end of a start is enough; the union of the runs in order of start.
    ends = found.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"), F.collect_set("item_id").alias("ids"))
    runs = ends.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["at"], x["start"]))).alias("n"))

    n_hit = F.aggregate("runs", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    names = F.array_join(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), ",")
    hits = runs.select("k1", "k2", n_hit.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), names.alias("items"))
    rows = index.select("doc_id", "k1", "k2", F.size("tokens").cast("long").alias("n_words")).join(hits, ["k1", "k2"], "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items"))
    return rows.select("doc_id", "k1", "k2", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """docs without its contaminated rows (see judge); columns stay as they are, whatever their names, and an empty table stays empty."""
    bad = _store.save(judge(docs, items, window, share).filter("contaminated").select("k1", "k2").distinct(), "contaminated")
    k1, k2 = key_of(docs["doc_id"], docs["text"])
    return docs.join(bad, (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("k1", "k2")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, len, array_to_string(w[i + 1 : i + len], ' ') AS key
  FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM items),
starts AS (
  SELECT doc_id, len, i, array_to_string(w[i + 1 : i + len], ' ') AS key
  FROM (SELECT doc_id, w, lens.len, unnest(range(len(w) - lens.len + 1)) AS i FROM d, lens WHERE len(w) >= lens.len)),
hits AS (SELECT doc_id, i, starts.len, item_id FROM starts JOIN items USING (len, key)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""
