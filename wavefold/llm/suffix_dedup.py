"""Suffix-array dedup: a logarithmic family of sparse suffix arrays.

Documents come in batches, and each new batch gets a sorted run of its sampled
suffixes: one for every anchor (see ``_spans``). Suffixes are ordered by the
fingerprint of their first ``gram`` bytes instead of by the bytes themselves,
which keeps equal beginnings adjacent and is all that finding long matches
needs; suffixes that begin alike are one entry, with the least and the greatest
fingerprint of the text round them. Before a run becomes part of the family, it
is merge-scanned against every level: level tables are bucketed and sorted
alike, so a scan is a merge of bucket with bucket that moves no row. A scan
emits the matches that the new batch makes, with their length: the whole span
where all texts round a suffix are equal, or else at least ``gram`` bytes, to be
extended when the spans' bytes are compared. Then levels of equal size merge
into one of twice the size, so n batches leave at most log2(n) + 1 levels and an
entry is rewritten log2(n) times.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spans, _store

WINDOW, GRAM, BATCHES = 200, 32, 4


class IndexFamily:
    """Levels of suffix runs; level k holds 2**k batches, or is None. ``found`` has the matches that each insert made, by anchor."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.window, self.gram = spark, window, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.found: list[DataFrame] = []

    def __enter__(self) -> IndexFamily:
        return self

    def __exit__(self, *_) -> None:
        while self.levels:
            table = self.levels.pop()
            if table:
                _store.drop(self.spark, table)

    def insert(self, suffixes: DataFrame) -> None:
        """Sort a batch's suffixes (anchors()) into a run, scan the levels with it, and merge runs of equal size upwards."""
        run = _store.bucketed(_spans.summary(suffixes).repartition(self.buckets, "ah"), "ah", self.buckets)
        try:
            self.found.append(_store.save(self._scan(run), "matches"))
            k = 0
            while k < len(self.levels) and self.levels[k]:
                merged = _store.bucketed(self._merge(self.levels[k], run), "ah", self.buckets)
                old, self.levels[k] = self.levels[k], None
                for table in (run, old):
                    _store.drop(self.spark, table)
                run, k = merged, k + 1
        except BaseException:
            _store.drop(self.spark, run)
            raise
        self.levels[k : k + 1] = [run]

    def _scan(self, run: str) -> DataFrame:
        """Matches within a run, and of the run with each level: (ah, s1, s2, length)."""
        new = self.spark.table(run)
        pairs = [new.filter("n > 1").select("ah", "s1", "s2", "nw")]
        for level in filter(None, self.levels):
            old = self.spark.table(level).select("ah", *(F.col(c).alias(f"{c}_") for c in ("s1", "s2", "nw")))
            pairs.append(new.hint("merge").join(old, "ah").select("ah", F.least("s1", "s1_").alias("s1"), F.greatest("s2", "s2_").alias("s2"), F.greatest("nw", "nw_").alias("nw")))
        every = functools.reduce(DataFrame.union, pairs)
        whole = F.col("nw").cast("int") - 1 + self.window
        return every.select("ah", "s1", "s2", F.when(F.col("s1") == F.col("s2"), whole).otherwise(self.gram).alias("length"))

    def _merge(self, a: str, b: str) -> DataFrame:
        """Both runs as one, entry by entry of the two sorted tables."""
        names = ("n", "s1", "s2", "nw")
        other = self.spark.table(b).select("ah", *(F.col(c).alias(f"{c}_") for c in names))
        both = self.spark.table(a).hint("merge").join(other, "ah", "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))
        return both.select("ah", n.alias("n"), F.least("s1", "s1_").alias("s1"), F.greatest("s2", "s2_").alias("s2"), F.greatest("nw", "nw_").alias("nw"))

    def matches(self) -> DataFrame:
        """Suffixes that occur more than once, from the matches that the inserts emitted: (ah, s1, s2, length)."""
        every = functools.reduce(DataFrame.union, self.found)
        return every.groupBy("ah").agg(F.min("s1").alias("s1"), F.max("s2").alias("s2"), F.min("length").alias("length"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, wide: int = 128, keep_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``window`` bytes that also starts elsewhere in docs (doc_id, text).

    Returns a row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and kept_text if asked for.

    A null or empty text, or one shorter than window, loses nothing. Repeated
    rows are copies of each other, whatever their ids, so both lose all their
    bytes once they reach window. An empty table gives an empty result; columns
    other than doc_id and text are ignored. A null doc_id stays null.
    """
    docs = _spans.keyed(docs)
    found = _spans.anchors(docs, "byte", window, gram).withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int"))
    found = _store.save(found, "suffixes", by="batch")
    with IndexFamily(docs.sparkSession, window, gram) as family:
        for k in range(batches):
            family.insert(found.filter(F.col("batch") == k))
        known = _store.save(family.matches(), "known")
    return _spans.cut(docs, _spans.repeats(docs, found, known, "byte", window, gram, wide), "byte", keep_text).withColumnRenamed("n_symbols", "n_bytes")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
