"""Substring dedup: relative Lempel-Ziv parsing of documents against reference blocks.

The corpus is its own reference. It is cut into phrases at synchronised anchors
(see ``_spans``), and the anchor's hash deals the phrases into blocks, so that
whatever a phrase may share with the corpus over ``window`` words is in the one
block of its anchor. Each block is indexed by the sorted suffixes of its
phrases, and every phrase of a document is factored greedily against the block's
other phrases: a factor is the longest run of words from here on that another
phrase has, with its start, its length and its source; a word that no other
phrase has is a factor of length 0. A phrase that occurs again as a whole is one
factor, known without parsing.

A repeated window holds at most one end of a factor: a factor that starts in it
reaches the window's end at least. So windows within a factor of ``window``
words are duplicates, windows over one boundary are checked against the index,
and all others are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import _spans, _store
from ._text import expand

WINDOW, GRAM = 35, 8


class ReferenceBlock:
    """Index of phrases: symbols[first[r] : first[r + 1]] is phrase r; only phrases of one group are held against each other."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, group: np.ndarray):
        self.first = first
        size = np.diff(first)
        self.row = np.repeat(np.arange(len(size)), size)
        n = len(symbols)
        self.left = np.repeat(first[1:], size) - np.arange(n)  # symbols from here to the phrase's end
        #: ranks[k]: place of each run of 2**k symbols (cut at the phrase's end) among all such runs.
        self.ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(self.ranks) - 1) < size.max(initial=1):
            k = 1 << (len(self.ranks) - 1)
            after = np.zeros(n, np.int64)
            after[: n - k] = np.where(self.left[: n - k] > k, self.ranks[-1][k:] + 1, 0)
            self.ranks.append(np.unique(self.ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        group = group[self.row]
        #: Suffixes in order of (group, content), and each suffix's place there.
        self.order = np.lexsort((self.row, self.ranks[-1], group))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        row, group = self.row[self.order], group[self.order]
        # The nearest suffixes of other phrases on either side, or -1.
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.zeros(0, np.int64)
        run = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1 if n else new
        before, behind = new[run] - 1, np.r_[new[1:], n][run]
        self.before = np.where((before >= 0) & (group[before] == group), before, -1)
        self.behind = np.where((behind < n) & (group[behind % max(1, n)] == group), behind, -1)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at a and b; b may be -1 for none."""
        out = np.zeros(len(a), np.int64)
        live = b >= 0
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = np.where(live, a + out, 0), np.where(live, b + out, 0)
            left = np.minimum(self.left[a], self.left[np.maximum(b, 0)]) - out
            inside = live & (left >= 1 << k)
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            out += np.where(inside & (self.ranks[k][x] == self.ranks[k][y]), 1 << k, 0)
        return out

    def longest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest run from each of the positions that another phrase of the group has, and where that has it (-1: nowhere)."""
        best, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
        for near in (self.before, self.behind):
            other = near[self.place[at]]
            other = np.where(other >= 0, self.order[other], -1)
            n = self.shared(at, other)
            better = n > best
            best, source = np.where(better, n, best), np.where(better, other, source)
        return best, source


@dataclass
class Factors:
    """Of each factor its phrase, start, length (0: a word of its own) and source, in order of start."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    source: np.ndarray


def factor(block: ReferenceBlock) -> Factors:
    """Greedy factors of every phrase of the block, all phrases at once, factor by factor."""
    parts = []
    row = np.flatnonzero(np.diff(block.first) > 0)
    at = block.first[row]
    while len(row):
        length, source = block.longest(at)
        parts.append((row, at, length, source))
        at = at + np.maximum(length, 1)
        on = at < block.first[row + 1]
        row, at = row[on], at[on]
    row, start, length, source = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
    order = np.argsort(start, kind="stable")
    return Factors(row[order], start[order], length[order], source[order])


def repeated_windows(symbols: np.ndarray, first: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows, in order of (row, start), occur in another row of their row's group, by their factors."""
    block = ReferenceBlock(symbols, first, group)
    found = factor(block)
    start, _ = expand(first[:-1], np.diff(first) - window + 1)
    at = np.searchsorted(found.start, start, "right") - 1  # the factor that each window starts in
    end = found.start + np.maximum(found.length, 1)
    inside = (found.length[at] > 0) & (start + window <= end[at])
    after = np.minimum(at + 1, len(end) - 1)
    doubt = np.flatnonzero(~inside & (found.length[after] > 0) & (found.length[at] > 0) & (start + window <= end[after]))
    inside[doubt] = block.longest(start[doubt])[0] >= window
    return inside


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, wide: int = 128, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by ``window`` words whose sequence also starts elsewhere in docs (doc_id, text).

    Words are separated by ASCII white space and unchanged. Returns a row per
    row of docs: doc_id, n_words, n_removed, n_spans, kept_sha256 (kept words
    joined by one space), and kept_text if asked for.

    A null or empty text has no words; texts of fewer than window words lose
    none. Repeated rows are copies of each other. An empty table gives an empty
    result; other columns are ignored. A null doc_id stays null.
    """
    docs = _spans.keyed(docs)
    found = _spans.anchors(docs, "word", window, gram)
    blocks = _store.save(_spans.summary(found).filter("n > 1"), "blocks")
    return _spans.cut(docs, _spans.repeats(docs, found, blocks, "word", window, gram, wide, repeated_windows), "word", keep_text).withColumnRenamed("n_symbols", "n_words")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
