"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. Benchmark items are indexed by the hashes of their runs of
`min_words` words (seeds). A document's seeds say which items it may share text with and which of its words can lie
in a match at all; over those, each round takes the longest matches that overlap no earlier one (found by running
Karp-Rabin hashes, checked word by word) and marks them as tiles. An item counts as leaked if tiles cover at least
`min_coverage` of its words, in whatever order they stand in the document.

The benchmark is taken in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters on average; each block's
index is broadcast, and every document meets every block.

Defined results: null and empty texts match nothing; items with fewer than min_words words match nothing; repeated
documents and items are reported each for itself; null ids are kept; without documents or items there are no rows. Texts
are read whole, in memory by their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_arrow

MIN_WORDS = 5
MIN_COVERAGE = 0.6
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000
HITS = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, coverage double"
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of n values, by doubling."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    whole, done, power, out, size = ids.astype(np.uint64), 0, _BASE, None, 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                tail = whole[done:]
                out = tail if out is None else out[: len(tail)] * power + tail[: len(out)]
                done += size
            if size * 2 > n:
                return out[: len(ids) - n + 1]
            whole = whole[:-size] * power + whole[size:]
            power, size = power * power, size * 2


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word numbers (0 matches nothing): (start in a, start in b, length) of the tiles.

    Search lengths fall from the longest possible; at each, matches are taken longest first, ties by position.
    """
    free_a, free_b, out = a != 0, b != 0, []
    length = min(len(a), len(b))
    while length >= least:
        found = _matches(a, b, free_a, free_b, length)
        if found:
            for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
                if free_a[i : i + n].all() and free_b[j : j + n].all():
                    free_a[i : i + n] = free_b[j : j + n] = False
                    out.append((i, j, n))
            if not _matches(a, b, free_a, free_b, length):
                length = max(least, length // 2) if length > least else least - 1
        else:
            length = max(least, length // 2) if length > least else least - 1
    return out


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least n free words: (length, start in a, start in b)."""

    def open_windows(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if len(x) >= n else np.empty(0, np.int64)
        return at, _windows(x, n)[at] if len(at) else np.empty(0, np.uint64)

    (at_a, hash_a), (at_b, hash_b) = open_windows(a, free_a), open_windows(b, free_b)
    by_hash = defaultdict(list)
    for i, h in zip(at_a.tolist(), hash_a.tolist()):
        by_hash[h].append(i)
    out, seen = [], set()
    for j, h in zip(at_b.tolist(), hash_b.tolist()):
        for i in by_hash.get(h, ()):
            if (i, j) in seen or not np.array_equal(a[i : i + n], b[j : j + n]):
                continue
            k = n
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            seen.update((i + d, j + d) for d in range(k - n + 1))
            out.append((k, i, j))
    return out


class Index:
    """The benchmark items of a block: word numbers, and which items hold a seed."""

    def __init__(self, items: list[tuple[int | None, str]], least: int) -> None:
        self.least, self.numbers, self.items, postings = least, {}, [], defaultdict(list)
        for item_id, text in items:
            words = _WORD.findall(text.lower())
            if len(words) >= least:
                self.items.append((item_id, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)))
        for k, (_, ids) in enumerate(self.items):
            for h in set(_windows(ids, least).tolist()):
                postings[h].append(k)
        self.seeds = np.array(sorted(postings), np.uint64)
        self.held = [postings[int(h)] for h in self.seeds]

    def hits(self, text: str, min_coverage: float) -> list[tuple[int | None, int, int, int]]:
        """(item_id, tiles, words covered, words) of the items that text covers by min_coverage at least."""
        number = self.numbers.get
        ids = np.array([number(w, 0) for w in _WORD.findall(text.lower())], np.int64)
        if len(ids) < self.least or not len(self.seeds):
            return []
        hashes = _windows(ids, self.least)
        place = np.searchsorted(self.seeds, hashes)
        place[place == len(self.seeds)] = 0
        at = np.flatnonzero(self.seeds[place] == hashes)
        if not len(at):
            return []
        near = defaultdict(list)
        for p, k in zip(at.tolist(), place[at].tolist()):
            for item in self.held[k]:
                near[item].append(p)
        out = []
        for k, starts in sorted(near.items()):
            item_id, words = self.items[k]
            cover = np.zeros(len(ids), bool)
            for p in starts:
                cover[p : p + self.least] = True
            if np.isin(words, ids[cover]).sum() < min_coverage * len(words):
                continue  # tiles lie on places of the item whose words are there
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]])))
            runs = [x for a, b in zip(edges[::2], edges[1::2]) for x in (ids[a:b], [0])]
            found = tiles(words, np.concatenate(runs), self.least)
            covered = sum(n for _, _, n in found)
            if covered >= min_coverage * len(words):
                out.append((item_id, len(found), covered, len(words)))
        return out


def _blocks(benchmark: DataFrame, least: int) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Index([(r[0], r[1]) for r in block.orderBy("item_id", "text").toLocalIterator()], least)


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each document and benchmark item that it covers: doc_id, item_id, n_tiles, covered_words, item_words, coverage."""
    out = None
    for index in _blocks(benchmark, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, item, n, covered, words, covered / words)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for item, n, covered, words in shared.value.hits(text.as_py() or "", min_coverage)
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                names = ("doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

        part = in_arrow(id_and_text(docs), run, HITS)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of docs, all columns, that cover no benchmark item."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.hits(t.as_py() or "", min_coverage) for t in batch.column(at)], pa.bool_()))

        docs = in_arrow(docs, run, docs.schema)
    return docs
