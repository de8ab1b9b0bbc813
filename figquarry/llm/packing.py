"""Best-fit packing of token sequences by minimum bin slack.

Only the lengths of pieces matter to packing, and there are at most `capacity` different ones. The packer therefore
works on a histogram of lengths (at most 4096 rows, whatever the corpus): for the largest length left, a bitset
subset-sum over the available lengths finds the fullest feasible combination, which is removed as many times as the
counts allow. What comes out is a list of patterns with multiplicities; each piece then finds its place from its
length and its rank among the pieces of that length, by binary search in a table of the patterns. Nothing but the
histogram and the patterns ever meets in one place.

Defined results: a null or empty text has the single id 1; repeated rows are packed once each; a null doc_id is
kept; an empty table gives an empty result. Very long texts are tokenized whole and cut into pieces of a sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, held_by_worker, id_and_text, in_arrow, materialise

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
# Letters, numbers and white space below U+0180, where lower case keeps lengths and nothing composes.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")


class Encoder:
    """Text -> ids as little-endian uint32 bytes, by a tokenizers file with word ends (`</w>`).

    That tokenizer works word by word, so the tokenizer itself is asked once for each word that a worker meets and
    remembers, many at a time. Words are split here for texts of characters below U+0180; any other text goes to the
    tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.memo = Memo()

    def ids(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of single words, told apart in their ids together by the pieces that end words."""
        joined = self.ids([" ".join(words)])[0]
        ends = (np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) * 4 + 4).tolist()
        if len(ends) != len(words):
            return self.ids(words)
        return [joined[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.ids([text])[0]
        return b"".join(self.memo.values(_WORD.findall(text.lower()), self.learn))


def encoder(path: str) -> Encoder:
    """The one encoder of a worker for a tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held_by_worker(("packing", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32; pid and rank number the pieces of a length within a task."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, ranks = encoder(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), pid, ranks[n]))
                    ranks[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank")
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return in_arrow(id_and_text(docs), run, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (with how many of each) whose sum comes nearest to room from below. lengths: in descending order.

    Bit s of `reach` is set if s is a sum of what has been offered so far; offering stops once room itself is one.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, step = min(counts[n], room // n), 1
        while left:
            take = min(step, left)
            layers.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(layers):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + take
            total -= n * take
    return used


def patterns(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack over a histogram of lengths: [([(length, how many in a bin), ...], how many such bins)]."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fullest(lengths, counts, capacity - first) if first < capacity else {}
        counts[first] += 1
        used = {first: used.pop(first, 0) + 1} | used
        times = min(counts[n] // k for n, k in used.items())
        out.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            counts[n] -= k * times
        if any(not counts[n] for n in used):
            lengths = [n for n in lengths if counts[n]]
    return out


def slots(found: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The patterns as a table sorted by length and rank: from that rank on, `per` pieces of the length go to each bin."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for used, times in found:
        at = 0
        for n, k in used:
            rows.append((n, taken.get(n, 0), k, first, at))
            taken[n] = taken.get(n, 0) + k * times
            at += n * k
        first += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "first", "at"), cols))


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Places the pieces (as pieces() returns them): adds sequence_id and offset. cut is read three times: give a written table."""
    spark = cut.sparkSession
    each = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    # one row a length: bounded by capacity, not by the corpus
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(F.col("length").alias("l"), F.col("pid").alias("p"), F.coalesce(F.sum("n").over(before.partitionBy("length")), F.lit(0)).alias("base"))
    ranked = cut.join(base, (F.col("length") == F.col("l")) & (F.col("pid") == F.col("p"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = plan.value
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            lo, hi = np.searchsorted(t["length"], n, "left"), np.searchsorted(t["length"], n, "right")
            while (hi - lo > 1).any():  # the last row of the length whose rank isn't above
                mid = (lo + hi) // 2
                up = t["rank"][mid] <= rank
                lo, hi = np.where(up & (hi - lo > 1), mid, lo), np.where(~up & (hi - lo > 1), mid, hi)
            k = rank - t["rank"][lo]
            per = t["per"][lo]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t["first"][lo] + k // per), pa.array(t["at"][lo] + k % per * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return in_arrow(ranked, place, PLACED)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Tokenises, cuts and packs documents. One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialise(pieces(docs, tokenizer_path, capacity, end_id)), capacity)
