"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic and one of ordinary text.

There are two kinds of windows, each with a pair of dictionaries and a threshold of its own:

* Openings: the first OPENING letters or digits of each word, between fixed marks. Both dictionaries hold the commonest
  openings of all training text; the toxic one also those that toxic documents have significantly more often (a
  log-likelihood ratio test over documents), the ordinary one as many bytes of what is most telling of, or else next
  commonest in, ordinary documents. A window's distance is what the toxic dictionary saves of its length under the
  ordinary one, as a share of what a whole match would save. A document's is its rank-th largest; rank and threshold
  are those that err least on the training documents.
* Passages: PASSAGE words on end. The dictionaries are what zstandard's trainer makes of the passages of either class;
  a window's distance is the saving as a share of its length, a document's is its largest. The threshold lies above
  what any ordinary training document reaches under dictionaries made without it. So passages catch what openings
  can't, toxic text of ordinary words that is repeated from the training documents, and little else.

The score is a logistic curve of the larger margin, 0.5 where a threshold is met.

Training reads at most `sample` labelled documents of each class (those with the least hashes of doc_id) and
TRAIN_BYTES of text, a document being read whole or not at all; of copies and near copies among them only one makes
dictionaries: a text that is common for having been copied says nothing.

Defined results: null and empty texts have distance 0; texts of fewer words than rank are judged by all of them; longer
words are windows of WORD characters each; repeated rows are scored each for itself; labels of a document that
contradict each other count as toxic; without toxic training rows every score is 0; no documents give no rows. Texts are scored
whole, window by window, in memory by their length; texts of over a quarter of TRAIN_BYTES aren't trained on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, clean_labels, held_by_worker, id_and_text, in_arrow, remainder

SAMPLE = 3000
TRAIN_BYTES = 64 << 20
COMMON_WINDOWS = 3000
OPENING = 7
WORD = 48
RANKS = (1, 2, 3)
PASSAGE = 8
PASSAGE_BYTES = 512
DICTIONARY_BYTES = 1 << 16
LEVEL = 8
START, END = b"\n", b" " + b"<=>~" * 8
_OPENING = re.compile(rf"([^\W_]{{1,{OPENING}}})[^\W_]{{0,{WORD - OPENING}}}")


def openings(text: str) -> list[str]:
    return _OPENING.findall(text.lower())


def passages(text: str) -> Iterator[bytes]:
    words = text.lower().split()
    for at in range(0, len(words), PASSAGE):
        part = " ".join(words[at : at + PASSAGE]).encode()
        for k in range(0, len(part), PASSAGE_BYTES):
            yield part[k : k + PASSAGE_BYTES]


def _distinct(texts: list[str]) -> list[str]:
    """The texts less near copies: of those that share any of six minima over hashed word triples, the first."""
    seen, out = set(), []
    for text in texts:
        words = text.split()
        h = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
        minima = {(k, int(((h * np.uint64(2 * a + 1) + np.uint64(a)) % np.uint64(4294967291)).min())) for k, a in enumerate((20177, 48611, 97531, 500009, 32802, 1327217884))}
        if not minima & seen:
            out.append(text)
        seen |= minima
    return out


def _ratio(a: int, total_a: int, b: int, total_b: int) -> float:
    """Dunning's log-likelihood ratio that the first share is larger; 0 if it isn't."""
    if a * total_b <= b * total_a:
        return 0.0
    p = (a + b) / (total_a + total_b)
    return 2 * (a * math.log(a / (total_a * p)) + (b * math.log(b / (total_b * p)) if b else 0))


@dataclass
class Model:
    """The dictionaries of both kinds, and the distances from which a document counts as toxic."""

    number: int
    toxic: bytes = b""
    ordinary: bytes = b""
    whole: int = 0  # the usual compressed length of a window that is in the toxic dictionary
    rank: int = 1
    threshold: float = math.inf
    trained: tuple[bytes, bytes] | None = None  # of passages: toxic, ordinary
    passage_threshold: float = math.inf

    def score(self, distances: tuple[float, float]) -> float:
        margin = max(distances[0] - self.threshold, distances[1] - self.passage_threshold)
        return 0.0 if math.isinf(margin) else 1 / (1 + math.exp(-8 * max(margin, -80)))


class Scorer:
    """Distances of windows and documents under a model; those of openings are remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, Memo()
        self.pair = [self._raw(x) for x in (model.ordinary, model.toxic)]
        self.passage_pair = [self._trained(x) for x in reversed(model.trained)] if model.trained else None

    @staticmethod
    def _raw(content: bytes):
        import zstandard as z

        p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return z.ZstdCompressor(dict_data=d, compression_params=p)

    @staticmethod
    def _trained(content: bytes):
        import zstandard as z

        p = z.ZstdCompressionParameters.from_level(3, source_size=PASSAGE_BYTES, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS)
        d = z.ZstdCompressionDict(content)
        d.precompute_compress(compression_params=p)
        return z.ZstdCompressor(dict_data=d, compression_params=p)

    def lengths(self, opening: str) -> tuple[int, int]:
        framed = START + opening.encode() + END
        ordinary, toxic = self.pair
        return len(ordinary.compress(framed)), len(toxic.compress(framed))

    def window(self, opening: str) -> float:
        ordinary, toxic = self.lengths(opening)
        return (ordinary - toxic) / max(1, ordinary - self.model.whole)

    def largest(self, text: str) -> list[float]:
        """The distances of the openings that have any, the largest last; as many as the largest rank."""
        every = self.memo.values(openings(text), lambda new: map(self.window, new))
        top = sorted([d for d in every if d > 0])[-max(RANKS) :]
        return [0.0] * (min(len(every), max(RANKS)) - len(top)) + top

    def passage(self, text: str) -> float:
        if not self.passage_pair:
            return 0.0
        ordinary, toxic = (x.compress for x in self.passage_pair)
        return max((1 - len(toxic(p)) / len(ordinary(p)) for p in passages(text)), default=0.0)

    def distances(self, text: str) -> tuple[float, float]:
        return ranked(self.largest(text), self.model.rank), self.passage(text)


def ranked(largest: list[float], rank: int) -> float:
    return largest[-min(rank, len(largest))] if largest else 0.0


def _opening_pair(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, list[str]]:
    """Content of the toxic and of the ordinary dictionary of openings, and what is telling of toxic text."""
    counts = [Counter(w for t in texts for w in set(openings(t))) for texts in (toxic, ordinary)]
    totals = [max(1, len(texts)) for texts in (toxic, ordinary)]
    bound = 2 * math.log(len(counts[0] | counts[1]) or 1) + 4  # keeps chance finds rare whatever the vocabulary

    def telling(k: int) -> list[str]:
        found = [w for w, c in counts[k].items() if _ratio(c, totals[k], counts[1 - k][w], totals[1 - k]) > bound]
        return sorted(found, key=lambda w: (counts[k][w], w))

    content = lambda words: b"".join(START + w.encode() + END for w in words)
    own, other = telling(0), telling(1)
    apart = {*own, *other}
    common = [w for w, _ in sorted(((w, c) for w, c in (counts[0] + counts[1]).items() if w not in apart), key=lambda x: (-x[1], x[0]))]
    base, tail = content(reversed(common[:COMMON_WINDOWS])), content(own)
    # offsets cost the same in both: the ordinary tail is as long, the most telling at its end
    filled = (content(common[COMMON_WINDOWS : COMMON_WINDOWS + len(own)]) + content(other)).rjust(len(tail), START)
    return base + tail, base + filled[len(filled) - len(tail) :], own


def _passage_pair(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """What zstandard's trainer makes of either class, in equal size; None where there is too little text to train on."""
    import zstandard as z

    samples = [[p for t in texts for p in passages(t)] for texts in (toxic, ordinary)]
    size = min(DICTIONARY_BYTES, min(sum(map(len, s)) for s in samples) // 10)
    if size < 1 << 10 or min(map(len, samples)) < 50:
        return None
    try:
        a, b = (z.train_dictionary(size, s, k=64, d=8).as_bytes() for s in samples)
    except z.ZstdError:
        return None
    return a, b


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries, rank and thresholds from the texts of either class."""
    lone = [_distinct(texts) for texts in (toxic, ordinary)]
    if not lone[0]:
        return Model(0)
    bad, good, telling = _opening_pair(*lone)
    model = Model(zlib.crc32(bad + good), bad, good)
    model.whole = sorted(Scorer(model).lengths(w)[1] for w in telling)[len(telling) // 2] if telling else 0
    scorer = Scorer(model)
    there, other = ([scorer.largest(t) for t in texts] for texts in (toxic, ordinary))
    steps = np.arange(0.05, 1.2, 0.05)
    errors = {}
    for rank in RANKS:
        a, b = (np.array([ranked(x, rank) for x in found]) for found in (there, other))
        errors |= {(rank, k): int((a < step).sum() + (b >= step).sum()) for k, step in enumerate(steps)}
    least = min(errors.values())
    model.rank = next(rank for (rank, _), e in errors.items() if e == least)
    best = [k for (rank, k), e in errors.items() if e == least and rank == model.rank]
    model.threshold = float(steps[best[len(best) // 2]])
    return _with_passages(model, lone)


def _with_passages(model: Model, lone: list[list[str]]) -> Model:
    reached = []
    half = lambda texts, k: [t for t in texts if zlib.crc32(t.encode()) % 2 == k]
    for k in (0, 1):
        pair = _passage_pair(*(half(texts, 1 - k) for texts in lone))
        if pair is None:
            return model
        scorer = Scorer(Model(0, trained=pair))
        reached += [scorer.passage(t) for t in half(lone[1], k)]
    if (pair := _passage_pair(*lone)) and reached:
        model.trained, model.passage_threshold = pair, max(reached) + 0.05
        model.number = zlib.crc32(b"".join(pair), model.number)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample: int = SAMPLE) -> Model:
    """Trains on labelled documents whose remainder isn't held_fold; at most `sample` of each class come to the driver."""
    usable = clean_labels(labels, "toxic").where(remainder("doc_id", folds) != held_fold)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = []
    for label in (1, 0):
        chosen = usable.where(F.col("label") == label).orderBy(*order).limit(sample).select("doc_id")  # bounded, so it may be broadcast
        found = id_and_text(docs).join(F.broadcast(chosen), "doc_id").where((F.col("text") != "") & (F.octet_length("text") <= TRAIN_BYTES // 4))
        one = found.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(*order)  # rows that share a doc_id count once
        kept, room = [], TRAIN_BYTES
        for r in one.toLocalIterator():
            room -= len(r["text"].encode())
            if room < 0:
                break
            kept.append(r["text"])
        texts.append(sorted(kept))
    return train(*texts)


def _per_document(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = held_by_worker(("toxicity", model.number), lambda: Scorer(model))
        for batch in batches:
            yield make(batch, lambda text: model.score(scorer.distances(text or "")))

    return in_arrow(docs, run, schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: a row for each document."""

    def make(batch, score):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return _per_document(id_and_text(docs), model, "doc_id long, score double", make)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""
    at = docs.columns.index("text")
    return _per_document(docs, model, docs.schema, lambda batch, score: batch.filter(pa.array([score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_())))
