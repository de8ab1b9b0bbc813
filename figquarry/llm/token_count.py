"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton lists every vocabulary piece in a word; one left-to-right pass keeps, for each position,
the best score and how many pieces it took - no back pointers, no pieces. Tie rules are those of the `tokenizers`
library's Unigram model: starts are taken in order, shorter pieces first, and a later path wins only by a strictly
higher score; where no one-character piece starts, an unknown piece of score min - 10 may; unknown neighbours are one
token. Words are split at white space and carry the word mark in front, so pieces never join across words, and a
worker searches each word only once as long as it remembers it (within a bound of bytes; long words aren't kept).

The vocabulary is the list of pieces of a public tokenizer file; as that is no unigram file, a piece's score is the
Zipf estimate -ln(rank + 1) of its rank there. Byte-fallback and control pieces aren't matched.

Defined results: null and empty texts have no tokens; repeated rows are counted each for itself; null ids are kept; a word
of any length takes memory by the longest piece, beside the text itself; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, held_by_worker, id_and_text, in_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model file with scores by rank; the unknown piece stands first."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [("<unk>", 0.0)] + [(p, -math.log(r + 1.0)) for r, p in enumerate(normal, 1)]


class WordCounter:
    """Tokens of single words, remembered."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int = 0) -> None:
        import ahocorasick

        self.automaton, self.memo, self.longest = ahocorasick.Automaton(), Memo(), 1
        for k, (piece, score) in enumerate(vocab):
            if k != unknown and piece:
                self.automaton.add_word(piece, (len(piece), score))
                self.longest = max(self.longest, len(piece))
        self.automaton.make_automaton()
        self.unknown_score = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY

    def search(self, word: str) -> int:
        """The number of pieces of the best segmentation of word. Holds as many positions as the longest piece has
        characters, however long the word is."""
        size = self.longest + 1
        # by position, in a ring: the best score, the tokens on its path, and whether the last of them is unknown (unknown neighbours are one)
        best, count, open_unknown = [-math.inf] * size, [0] * size, [False] * size
        best[0] = 0.0
        matches = self.automaton.iter(word)
        match = next(matches, None)
        for to in range(1, len(word) + 1):
            ending = []
            while match is not None and match[0] == to - 1:
                ending.append(match[1])
                match = next(matches, None)
            top, tokens, unknown, single = -math.inf, 0, False, False
            for length, score in sorted(ending, reverse=True):  # the earliest start first: a later one wins by a higher score only
                at = (to - length) % size
                single = single or length == 1
                if (total := best[at] + score) > top:
                    top, tokens, unknown = total, count[at] + 1, False
            at = (to - 1) % size
            if not single and (total := best[at] + self.unknown_score) > top:
                top, tokens, unknown = total, count[at] + (not open_unknown[at]), True
            at = to % size
            best[at], count[at], open_unknown[at] = top, tokens, unknown
        return count[len(word) % size]

    def text(self, text: str) -> tuple[int, int]:
        """(tokens, words) of a text."""
        words = text.split()
        return sum(self.memo.values(words, lambda new: [self.search(MARK + w) for w in new])), len(words)


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens: a row for each document. Workers read the vocabulary file once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held_by_worker(("token_count", vocabulary_path), lambda: WordCounter(vocabulary(vocabulary_path)))
        for batch in batches:
            rows = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return in_arrow(id_and_text(docs), run, "doc_id long, n_words long, n_tokens long")
