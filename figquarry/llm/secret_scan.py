"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of each text.

The combined automaton reads a text once, from its last byte to its first, and accepts, rule by rule, wherever a match
starts. A span then reaches from the leftmost start that lies in no earlier span of its kind to the end of the longest
match there, for which only the bytes of the span are read, by the rule's own automaton. So time is linear in the
text whatever stands in it. A span whose strict form (minimum lengths) fails is dropped after it has taken its place.
Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows give repeated results; a null doc_id is kept; no rows
give no rows. Texts of any length are scanned whole in one pass, in memory by their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automaton import Automaton, build
from .common import id_and_text, in_arrow

# Fixed values: (kind, pattern, strict pattern, ignore case). The first three are the base kinds. Matches of access and
# hex are whole runs, so where a strict one starts, the pattern's own match can't have started later.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
RULES = [
    ("assign", _ASSIGN + "+", _ASSIGN + "{6,}", True),
    ("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", False),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{24,}", False),
    ("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{30,}", False),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}", False),
]
BASE = 3


_RUNS = {"access", "hex"}


class Scanner:
    """The combined automaton of all rules, and two automata of each rule for its spans: pattern and strict pattern."""

    def __init__(self, rules: list[tuple[str, str, str, bool]] = RULES) -> None:
        self.kinds = [r[0] for r in rules]
        self.all = build([(strict if kind in _RUNS else pattern, fold) for kind, pattern, strict, fold in rules], anchored=False, backward=True)
        self.own: list[tuple[Automaton, Automaton]] = [(build([(p, fold)], True), build([(strict, fold)], True)) for _, p, strict, fold in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        found = []
        for k, starts in self.all.starts(data).items():
            full, strict = self.own[k]
            coded, hard, free = data.translate(full.classes), data.translate(strict.classes), 0
            for i in starts:
                if i >= free:
                    free = full.longest(coded, i)
                    if strict.longest(hard, i) == free:
                        found.append((i, k, free))
        return sorted(found)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, in order."""
        found = self.byte_spans(data)
        if found and not data.isascii():
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(before[a]), k, int(before[b])) for a, k, b in found]
        return found

    def redacted(self, data: bytes) -> bytes:
        """data with each span replaced by its kind in brackets; where spans overlap, by the kind that starts first."""
        out, at = [], 0
        for a, k, b in self.byte_spans(data):
            if a >= at:
                out += [data[at:a], b"[", self.kinds[k].encode(), b"]"]
            at = max(at, b)
        return b"".join([*out, data[at:]]) if at else data


def _scanner(spark: SparkSession):
    return spark.sparkContext.broadcast(Scanner())  # compiled once; its size follows from the rules


def scan(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans, as `kind:start:end` by start, comma-joined."""
    shared = _scanner(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                found = scanner.spans(text.as_py() or b"")
                names = [f"{scanner.kinds[k]}:{a}:{b}" for a, k, b in found]
                base = ",".join(s for s, (_, k, _) in zip(names, found) if k < BASE)
                rows.append((*[sum(x[1] == k for x in found) for k in range(BASE)], hashlib.sha256(base.encode()).hexdigest(), ",".join(names)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64()] * BASE + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return in_arrow(id_and_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_rows(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced by their kind in brackets, and n_chars, if there, made to fit. Null texts stay null."""
    shared, names = _scanner(docs.sparkSession), docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            columns = list(batch.columns)
            texts = [t if t is None else scanner.redacted(t) for t in (x.as_py() for x in columns[at].cast(pa.binary()))]
            changed = [t is not None and t != old.as_py() for t, old in zip(texts, columns[at].cast(pa.binary()))]
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
            if size is not None:
                columns[size] = pa.array([len(t.decode()) if new else old for t, new, old in zip(texts, changed, columns[size].to_pylist())], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(docs, run, docs.schema)
