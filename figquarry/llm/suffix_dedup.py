"""Removal of repeated byte strings by suffix sorting, bucket by bucket, with difference-cover sample ranks.

A position starts a repeated string if its next `length` bytes also start elsewhere. All suffixes that share these
bytes share the least hashed 32-byte run within them, the anchor, at the same distance. So suffixes are put into
buckets by (anchor, distance), and:

1. Each text is cut into runs of positions with a common anchor; a run is one row of two hashes, not its bytes. Of equal
   texts in a task only the first two are cut up: two are enough to tell that all of them repeats.
2. Anchors that occur once are dropped: nothing in their buckets can repeat. Runs with equal hashes repeat whole.
3. One run of each other class is fetched with its bytes. Blocks of whole buckets, bounded in size, are laid out with
   anchors in one column and sorted a bucket (a column) at a time: suffixes are compared by the bytes up to the next
   column of a difference cover modulo COVER, then by the ranks of that column's suffixes, which were computed before,
   each from the next. However long the ties, a comparison reads at most a few bytes and a rank.
4. A bucket of more than `hot` classes is split by a deeper prefix before it is sorted: its starts are dealt into ranges
   of columns, and a range by all the bytes that strings starting in it have in common. Ranges get narrower until
   the buckets fit; at one column, the bytes are the whole string, and a bucket may be sorted in parts.
5. Texts are joined with their repeated positions; bytes are removed and what is left is hashed.

Texts are told apart by 128 bits of a hash.

Defined results: null texts are empty; texts below `length` bytes stay whole; a repeated row is a copy, so both lose
everything (if long enough); rows may share a doc_id, and a null one is kept; no rows give no
rows. Very long texts are taken apart a window at a time; only the text itself is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, in_arrow, materialise, small_side

LENGTH = 200
ANCHOR = 32
COVER = 31
BLOCK = 8192
HOT = 32_768
#: Into how many ranges of columns the starts of a hot bucket are dealt, step by step; the last step makes ranges of one column.
RANGES = (4, 16, None)
CHUNK = 1 << 20
#: Texts whose hashes a task keeps to tell copies.
KNOWN_TEXTS = 400_000
_PLACE = np.uint64((1 << 24) - 1)
#: place: start, number of starts (16 bits) and distance to the anchor (16 bits) of a run.
RUNS = "anchor long, run long, doc_id long, k1 long, k2 long, place long"
#: bucket: the anchor, or what a split made of it; at: the first start of this part of the run, counted from the run's.
CLASSES = "bucket long, anchor long, run long, at int, copies long, n int, distance int, body binary"
RESULTS = "anchor long, run long, at int, n int, bits binary"


def difference_cover(v: int) -> set[int]:
    """A set of residues modulo v whose differences are all residues, grown by whichever residue adds most."""
    cover: set[int] = {0}
    differences = lambda c: {(a - b) % v for a in c for b in c}
    while len(differences(cover)) < v:
        cover.add(max((x for x in range(v) if x not in cover), key=lambda x: (len(differences(cover | {x})), -x)))
    return cover


def runs(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, number of starts, distance from it to the anchor, anchor's hash) of runs of starts, chunk by chunk."""
    for at in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, CHUNK + length - 1), at)
        h, power, size = part.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
        while size < anchor:  # a power of two
            h = h[:-size] * np.uint64(power) + h[size:]
            power, size = power * power % (1 << 64), size * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least, width, size = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - anchor + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        yield first + at, np.diff(np.append(first, len(place))), place[first] - first, h[place[first]].view(np.int64)


def _key(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_digest

    names = [f.split(" ")[0] for f in RUNS.split(", ")]

    def out(parts):
        anchor, run, doc, k1, k2, place, null = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run), pa.array(doc, mask=null), pa.array(k1), pa.array(k2), pa.array(place)], names)

    known: dict[tuple[int, int], bool] = {}
    for batch in batches:
        parts, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data = text.as_py() or b""
            if len(data) < length:
                continue
            key = _key(data)
            if known.get(key):
                continue  # two of these have been cut up
            if len(known) > KNOWN_TEXTS:
                known.clear()
            known[key] = key in known
            for start, n, distance, h in runs(data, length):
                digests = [xxh64_digest(data[s:e], o) for s, e, o in zip(start.tolist(), (start + n + length - 1).tolist(), distance.tolist())]
                k = len(start)
                place = (start.astype(np.int64) << 32) | (n.astype(np.int64) << 16) | distance.astype(np.int64)
                parts.append((h, np.frombuffer(b"".join(digests), np.int64), np.full(k, doc or 0), np.full(k, key[0]), np.full(k, key[1]), place, np.full(k, doc is None)))
                held += k
            if held > 100_000:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)


def _packed(x: np.ndarray) -> list[np.ndarray]:
    """The columns of a byte matrix as big-endian words, the last first (as np.lexsort takes keys)."""
    more = -x.shape[1] % 8
    words = np.ascontiguousarray(np.pad(x, ((0, 0), (0, more)))).view(">u8").astype(np.uint64)
    return [words[:, i] for i in range(words.shape[1] - 1, -1, -1)]


def _changes(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before it in order; the first place doesn't count."""
    out = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        out[1:] |= s[1:] != s[:-1]
    return out


def repeated_starts(x: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, cover: int = COVER) -> np.ndarray:
    """Which starts of a block repeat. x: a row of bytes for each run, anchors in one column; bucket: the rows' anchors;
    low, high: the first and last column of a row that are starts. Returns flags by row and column."""
    last = int(high.max(initial=0))
    residues = difference_cover(cover)
    samples = [q for q in range(last + cover) if q % cover in residues]
    samples = samples[: next((i for i, q in enumerate(samples) if q >= last), len(samples)) + 1]
    flags = np.zeros((len(x), last + 1), bool)
    x = np.pad(x, ((0, 0), (0, max(0, samples[-1] + length - x.shape[1]))))
    rank, after = np.zeros(len(x), np.int64), samples[-1] + length
    for i in range(len(samples) - 1, -1, -1):
        q = samples[i]
        keys = [rank, *_packed(x[:, q:after])]
        order = np.lexsort(keys)
        rank = np.empty(len(x), np.int64)
        rank[order] = np.cumsum(_changes(keys, order))
        sorted_rows = x[order, q : q + length]
        differ = sorted_rows[1:] != sorted_rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        for c in range(samples[i - 1] + 1 if i else 0, min(q, last) + 1):
            rows = np.flatnonzero((low <= c) & (c <= high))
            if len(rows) < 2:
                continue
            same = np.zeros(len(x), np.int64)
            same[order[1:]] = np.cumsum(common < length - (q - c))
            keys = [same[rows], *(_packed(x[rows, c:q]) if q > c else []), bucket[rows]]
            at = np.lexsort(keys)
            new = _changes(keys, at)
            new[0] = True
            alone = new & np.append(new[1:], True)
            flags[rows[at[~alone]], c] = True
        after = q
    return flags


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int, block: int, divisible: bool) -> Iterator[pa.RecordBatch]:
    """Rows of CLASSES, in order of bucket, anchor, run and at, to RESULTS. divisible: all strings of a bucket's column are one,
    so that a bucket may be sorted in parts that share a row."""
    widest = length - ANCHOR

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        buckets, anchors, names, ats, copies, n, distance, bodies = zip(*rows)
        x = np.zeros((len(rows), widest + length), np.uint8)
        for row, o, body in zip(x, distance, bodies):
            row[widest - o : widest - o + len(body)] = np.frombuffer(body, np.uint8)
        low = widest - np.array(distance)
        flags = repeated_starts(x, np.array(buckets), low, low + np.array(n) - 1, length)
        found = []
        for k, (a, r, at, m) in enumerate(zip(anchors, names, ats, copies)):
            own = flags[k, low[k] : low[k] + n[k]] | (m > 1)
            if own.any():
                found.append((a, r, at, n[k], np.packbits(own).tobytes()))
        return _arrow(found, RESULTS)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[1:4] == held[-1][1:4]:
                continue  # fetched from two rows with equal text
            if len(held) >= block and (divisible or row[0] != held[-1][0]):
                yield solve(held)
                held = [held[-1]] if row[0] == held[-1][0] else []
            held.append(row)
    if held:
        yield solve(held)


def _split(batches: Iterator[pa.RecordBatch], length: int, ranges: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of CLASSES to the parts of their runs that lie in one range of columns each; a part's bucket is the hash of the
    bytes that all strings starting in the range have in common."""
    from xxhash import xxh64_digest

    widest = length - ANCHOR
    width = 1 if ranges is None else -(-(widest + 1) // ranges)
    for batch in batches:
        rows = []
        for _, anchor, run, at, copies, n, distance, body in zip(*(c.to_pylist() for c in batch.columns)):
            low = widest - distance  # the column of the first start, and so of the body's first byte
            for k in range(low // width, (low + n - 1) // width + 1):
                first, last = max(low, k * width), min(low + n, (k + 1) * width) - 1
                common = body[min((k + 1) * width - 1, widest) - low : k * width + length - low]
                bucket = int.from_bytes(xxh64_digest(common, k), "big", signed=True)
                rows.append((bucket, anchor, run, at + first - low, copies, last - first + 1, widest - first, body[first - low : last - low + length]))
        yield _arrow(rows, CLASSES)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and body; the keys tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            keys = [_key(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), texts], ["doc_id", "k1", "k2", "body"])

    return in_arrow(id_and_text(docs), run, "doc_id long, k1 long, k2 long, body binary")


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts with the classes they stand for, to CLASSES. Of rows with equal text that come one after the other the first is read."""
    before = None
    for batch in batches:
        rows = []
        for body, wanted in zip(batch.column(0), batch.column(1)):
            found = wanted.as_py()
            if (found[0]["anchor"], found[0]["run"]) == before:
                continue
            before, data = (found[0]["anchor"], found[0]["run"]), body.as_py()
            for w in found:
                start, n, distance = w["place"] >> 32, (w["place"] >> 16) & 0xFFFF, w["place"] & 0xFFFF
                rows.append((w["anchor"], w["anchor"], w["run"], 0, w["copies"], n, distance, data[start : start + n + length - 1]))
        yield _arrow(rows, CLASSES)


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, found in zip(batch.column(1), batch.column(2)):
            data, hits = body.as_py() or b"", found.as_py()
            n = len(data)
            cover = np.zeros(n + 1, np.int64)
            if hits:
                starts = np.zeros(n, bool)
                for h in hits:
                    s, k = h["start"], h["n"]
                    starts[s : s + k] |= True if h["bits"] is None else np.unpackbits(np.frombuffer(h["bits"], np.uint8), count=k).astype(bool)
                at = np.flatnonzero(starts)
                cover[at] += 1
                cover[at + length] -= 1
            gone = np.cumsum(cover[:n]) > 0
            edges = np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1) if n else 0
            left = np.frombuffer(data, np.uint8)[~gone].tobytes() if edges else data
            rows.append((n, n - len(left), int(edges), hashlib.sha256(left).hexdigest()))
        rest = _arrow(rows, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], ["doc_id", *rest.schema.names])


def _results(classes: DataFrame, length: int, block: int, hot: int) -> DataFrame:
    """RESULTS for classes: buckets of more than `hot` of them are split until they fit, the others sorted."""
    order = ["bucket", "anchor", "run", "at"]
    out, pending = None, classes
    for step, ranges in enumerate([*RANGES, ...]):
        large = pending.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("bucket")
        last = ranges is ... or not large.limit(1).count()
        large = large if last else small_side(materialise(large))
        fit = pending if last else pending.join(large, "bucket", "left_anti")
        done = in_arrow(fit.repartition("bucket").sortWithinPartitions(*order), lambda b, d=ranges is ...: _sorted_blocks(b, length, block, d), RESULTS)
        out = done if out is None else out.union(done)
        if last:
            return out
        wide = pending.join(large, "bucket", "left_semi").select(*(f.split(" ")[0] for f in CLASSES.split(", ")))
        pending = materialise(in_arrow(wide, lambda b, r=ranges: _split(b, length, r), CLASSES))


def repeated_runs(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """k1, k2, start, n, bits: runs of positions of a text, bits telling which start repeated strings (null: all)."""
    members = materialise(in_arrow(id_and_text(docs), lambda b: _rows(b, length), RUNS))
    anchors = members.groupBy("anchor").agg(F.count("*").alias("c"), F.min("run").alias("lo"), F.max("run").alias("hi")).where("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("one"))
    # written first: the join then deals both sides out anew, so that Spark can split the members of a hot anchor
    again = materialise(members.join(materialise(anchors), "anchor"))
    mixed = again.where("NOT one")
    classes = mixed.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "k1", "k2", "place")).alias("m"))
    wanted = classes.select("m.doc_id", "m.k1", "m.k2", F.struct("anchor", "run", "copies", "m.place").alias("w")).groupBy("doc_id", "k1", "k2").agg(F.collect_list("w").alias("wanted"))
    bodies = _keyed(docs)
    same = bodies["doc_id"].eqNullSafe(wanted["doc_id"]) & (bodies["k1"] == wanted["k1"]) & (bodies["k2"] == wanted["k2"])
    fetched = materialise(in_arrow(bodies.join(wanted, same).select("body", "wanted"), lambda b: _fetch(b, length), CLASSES))
    # written as they are, so that the join's sides are dealt out for it alone, and Spark can split the members of a hot run
    results = materialise(_results(fetched, length, block, hot))
    start, n = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))
    whole = again.where("one").select("k1", "k2", start.alias("start"), n.cast("int").alias("n"), F.lit(None).cast("binary").alias("bits"))
    parts = mixed.select("anchor", "run", "k1", "k2", start.alias("first")).join(results, ["anchor", "run"])
    return whole.union(parts.select("k1", "k2", (F.col("first") + F.col("at")).alias("start"), "n", "bits"))


def dedup(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each document."""
    # dealt out once, by text: the same run of a text comes from two copies in each task at most
    each = repeated_runs(docs, length, block, hot).repartition("k1", "k2").groupBy("k1", "k2", "start", "n").agg(F.min("bits").alias("bits"))
    found = materialise(each.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "bits")).alias("found")))
    bodies = _keyed(docs)
    joined = bodies.join(found, ["k1", "k2"], "left").select("doc_id", "body", "found")
    return in_arrow(joined, lambda b: _removed(b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete a query's shuffle files when it ends: each stage here ends in a written table."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
