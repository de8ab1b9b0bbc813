"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Two fingerprints that differ in at most two bits touch at most two of four 16-bit blocks, so at least two blocks are
equal: each distinct fingerprint goes to six shards, one for each pair of blocks, and any link shows in a shard. A
shard's BK-tree is built in the task that holds the shard (a tree of all fingerprints would grow with the corpus, so
it isn't broadcast); a search follows only child edges whose distance lies within the radius. Shards above
SHARD_LIMIT are dealt anew by the part of the other 32 bits that must also be equal (three parts, two differences),
and those that are still above it by a part of what is left, which bounds a shard by 2**15 distinct fingerprints
whatever the corpus. From a shard come links to the least member of a local group, never all its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows and copies
share a fingerprint; a null doc_id is kept, and never is a component's id unless it is alone there; no
rows give no rows. Texts are read whole, in memory by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, in_arrow, join_apart, materialise, small_side
from .components import components

RADIUS = 2
SHARD_LIMIT = 4096


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """64 bits, as a signed integer: a bit is set if it is in over half the hashes of the word shingles."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # of bytes: A-Z only, and the six white space bytes
    if not words:
        return 0
    if len(words) < shingle_words:
        hashes = xxh64_digest(b" ".join(words), seed)
        return int.from_bytes(hashes, "big", signed=True)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    total, n = np.zeros(64, np.int64), len(words) - shingle_words + 1
    hashes = b"".join([xxh64_digest(s, seed) for s in shingles])
    for at in range(0, len(hashes), 8 << 16):
        block = np.frombuffer(hashes[at : at + (8 << 16)], np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py() or b"", shingle_words, seed) for t in texts], pa.int64())], ["doc_id", "fp"])

    return in_arrow(id_and_text(docs), run, "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree of 64-bit values under Hamming distance; each value once."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add_and_find(self, x: int, radius: int) -> list[int]:
        """Adds x; returns the values added before it within the radius."""
        if self.root is None:
            self.root = [x, {}]
            return []
        found, stack, node = [], [self.root], self.root
        while stack:
            value, children = stack.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        while d := (node[0] ^ x).bit_count():
            if (child := node[1].get(d)) is None:
                node[1][d] = [x, {}]
                break
            node = child
        return found


def _shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the same values as all pairs within the radius do: each value to the root of its group."""
    tree, up = BKTree(), {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x in values:
        up[x] = x
        for y in tree.add_and_find(x, radius):
            if (a := top(x)) != (b := top(y)):
                up[max(a, b)] = min(a, b)
    for x in up:
        if (root := top(x)) != x:
            yield x, root


#: Widths of the parts that the free bits of a large shard are cut into, first of the 32 beside its key, then of the 21 or 22 left.
PARTS = ((11, 11, 10), (8, 7, 7))


def _without(rest: Column, widths: tuple[int, int, int], part: int) -> tuple[Column, Column]:
    """One part of the bits in rest, and the bits of the other two."""
    _, b, c = widths
    bits = lambda shift, width: F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << width) - 1))
    high, middle, low = bits(b + c, 20), bits(c, b), bits(0, c)
    return ((high, bits(0, b + c)), (middle, high * (1 << c) + low), (low, F.shiftrightunsigned(rest, c)))[part]


def links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp whose components are those of all pairs within the radius (2 at most)."""
    if radius > 2:
        raise ValueError("four blocks find no more than two differing bits")
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    made = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        m, n = (x for x in range(4) if x not in (i, j))
        made.append(F.struct(F.xxhash64(F.lit(k), block[i], block[j]).alias("shard"), (block[m] * 65536 + block[n]).alias("rest")))
    pending, ready = fps.select("fp", F.explode(F.array(*made)).alias("s")).select("fp", "s.shard", "s.rest"), None
    for level in range(len(PARTS) + 1):
        pending = materialise(pending) if level else pending
        size = pending.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        held = join_apart(pending, size, "shard")
        last = level == len(PARTS) or not size.where(F.col("n") > shard_limit).limit(1).count()
        small = (held if last else held.where(F.col("n") <= shard_limit)).select("shard", "fp")
        ready = small if ready is None else ready.union(small)
        if last:
            break
        parts = [_without(F.col("rest"), PARTS[level], i) for i in range(3)]
        deeper = F.explode(F.array(*[F.struct(F.xxhash64("shard", F.lit(i), part).alias("shard"), rest.alias("rest")) for i, (part, rest) in enumerate(parts)])).alias("s")
        pending = held.where(F.col("n") > shard_limit).select("fp", deeper).select("fp", "s.shard", "s.rest")
    shards = ready.repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, values = None, []

        def out(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        mask, ready = (1 << 64) - 1, []

        def close():
            sign = lambda x: x - (1 << 64) if x >> 63 else x
            ready.extend((sign(a), sign(b)) for a, b in _shard_links(values, radius))

        for batch in batches:
            for key, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held_key:
                    if len(values) > 1:
                        close()
                    held_key, values = key, []
                values.append(fp & mask)
            if ready:
                yield out(ready)
                ready.clear()
        if len(values) > 1:
            close()
        if ready:
            yield out(ready)

    return in_arrow(shards, run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = 3, seed: int = 42, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id reachable): a row for each document."""
    prints = materialise(fingerprints(docs, shingle_words, seed))
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), radius, shard_limit))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = join_apart(named, ids, "root").select("fp", "component_id")  # a root may have a third of all fingerprints
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str):
    """The signed long column as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- documents alike by a share of their shingles ----------------------------------------------------------------

WIDTH = 256
#: Orders of all shingles: by the first in each of KEYS of them documents are dealt into shards; DEEPER more for each of LEVELS deal large shards anew.
KEYS = 8
DEEPER = 3
LEVELS = 3
ORDERS = KEYS + DEEPER * LEVELS
#: How often a group of several blocks is dealt into them at random, before its parts are compared with the rest.
DEALS = 2
BLOCK_LIMIT = 1024
BLOCK_SHINGLES = 2_000_000
#: Rows (of four narrow columns) up to which what says which texts to compare may be broadcast: some 40 MB.
MEMBER_ROWS = 400_000
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(ORDERS + WIDTH // 64)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * _MULTIPLIERS[k]
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def shingle_set(text: bytes, shingle_words: int = 5) -> np.ndarray:
    """The hashes of the distinct word shingles, ascending. Texts of fewer words are one shingle; one without words has none."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    n = max(1, len(words) - shingle_words + 1) if words else 0
    return np.unique(np.frombuffer(b"".join([xxh64_digest(b" ".join(words[i : i + shingle_words])) for i in range(n)]), np.uint64))


def sketch(text: bytes, shingle_words: int = 5) -> tuple[bytes, list[int]]:
    """A 256-bit SimHash of the set of word shingles, and for each of ORDERS orders of all shingles the first one there is.

    A text without words has a fingerprint of zeros and zero for keys.
    """
    return _sketch_of(shingle_set(text, shingle_words))


def _sketch_of(h: np.ndarray) -> tuple[bytes, list[int]]:
    if not len(h):
        return bytes(WIDTH // 8), [0] * ORDERS
    keys = [int(h[_mixed(h, k).argmin()].view(np.int64)) for k in range(ORDERS)]
    total = np.zeros(WIDTH, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        bits = np.stack([_mixed(part, ORDERS + k) for k in range(WIDTH // 64)], axis=1).view(np.uint8)
        total += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(h)).tobytes(), keys


def radius_for(similarity: float) -> int:
    """How many of WIDTH bits two sets of that Jaccard similarity differ in at most: the mean, and seven standard deviations on top.

    Seven, as in sets of four and five shingles a bit differs more often than the angle says (3 of 16, not 2.4).
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(WIDTH * p + 7 * (WIDTH * p * (1 - p)) ** 0.5)


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) >= similarity


def _near(bits: np.ndarray, size: np.ndarray, own_bits: np.ndarray, own_size: int, similarity: float, radius: int) -> np.ndarray:
    """Places whose sketches are within the radius and whose sets aren't too short or long, the nearest first."""
    apart = np.bitwise_count(bits ^ own_bits).sum(axis=1, dtype=np.int64)
    shorter = np.minimum(size, own_size) / np.maximum(1, np.maximum(size, own_size))
    near = np.flatnonzero((apart <= radius) & (shorter >= similarity))
    return near[np.argsort(apart[near], kind="stable")]


def _verified(bits: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of places whose sets have that Jaccard similarity; their components are those of all such pairs within the radius."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    for x in range(1, len(sets)):
        near = _near(bits[:x], size[:x], bits[x], size[x], similarity, radius)
        while len(near):
            y, near = near[0], near[1:]
            if _similar(sets[x], sets[y], similarity):
                yield x, int(y)
                label[label == label[x]] = label[y]
                near = near[label[near] != label[x]]


class _Few:
    """The documents of one block that other documents are compared with, one after the other."""

    def __init__(self, similarity: float, radius: int) -> None:
        self.similarity, self.radius = similarity, radius
        self.reps: list[int] = []
        self.labels: list[int] = []
        self.sets: list[np.ndarray] = []
        self.prints: list[bytes] = []
        self.up: dict[int, int] = {}
        self.made: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, rep: int, label: int, fp: bytes, shingles: bytes) -> None:
        self.reps.append(rep)
        self.labels.append(label)
        self.prints.append(fp)
        self.sets.append(np.frombuffer(shingles, np.uint64))

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def links(self, rep: int, label: int, fp: bytes, shingles: bytes) -> Iterator[tuple[int, int]]:
        """Links of one more document to those of the block that nothing joins it to yet."""
        if self.made is None:
            self.made = np.frombuffer(b"".join(self.prints), np.uint64).reshape(-1, WIDTH // 64), np.array([len(x) for x in self.sets])
        own = np.frombuffer(shingles, np.uint64)
        for y in _near(*self.made, np.frombuffer(fp, np.uint64), len(own), self.similarity, self.radius).tolist():
            a, b = self.top(label), self.top(self.labels[y])
            if a != b and _similar(own, self.sets[y], self.similarity):
                self.up[max(a, b)] = min(a, b)
                yield rep, self.reps[y]


def _rare_pairs(sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b) of a group's documents under different labels that may have that similarity. sets: rep, group, label, fp, shingles.

    Two sets of that similarity share one of the first n - ceil(similarity n) + 1 shingles of each in any order of all;
    here the order is from the rarest in the group on. Shingles that only one document has come first and join nothing, so
    documents that share a template but are mostly their own words have no pair. Of what is left, lengths and sketches are compared.
    """

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shingles in enumerate(batch.column(3)):
                h = np.frombuffer(shingles.as_py(), np.int64)
                for at in range(0, len(h), 1 << 16):
                    part = h[at : at + (1 << 16)]
                    same = [pa.repeat(batch.column(c)[k], len(part)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part), pa.repeat(pa.scalar(len(h), pa.int64()), len(part))], ["rep", "group", "label", "shingle", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.int64).reshape(-1, WIDTH // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i]) for i in range(WIDTH // 64))], ["rep", *_BITS])

    every = in_arrow(sets.select("rep", "group", "label", "shingles"), taken_apart, "rep long, group long, label long, shingle long, n long")
    every = every.select("rep", "label", "n", F.xxhash64("group", "shingle").alias("key"))
    counts = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = join_apart(every, counts, "key")
    own = Window.partitionBy("rep")  # a document's shingles
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    rare = shared.withColumn("lone", F.col("n") - F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("c", "key")))
    rare = rare.where(F.col("place") <= first - F.col("lone")).select("rep", "label", "n", "key")
    printed = in_arrow(sets.select("rep", "fp"), bits, "rep long, " + ", ".join(f"{b} long" for b in _BITS))
    rare = materialise(rare.join(printed, "rep"))
    a, b = rare.alias("a"), rare.alias("b")
    apart = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in _BITS), F.lit(0))
    shorter, longer = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.label") != F.col("b.label")) & (shorter >= similarity * longer - 1e-9) & (apart <= radius)
    return a.join(b, met).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


_BITS = [f"f{i}" for i in range(WIDTH // 64)]


def alike(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, shard_limit: int = SHARD_LIMIT, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """doc_id, component_id: near copies by shingle similarity; component_id is the smallest doc_id reachable.

    Two documents are linked if the Jaccard similarity of their sets of shingles is `similarity` or more; it is taken
    from the sets themselves. Sketches only say which pairs to look at: those that differ in radius_for(similarity) bits
    at most and stand in a common shard. One of eight shards of a document is that of the first of its shingles in an
    order of all (two documents share it with their similarity as probability, so at 0.8 all eight fail once in 400,000
    pairs). A shard above the limit, as a shingle of many unlike documents makes it, is dealt anew by three further
    orders, LEVELS times at most; that loses a pair at 0.8 that is in it once in 125 times a level, so that even if all
    shards of a pair are split three times, it is missed once in 180,000. What is then still together in a large shard
    is joined without a tree, as what to look at.

    What sketches join is a group. A group of one block is compared in one task. A larger one is dealt into blocks at
    random, DEALS times, and compared block by block, which joins what is alike throughout. What then isn't in its largest
    part is compared with all of it, block by block, if it is one block; if it is more, the group was held together by what
    unlike documents share (a page template), and those are compared that share one of their rarest shingles (_rare_pairs).
    So a group costs what it has rows, not pairs, whether its members are copies or not.
    A null doc_id has a null component and no links; rows that share a doc_id are one document.
    """

    def digest(h: np.ndarray) -> bytes:
        from xxhash import xxh3_128_digest

        return xxh3_128_digest(h.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1).cast(pa.binary()):
                h = shingle_set(t.as_py() or b"", shingle_words)
                found.append((digest(h), *_sketch_of(h), len(h)))
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], ["doc_id", "same", "fp", "keys", "shingles"])

    prints = materialise(in_arrow(id_and_text(docs), run, "doc_id long, same binary, fp binary, keys array<long>, shingles long"))
    # one row for each set of copies (equal sets of shingles), named by its smallest doc_id
    firsts = [F.min(x).alias(x) for x in ("fp", "keys", "shingles")]
    reps = materialise(prints.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep"), *firsts))
    order = lambda ks: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get("keys", F.lit(k)).alias("key")) for k in ks])).alias("s")
    pending = reps.select("rep", "fp", order(range(KEYS))).select("rep", "fp", F.xxhash64("s.k", "s.key").alias("shard"))
    radius, ready, joined = radius_for(similarity), None, None
    for level in range(LEVELS + 1):
        pending = materialise(pending) if level else pending
        size = pending.groupBy("shard").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
        held = join_apart(pending, size, "shard")
        part = held.where(F.col("n") <= shard_limit).select("shard", "rep", "fp")
        ready = part if ready is None else ready.union(part)
        if not size.where(F.col("n") > shard_limit).limit(1).count():
            break
        large = held.where(F.col("n") > shard_limit)
        if level == LEVELS:
            joined = large.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
            break
        again = order(range(KEYS + DEEPER * level, KEYS + DEEPER * (level + 1)))
        keyed = large.select("rep", "fp", "shard").join(reps.select("rep", "keys"), "rep")  # keys travel with rows of large shards only
        pending = keyed.select("rep", "fp", "shard", again).select("rep", "fp", F.xxhash64("shard", "s.k", "s.key").alias("shard"))
    dealt = ready.repartition("shard").sortWithinPartitions("shard", "rep")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, values, found = None, {}, []

        def close() -> None:
            if len(values) > 1:
                found.extend((values[a], values[b]) for a, b in _shard_links(list(values), radius))

        for batch in batches:
            for shard, rep, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != held_shard:
                    close()
                    held_shard, values = shard, {}
                if (first := values.setdefault(int.from_bytes(fp, "big"), rep)) != rep:
                    found.append((first, rep))  # unlike sets, the same sketch
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    # what sketches join, each with the number of its group's blocks; BLOCK_SHINGLES bounds a task's memory where documents are long
    found = in_arrow(dealt, trees, "a long, b long")
    joined = components(found if joined is None else found.union(joined))
    grouped = materialise(reps.join(joined, F.col("rep") == F.col("node"), "left").select("rep", "same", "shingles", F.coalesce("root", "rep").alias("group")))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block_limit), F.sum("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1").drop("n")
    members = materialise(join_apart(grouped, sizes, "group").select("rep", "same", "group", "blocks", "shingles"))

    def with_sets(some: DataFrame) -> DataFrame:
        """rep, group, fp, shingles and what else is in some (rep, same, group, more), from the texts."""
        more = [c for c in some.columns if c not in ("rep", "same", "group")]

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for k, (text, same) in enumerate(zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist())):
                    h = shingle_set(text.as_py() or b"", shingle_words)
                    if digest(h) == same:  # not another text with the same doc_id
                        rows.append((k, _sketch_of(h)[0], h.tobytes()))
                kept = batch.take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns[2:], *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["rep", "group", *more, "fp", "shingles"])

        texts = id_and_text(docs).join(small_side(some, MEMBER_ROWS), F.col("doc_id") == F.col("rep")).select("text", "same", "rep", "group", *more)
        schema = ", ".join(f"{n} {t}" for n, t in texts.select("rep", "group", *more).dtypes)
        return in_arrow(texts, sets, f"{schema}, fp binary, shingles binary")

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_task, values = None, {}

        def close() -> pa.RecordBatch:
            reps, arrays = [k[0] for k in values], [np.frombuffer(k[1], np.uint64) for k in values]
            bits = np.frombuffer(b"".join(values.values()), np.uint64).reshape(-1, WIDTH // 64)
            return out([(reps[x], reps[y]) for x, y in _verified(bits, arrays, similarity, radius)])

        for batch in batches:
            for *task, rep, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if task != held_task:
                    yield close()
                    held_task, values = task, {}
                values[rep, shingles] = fp
        yield close()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_task, few = None, _Few(similarity, radius)
        for batch in batches:
            found = []
            for *task, other, rep, label, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if task != held_task:
                    held_task, few = task, _Few(similarity, radius)
                if not other:
                    few.add(rep, label, fp, shingles)
                elif few.reps:
                    found += few.links(rep, label, fp, shingles)
            yield out(found)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            yield out([(x, y) for x, y, p, q in zip(rows["a"], rows["b"], rows["a_set"], rows["b_set"]) if _similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity)])

    block = lambda n, *salt: F.pmod(F.xxhash64("rep", *map(F.lit, salt)), n).cast("int")
    deals = F.explode(F.when(F.col("blocks") > 1, F.array(*map(F.lit, range(DEALS)))).otherwise(F.array(F.lit(0)))).alias("deal")
    first = with_sets(members.select("rep", "same", "group", "blocks")).select("group", "blocks", deals, "rep", "fp", "shingles")
    first = first.select("group", "deal", F.pmod(F.xxhash64("rep", "deal"), F.col("blocks")).cast("int").alias("i"), "rep", "fp", "shingles")
    inner = materialise(in_arrow(first.repartition("group", "deal", "i").sortWithinPartitions("group", "deal", "i", "rep"), within, "a long, b long"))
    if members.where("blocks > 1").limit(1).count():
        named = members.where("blocks > 1").join(components(inner), F.col("rep") == F.col("node"), "left").select("rep", "same", "group", "blocks", "shingles", F.coalesce("root", "rep").alias("label"))
        named = materialise(named)
        main = named.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        apart = materialise(join_apart(named, main, "group").withColumn("lone", F.col("label") != F.col("main")))
        few = apart.where("lone").groupBy("group").agg(F.ceil(F.greatest(F.count("*") / F.lit(block_limit), F.sum("shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("few"))
        few = materialise(few)
        rest = with_sets(join_apart(apart, few.where("few = 1"), "group").select("rep", "same", "group", "blocks", "few", "label", "lone"))
        place = lambda i, j, other: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(other).alias("other"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_few = F.transform(F.when(F.col("lone"), upto("blocks")).otherwise(F.array().cast("array<int>")), lambda j: place(block(F.col("few"), 7), j, False))
        as_other = F.transform(upto("few"), lambda i: place(i, block(F.col("blocks"), 8), True))
        tasks = rest.select("group", F.explode(F.concat(as_few, as_other)).alias("t"), "rep", "label", "fp", "shingles").select("group", "t.*", "rep", "label", "fp", "shingles")
        tasks = tasks.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "other", "rep")
        inner = inner.union(materialise(in_arrow(tasks, across, "a long, b long")))
        if few.where("few > 1").limit(1).count():
            sets = materialise(with_sets(join_apart(apart, few.where("few > 1"), "group").select("rep", "same", "group", "label")))
            pairs = materialise(_rare_pairs(sets, similarity, radius))
            one = lambda name: sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"{name}_set"))
            inner = inner.union(materialise(in_arrow(pairs.join(one("a"), "a").join(one("b"), "b"), checked, "a long, b long")))
    roots = components(inner)
    named = reps.select("same", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("root", "rep").alias("component_id"))
    known = prints.where("doc_id IS NOT NULL").join(named, "same").select("doc_id", "component_id")
    return known.union(prints.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("component_id")))
