"""Target-distribution importance resampling: documents are drawn as if the corpus had the n-grams of a target text.

Features of a text are all runs of 1 to `most` consecutive words (lower-cased ASCII letters and digits, non-ASCII bytes),
hashed into `buckets`. A bucket's gain is the log of its smoothed share in the target over its share in the corpus, in
thousandths; a document's weight is the floored mean gain of its features, and its score that weight plus Gumbel noise
hashed from its doc_id. The highest scores among the documents with `least` words or more are drawn.

Word-id suffix arrays: a task numbers the words of its batch, and sorts the suffixes of the number sequence (each document
ends in a number of its own) by prefix doubling as deep as the longest feature. Neighbours in that order with a common prefix
of n words or more are one run, and a run is one repeated n-gram: its bytes are hashed once, and the bucket goes back to
all places where the run's suffixes start. The buckets of each document are written, and read for counting and scoring.

What is gathered: `buckets` gains. Places are given by a two-level scan, so no task sees all scores.

Defined results: null and empty texts have no features, weight 0 and are never drawn; a null doc_id is hashed as an
empty string and stands behind all others among equal scores; repeated rows are documents of their own, ties of equal
score and doc_id in any order; texts are read whole, memory follows the batch or the longest text; an empty target or
corpus counts 0 in every bucket; no documents give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import scan
from .common import id_and_text, in_arrow, materialise

BUCKETS = 10_000
MOST = 1
LEAST = 20
PERCENT = 10
SEED = 2024
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` numbers or more, by prefix doubling. Numbers from 0."""
    order = np.argsort(ids, kind="stable")
    known, rank = 1, ids
    while known < depth:
        ahead = np.full(len(ids), -1, np.int64)
        ahead[: len(ids) - known] = rank[known:]
        order = np.lexsort((ahead, rank))
        new = np.ones(len(ids), np.int64)
        new[0] = 0
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])
        rank = np.empty(len(ids), np.int64)
        rank[order], known = np.cumsum(new), 2 * known
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many numbers each suffix shares with the one before it in order, `depth` at most; the first shares none."""
    shared, alike = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate([ids, np.full(depth, -1, np.int64)])
    for k in range(depth):
        alike = alike & (padded[order[1:] + k] == padded[order[:-1] + k]) & (padded[order[1:] + k] >= 0)
        shared[1:] += alike
    return shared


def bucket_lists(texts: list[bytes], most: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words each text has, and the buckets of its features by length of feature, then place."""
    numbers: dict[bytes, int] = {}
    found = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    if not sizes.sum():
        return sizes, [np.empty(0, np.int64) for _ in texts]
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for start, words in zip(starts, found):
        ids[start : start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    ids[starts + sizes] = len(numbers) + np.arange(len(texts))  # ends: never equal to anything
    spelled = list(numbers)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(ids))  # words from here to the document's end
    order = suffix_array(ids, most)
    shared = common_prefixes(ids, order, most)
    lists = []
    for n in range(1, most + 1):
        runs = np.cumsum(shared < n) - 1
        heads = order[shared < n]
        hashes = np.array([zlib.crc32(b" ".join([spelled[k] for k in ids[h : h + n]])) % buckets if left[h] >= n else -1 for h in heads.tolist()], np.int64)
        at = np.empty(len(ids), np.int64)
        at[order] = hashes[runs]
        lists.append(at)
    return sizes, [np.concatenate([at[s : s + max(0, k - n)] for n, at in enumerate(lists)]) for s, k in zip(starts.tolist(), sizes.tolist())]


def features(docs: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, features (buckets, repeats included): a row for each document. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lists = bucket_lists([t.as_py() or b"" for t in batch.column(1)], most, buckets)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_words", "features"])

    return in_arrow(docs.select("doc_id", F.col("text").cast("binary")), run, "doc_id long, n_words long, features array<int>")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, one array `gains`: for each bucket floor(1000 ln(its share in the target over its share in the corpus)), add-one smoothed."""
    count = lambda some, name: some.select(F.explode("features").alias("b")).groupBy("b").agg(F.count("*").alias(name))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))  # a row a bucket, here and below
    full = every.join(F.broadcast(count(corpus, "s")), "b", "left").join(F.broadcast(count(target, "t")), "b", "left").fillna(0)
    array = F.sort_array(F.collect_list(F.struct("b", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))))
    total = full.agg(array.alias("x"), F.sum("s").cast("double").alias("ns"), F.sum("t").cast("double").alias("nt"))
    share = lambda x: ((x["t"] + 1) * (F.col("ns") + buckets)) / ((x["s"] + 1) * (F.col("nt") + buckets))
    return total.select(F.transform("x", lambda x: F.floor(1000 * F.log(share(x)))).alias("gains"))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each document; rank from 1 for those drawn, null for the others. target: text."""
    found = materialise(features(id_and_text(docs), most, buckets))
    aimed = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), most, buckets)
    table = materialise(gains(found, aimed, buckets))  # one row
    n = F.size("features").cast("long")
    held = found.withColumn("gains", table.scalar())  # a task holds the array once, no row carries it
    total = F.aggregate("features", F.lit(0).cast("long"), lambda acc, b: acc + F.get(F.col("gains"), b))
    summed = held.select("doc_id", "n_words", n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.col("total") - F.pmod("total", "n_features"), F.col("n_features")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = summed.select("doc_id", "n_features", weight.alias("weight"), (F.col("n_words") >= least).alias("_in"), noise.alias("_noise")).withColumn("score", F.col("weight") + F.col("_noise")).drop("_noise")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that all sizes take the two-level scan
    placed = scan(scored, [], [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id")], place="_place", ranges=ranges)
    drawn = materialise(scored.agg(F.call_function("div", F.lit(percent) * F.count_if("_in"), F.lit(100)).alias("k"))).scalar()
    rank = F.when(F.col("_in") & (F.col("_place") < drawn), F.col("_place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


#: For runs of one word, in DuckDB: crc32 by its polynomial, a byte at a time, for each distinct word.
SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS "text" FROM documents),
aims AS (SELECT translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS "text" FROM benchmark),
words AS (SELECT k, unnest(regexp_extract_all("text", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
aimed AS (SELECT unnest(regexp_extract_all("text", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM aims),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM aimed)),
step AS (SELECT w, h, 0 AS i, 4294967295::BIGINT AS c FROM spelled
    UNION ALL SELECT w, h, i + 1, list_reduce(list_concat([xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)], range(8)::BIGINT[]),
        lambda acc, x: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) FROM step WHERE 2 * i < length(h)),
hashed AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM step WHERE 2 * i = length(h)),
own AS (SELECT k, b FROM words JOIN hashed USING (w)),
s AS (SELECT b, count(*) AS s FROM own GROUP BY b),
t AS (SELECT b, count(*) AS t FROM aimed JOIN hashed USING (w) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT range AS b FROM range(10000)) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weighed AS (SELECT k, count(*) AS n, sum(gain)::BIGINT AS total FROM own JOIN gains USING (b) GROUP BY k),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN weighed USING (k)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM noisy)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
    CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM ranked WHERE n_features >= 20) THEN place END AS rank FROM ranked
"""
