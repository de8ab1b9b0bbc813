"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio against a trusted target. DataFrame functions only.

Words and pairs of words (of their hashes) are hashed into `buckets`; a bucket's weight is the log of its smoothed share in the trusted
documents over its share in all documents. A document's ratio is the sum of its weights over its number of n-grams.
Trusted documents with an even crc32(doc_id as text) make the weights; the others, whose own words are no part of
them, give the threshold: the highest multiple of `step` that at most `lost` of those that pass the base rules lie
below. Only the weights (one array of `buckets` numbers) and the histogram of trusted ratios
are gathered; both are bounded whatever the corpus.

Repeated three-word windows are found per document by sorting 64-bit hashes of the windows with their positions.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged each for itself
and count as often as they stand there; labels that contradict each other count as trusted; without trusted
documents the ratio is 0 for all and only the base rules decide; no documents give no rows. Texts are read whole: a very
long one holds its words and hashes as arrays in one row, in memory by its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_labels, id_and_text, materialise, remainder, small_side

BUCKETS = 1 << 16
MIN_WORDS = 50
LOST = 0.02
STEP = 0.005
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII white space characters; of a null text none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(windows: Column, width: int = 3) -> Column:
    """How many words lie in windows of `width` words that stand twice or more in the text; windows: their hashes, in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(pairs, count))


def base_statistics(text: Column) -> list[Column]:
    """Those of the contract, from columns `words` and `windows` and the text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("windows")).alias("n_repeat_words"),
    ]


def _chained(left: Column, hashes: Column, step: int) -> Column:
    """Hashes of neighbours: left[i] with hashes[i + step], as far as both are there."""
    every = F.transform(left, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))
    return F.slice(every, 1, F.greatest(F.size(hashes) - step, F.lit(0)))


def _grams(hashes: Column, pairs: Column, buckets: int) -> Column:
    bucket = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return F.concat(F.transform(hashes, bucket), F.transform(pairs, bucket))


def _taken_apart(docs: DataFrame, buckets: int) -> DataFrame:
    """words, windows (hashes of three words) and grams (buckets of words and pairs of words) as columns, behind a
    generator so that they are computed once for all that read them."""

    def parts(words: Column) -> Column:
        def hashed(h: Column) -> Column:
            return let(_chained(h, h, 1), lambda pairs: F.struct(words.alias("words"), _chained(pairs, h, 2).alias("windows"), _grams(h, pairs, buckets).alias("grams")))

        return let(F.transform(words, lambda x: F.xxhash64(x)), hashed)

    once = docs.select("doc_id", "text", F.explode(F.array(let(words_of(F.col("text")), parts))).alias("_w"))
    return once.select("doc_id", "text", "_w.words", "_w.windows", "_w.grams")


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, one array: for each bucket the log of its share in trusted documents over its share in all, add-one smoothed."""
    marked = docs.join(trusted.withColumn("trusted", F.lit(1)), "doc_id", "left")
    grams = let(F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)), lambda h: _grams(h, _chained(h, h, 1), buckets))
    each = marked.select("trusted", F.explode(grams).alias("b"))
    counts = each.groupBy("b").agg(F.count("*").alias("every"), F.count("trusted").alias("target"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left").fillna(0)  # a row a bucket
    array = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("b", c))), lambda x: x[c])
    total = full.agg(array("every").alias("e"), array("target").alias("t"), F.sum("every").alias("ne"), F.sum("target").alias("nt"))
    weight = F.zip_with("e", "t", lambda e, t: F.log((t + 1.0) / (F.col("nt") + float(buckets))) - F.log((e + 1.0) / (F.col("ne") + float(buckets))))
    return total.select(F.when(F.col("nt") > 0, weight).otherwise(F.transform("e", lambda _: F.lit(0.0))).alias("weights"))


def _ratio() -> Column:
    """From the columns grams and weights."""
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(F.col("weights"), g))
    return F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, lost: float = LOST, step: float = STEP) -> DataFrame:
    """doc_id, the base statistics, base_failed, ratio, kept: a row for each document. labels: doc_id, quality."""
    docs = id_and_text(docs)
    trusted = small_side(clean_labels(labels, "quality").where("label = 1").select("doc_id"))
    even = remainder("doc_id", 2) == 0
    weights = materialise(gram_weights(docs, trusted.where(even), buckets))  # one row, read by both passes below

    def rated(some: DataFrame, statistics: list[Column]) -> DataFrame:
        # named behind the generator, the subquery becomes part of the ratio's expression: a task holds the array once, no row carries it
        apart = _taken_apart(some, buckets).withColumn("weights", weights.scalar())
        found = apart.select("doc_id", *statistics, _ratio().alias("ratio"))
        return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    sample = rated(docs.join(trusted.where(~even), "doc_id", "left_semi"), [c for c in base_statistics(F.col("text"))]).where("NOT base_failed")
    steps = sample.groupBy(F.floor(F.col("ratio") / step).alias("s")).agg(F.count("*").alias("n")).collect()  # one row a step: bounded by the range of weights
    left, threshold = lost * sum(r["n"] for r in steps), -math.inf
    for r in sorted(steps, key=lambda r: r["s"]):
        threshold = r["s"] * step
        left -= r["n"]
        if left < 0:
            break
    return rated(docs, base_statistics(F.col("text"))).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"
    )
