"""Source divergence audit: how far each source's use of words is from every other source of its language, and by which terms.

Terms are runs of letters (ASCII ones lower-cased) and of non-ASCII characters; a language keeps the terms that stand in
`min_documents` of its documents or more. A group (lang, source) gives each kept term p = 1 + floor(SCALE (count + 1) / (N + V)).
The divergence of p from q is f = floor((p - q)(p - q) / q), summed over all kept terms.

Joint count histograms: a term's p depends on its count alone. So for two sources only the distinct (count, count)
combinations of their terms are tallied, and f is evaluated once for each, times how often it occurs. A row a term holds
its counts by source; tasks tally the pairs of sources that share a term in blocks of at most BLOCK combinations and emit
distinct ones. Cells with a zero on one or both sides never stand in such a row: they are what a source's own histogram
has beyond the tallied cells.

All arithmetic is on integers (numerators as decimals): no result depends on the order of rows.

Defined results: null text, lang and source are empty strings; every (lang, source) that occurs has its pairs, even
without terms; a language without kept terms has divergence 0; a source alone in its language has no pair rows; every
row is a document, repeated ones too. Texts are read whole as bytes; a chunk of rows is split into words in one worker, so
memory follows the batch or the longest text. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise, small_side

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Combinations of two counts that a task holds at once.
BLOCK = 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _pairs(s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j below s, in blocks."""
    step = max(1, BLOCK // s)
    for i in range(0, s - 1, step):
        own = np.arange(i, min(i + step, s - 1))
        left = np.repeat(own, s - 1 - own)
        yield left, left + 1 + _ranges(s - 1 - own)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) -> (lang, source, term, n, docs), summed within each batch."""
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        groups: dict[tuple[str, str], int] = {}
        ids: dict[bytes, int] = {}
        codes, sizes, group = [], [], []
        for lang, source, text in zip(langs, sources, batch.column(2)):
            words = _TERM.findall(text.as_py().lower())
            codes.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            sizes.append(len(words))
            group.append(groups.setdefault((lang, source), len(groups)))
        if not ids:
            continue
        words, m = np.concatenate(codes), len(ids)
        cells, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * m + words, return_counts=True)  # by document and word
        place = np.array(group)[cells // m] * m + cells % m
        found, inverse, docs = np.unique(place, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, n).astype(np.int64)
        names, vocabulary = list(groups), pa.array(list(ids), pa.binary()).cast(pa.string())
        of = found // m
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in names]).take(pa.array(of)), pa.array([x[1] for x in names]).take(pa.array(of)), vocabulary.take(pa.array(found % m)), pa.array(total), pa.array(docs.astype(np.int64))],
            ["lang", "source", "term", "n", "docs"],
        )


def term_vectors(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, counts): a row for each kept term, counts an array of (source, n) by source, n > 0.

    One shuffle, by language and term, of rows that are summed within batches before it."""
    counted = in_arrow(docs.select("lang", "source", F.col("text").cast("binary")), _count_batches, "lang string, source string, term string, n long, docs long")
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("docs") >= min_documents).select("lang", "term", "counts")


def _tally_block(lang: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, names: pa.Array, langs: pa.Array) -> pa.RecordBatch:
    """Distinct (lang, g, h, a, b) with how often each stands there."""
    pairs, pair = np.unique((lang * len(names) + g) * len(names) + h, return_inverse=True)
    values, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    k = len(values)
    cells, m = np.unique((pair * k + both[: len(a)]) * k + both[len(a) :], return_counts=True)
    own = pairs[cells // (k * k)]
    at = [langs.take(pa.array(own // len(names) ** 2)), names.take(pa.array(own // len(names) % len(names))), names.take(pa.array(own % len(names)))]
    return pa.RecordBatch.from_arrays([*at, pa.array(values[cells // k % k]), pa.array(values[cells % k]), pa.array(m.astype(np.int64))], ["lang", "g", "h", "a", "b", "m"])


def _tally_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, counts) -> (lang, g, h, a, b, m), g before h: how many terms have count a in g and b in h."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, counts = batch.column(0).dictionary_encode(), batch.column(1)
        flat = counts.flatten()
        source, n = flat.field("source").dictionary_encode(), flat.field("n").to_numpy()
        code, lang = source.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
        size = counts.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        for s in np.unique(size[size > 1]):
            rows = np.flatnonzero(size == s)
            for left, right in _pairs(int(s)):  # counts are sorted by source, so the left one is the lesser name
                step = max(1, BLOCK // len(left))
                for r in (rows[k : k + step] for k in range(0, len(rows), step)):
                    i, j = (start[r][:, None] + left).ravel(), (start[r][:, None] + right).ravel()
                    yield _tally_block(np.repeat(lang[r], len(left)), code[i], code[j], n[i], n[j], source.dictionary, langs.dictionary)


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (n + v)) as a long; null where there is no term."""
    above = (count + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif((n + v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1) + F.call_function("div", above, below)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)(p - q) / q): both are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the divergence from each other source of the language, part
    `term` the terms that the source uses more than its language does, the first `top_terms`."""
    docs = docs.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    vectors = materialise(term_vectors(docs, min_documents))
    cells = vectors.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_lang"), F.explode("counts").alias("c")).select("lang", "term", "n_lang", "c.source", "c.n")
    margins = materialise(cells.groupBy("lang", "source", F.col("n").alias("a")).agg(F.count("*").alias("m")))  # each source's own histogram of counts
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"))
    sums = margins.groupBy("lang", "source").agg(F.sum(F.col("a") * F.col("m")).alias("n_all"), F.sum("m").alias("present"))
    groups = docs.select("lang", "source").distinct().join(small_side(sums), ["lang", "source"], "left").join(small_side(kept), "lang", "left").fillna(0, ["n_all", "present", "v"])
    groups = materialise(groups)  # a row for each source of each language

    g = groups.select("lang", F.col("source").alias("g"), F.col("n_all").alias("n_g"), F.col("present").alias("present_g"), "v")
    h = groups.select("lang", F.col("source").alias("h"), F.col("n_all").alias("n_h"), F.col("present").alias("present_h"))
    pairs = g.join(small_side(h), "lang").where("g < h")
    both = materialise(in_arrow(vectors.select("lang", "counts"), _tally_batches, "lang string, g string, h string, a long, b long, m long").groupBy("lang", "g", "h", "a", "b").agg(F.sum("m").alias("m")))

    # zero cells: what a source's histogram has beyond the cells where the other source has the term too
    zero, key = F.lit(0).cast("long"), ["lang", "g", "h", "a", "b"]
    own_g = pairs.join(margins.withColumnRenamed("source", "g"), ["lang", "g"]).select("lang", "g", "h", "a", zero.alias("b"), "m")
    own_h = pairs.join(margins.withColumnRenamed("source", "h"), ["lang", "h"]).select("lang", "g", "h", zero.alias("a"), F.col("a").alias("b"), "m")
    less_g = both.groupBy("lang", "g", "h", "a").agg((-F.sum("m")).alias("m")).select("lang", "g", "h", "a", zero.alias("b"), "m")
    less_h = both.groupBy("lang", "g", "h", "b").agg((-F.sum("m")).alias("m")).select("lang", "g", "h", zero.alias("a"), "b", "m")
    shared = both.groupBy("lang", "g", "h").agg(F.sum("m").alias("m"))
    neither = pairs.join(shared, ["lang", "g", "h"], "left").select("lang", "g", "h", zero.alias("a"), zero.alias("b"), (F.col("v") - F.col("present_g") - F.col("present_h") + F.coalesce("m", zero)).alias("m"))
    one_zero = own_g.union(own_h).union(less_g).union(less_h).groupBy(*key).agg(F.sum("m").alias("m"))
    histogram = both.select(*key, "m").union(one_zero).union(neither).where("m > 0")

    sized = histogram.join(small_side(pairs.select("lang", "g", "h", "n_g", "n_h", "v")), ["lang", "g", "h"])
    p = sized.select("lang", "g", "h", "m", probability(F.col("a"), F.col("n_g"), F.col("v")).alias("p"), probability(F.col("b"), F.col("n_h"), F.col("v")).alias("q"))
    measured = p.groupBy("lang", "g", "h").agg(F.sum(F.col("m") * divergence(F.col("p"), F.col("q"))).alias("gh"), F.sum(F.col("m") * divergence(F.col("q"), F.col("p"))).alias("hg"))
    every = pairs.select("lang", "g", "h").join(measured, ["lang", "g", "h"], "left").fillna(0, ["gh", "hg"])
    two = F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item"), F.col("gh").alias("value")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"), F.col("hg").alias("value"))))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = every.select("lang", two.alias("x")).select("lang", "x.*").withColumn("rank", F.row_number().over(in_order))

    whole = groups.groupBy("lang").agg(F.sum("n_all").alias("n_whole"))
    totals = groups.select("lang", "source", "n_all", "v").join(small_side(whole), "lang")
    rated = cells.join(small_side(totals), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), probability(F.col("n"), F.col("n_all"), F.col("v")).alias("p"), probability(F.col("n_lang"), F.col("n_whole"), F.col("v")).alias("q")
    )
    above = rated.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    term_rows = above.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top_terms)  # Spark keeps that many of a group in each task before the shuffle
    form = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return form(pair_rows, "pair").union(form(term_rows, "term"))


#: The same with every kept term in every group, for DuckDB.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS "text" FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all("text", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS n_lang FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
rated AS (SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::HUGEINT * (n_lang + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang, source)) AS q FROM cells),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM rated WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
