
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c, finite, normalise_answer
from ..sources.scratch import written
from .keys import beside, small_side
from .ordered import numbered as numbered
from .ordered import scan


def accuracy(df: DataFrame, keys: list[str], answer: str, truth: str) -> DataFrame:
    """A3: percent correct and rows by key. An unparsable answer is wrong, never equal to a missing truth."""
    correct = F.coalesce(normalise_answer(answer) == normalise_answer(truth), F.lit(False))
    return df.groupBy(*keys).agg((100 * F.avg(correct.cast("double"))).alias("accuracy"), F.count("*").alias("size"))


def null_rate(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A4: missing values, rows and percent missing."""
    gone = F.sum(F.col(column).isNull().cast("long"))
    return df.groupBy(*keys).agg(gone.alias("missing"), F.count("*").alias("size"), (100.0 * gone / F.count("*")).alias("percent"))


#: Ranks that the sketch of a quantile may be off: one in so many rows.
SKETCH = 10_000
#: Rows that are put in order in one place, at most.
MOST = 100_000


def quantiles(df: DataFrame, keys: list[str], column: str, at: dict[str, float], sketch: int = SKETCH, most: int = MOST) -> DataFrame:
    """Exact quantiles by key, interpolated between ranks: a column for each name of at; keys without a value have no row.

    Two passes over the values. A sketch brackets each quantile; then all values are counted in cells, which are single
    values within the brackets and whole ranges between them. The cells' running counts say where each rank lies. Cells
    are far fewer than rows; if there are more than `most`, their running counts come from a two-level scan, so no task
    orders a key's values, however few the keys are.
    """
    live = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    qs = sorted(set(at.values()))
    around = [max(0.0, q - 2 / sketch) for q in qs] + [min(1.0, q + 2 / sketch) for q in qs]
    bounds = live.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", around, sketch).alias("_s"))
    bounds = small_side(written(bounds))
    v, low, high = F.col("_v"), [F.get("_s", F.lit(i)) for i in range(len(qs))], [F.get("_s", F.lit(len(qs) + i)) for i in range(len(qs))]
    inside = reduce(lambda a, b: a | b, [(v >= a) & (v <= b) for a, b in zip(low, high)])
    passed = reduce(lambda a, b: a + b, [(v > b).cast("int") for b in high])  # how many brackets lie below
    cells = _counted(beside(live, bounds, keys).select(*keys, "_v", F.when(inside, v).alias("_w"), F.when(~inside, passed).alias("_g")), keys)
    ranks = bounds.select(*keys, F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("_n") - 1)).alias("place")) for q in qs])).alias("_q")).select(*keys, F.col("_q.q").alias("_at"), F.col("_q.place").alias("_place"))
    wanted = ranks.select(*keys, "_at", "_place", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_k"))
    found = _values_at(cells, wanted, keys, most)
    if not found.where("_w IS NULL").isEmpty():  # a sketch was further off than it promises: count every value
        found = _values_at(_counted(live.select(*keys, "_v", v.alias("_w"), F.lit(None).cast("int").alias("_g")), keys), wanted, keys, most)
    whole = found.groupBy(*keys, "_at").agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.first("_place").alias("_place"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_place") - F.floor("_place")))
    return whole.groupBy(*keys).agg(*[F.max(F.when(F.col("_at") == q, value)).alias(name) for name, q in at.items()])


def _counted(values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each cell with its least and largest value, written: _w is the value of a cell that has only one, _g the number of a range."""
    return written(values.groupBy(*keys, "_w", "_g").agg(F.count("*").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_largest")))


def _values_at(cells: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """wanted (keys, _at, _place, _k: a rank from 0) with the value _w at the rank, or NULL if it lies within a range."""
    if cells.limit(most + 1).count() > most:
        summed = scan(cells, keys, [F.col("_least")], sums={"_end": F.col("_rows")}, ranges=int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    else:
        summed = cells.withColumn("_end", F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_least").rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("_end") - F.col("_rows")
    hit = beside(summed, wanted.groupBy(*keys).agg(F.collect_list(F.struct("_at", "_place", "_k")).alias("_ks")), keys)  # a few ranks a key
    placed = hit.withColumn("_q", F.explode("_ks")).where((begin <= F.col("_q._k")) & (F.col("_q._k") < F.col("_end")))
    first, last = F.col("_q._k") == begin, F.col("_q._k") == F.col("_end") - 1
    single = F.when(F.col("_w").isNotNull() | first | (F.col("_least") == F.col("_largest")), F.col("_least")).when(last, F.col("_largest"))
    return written(placed.select(*keys, "_q._at", "_q._place", "_q._k", single.alias("_w")))


def describe(df: DataFrame, keys: list[str], column: str, quantile: list[float] | None = None) -> DataFrame:
    """Count, mean, extremes and exact quantiles (q25, q50, ...)."""
    names = {f"q{round(100 * x)}": x for x in quantile or [0.25, 0.5, 0.75]}
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return beside(out, quantiles(df, keys, column, names), keys, "left" if keys else "inner")


def log_ratio_summary(df: DataFrame, keys: list[str], answer: str, truth: str) -> DataFrame:
    """Answers by their log ratio to the truth, in dex: how many, how far, how often within 2x and 10x."""
    a, t = F.col(answer), F.col(truth)
    dex = df.withColumn("dex", F.when((a > 0) & (t > 0) & finite(a) & finite(t), F.log10(a / t)))
    share = lambda cond: 100 * F.avg(F.when(F.col("dex").isNotNull(), cond.cast("double")))
    d = F.col("dex")
    counted = dex.groupBy(*keys).agg(
        F.count("*").alias("answers"),
        F.sum(a.isNull().cast("long")).alias("unparsable"),
        F.sum(F.coalesce(a <= 0, F.lit(False)).cast("long")).alias("nonpositive"),
        F.count("dex").alias("plotted"),
        share(d > 0).alias("over"),
        share(d < 0).alias("under"),
        share(F.abs(d) < math.log10(2)).alias("within2"),
        share(F.abs(d) < 1).alias("within10"),
        share(d > 1).alias("over10"),
        share(d < -1).alias("under10"),
    )
    both = beside(counted, quantiles(dex, keys, "dex", {"median_dex": 0.5}), keys, "left" if keys else "inner")
    return both.withColumn("median_factor", F.pow(F.lit(10.0), F.col("median_dex")))


def band_counts(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """A38 with open ends: rows in (-inf, e0), [e0, e1), ..., [en, inf)."""
    from ..functions.scalars import in_band

    ends = [None, *edges, None]
    parts = [F.when(in_band(column, a, b), i) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    return df.select(F.coalesce(*parts).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def complete_grid(df: DataFrame, axes: dict[str, DataFrame], fill: dict[str, float] | None = None) -> DataFrame:
    """Every combination of the axes' values (small dimension tables), missing ones NULL or filled."""
    grid = reduce(lambda a, b: a.crossJoin(b), axes.values())
    out = grid.join(df, list(axes), "left")
    return out.fillna(fill) if fill else out


def pivot_counts(df: DataFrame, row: str, column: str, values: list, cond: Column | None = None) -> DataFrame:
    """Rows by key with a counting column for each value, 0 where there is none."""
    one = F.lit(True) if cond is None else cond
    return df.groupBy(row).agg(*[F.sum(((F.col(column) == v) & one).cast("long")).alias(str(v)) for v in values])


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """Rows by key with a column of means for each value."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure))


def pivot_first(df: DataFrame, keys: list[str], column: str, values: list, measure: str) -> DataFrame:
    """One value for each key and column (the least if there are more, so that the result is stable)."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(column) == v, F.col(measure))).alias(str(v)) for v in values])


def top_counts(df: DataFrame, key: str, n: int | None = None, least: int = 1) -> DataFrame:
    """Value counts, most frequent first, ties by value; at least `least`, at most n values."""
    out = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.orderBy(F.desc("n"), key).limit(n) if n else out


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have n rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


def distinct_rounded(df: DataFrame, keys: list[str], column: str, decimals: int | None = None) -> DataFrame:
    """Distinct values, after rounding if asked."""
    x = F.round(column, decimals) if decimals is not None else F.col(column)
    return df.groupBy(*keys).agg(F.countDistinct(x).alias("distinct"))


def share_within(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count of each value and its percent of its key's rows."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    total = df.groupBy(key).agg(F.count("*").alias("_total"))  # not a window: a key's values stay in as many tasks as they are in
    return beside(counts, total, [key]).select(key, value, "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def rare_to_null(df: DataFrame, value: str, percent: str, least: float) -> DataFrame:
    """Values with less than a share become NULL, and are marked so."""
    keep = F.col(percent) >= least
    return df.withColumn("change", F.when(keep, "kept").otherwise("deleted")).withColumn(value, F.when(keep, F.col(value)))


def usage_cost(df: DataFrame, keys: list[str], prices: DataFrame) -> DataFrame:
    """Calls, calls with known usage, tokens, cost by price per million (columns in_price, out_price), cost scaled to all calls."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("calls"), F.count("input_tokens").alias("known"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("in_price") + F.col("tokens_out") * F.col("out_price")) / 1e6
    priced = sums.join(prices, [k for k in keys if k in prices.columns])
    return priced.select(*keys, "calls", "known", "tokens_in", "tokens_out", (F.col("calls") == F.col("known")).alias("exact"), cost.alias("cost"), F.when(F.col("known") > 0, cost * F.col("calls") / F.col("known")).alias("scaled_cost"))


def effect_frequency(df: DataFrame, items: str) -> DataFrame:
    """Share of rows whose array holds each item (twice in one row counts once)."""
    n = df.agg(F.count("*").alias("rows"))
    hits = df.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return hits.crossJoin(F.broadcast(n)).select("item", "n", (F.col("n") / F.col("rows")).alias("share"))  # n is one row


def one_value(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Whether a key's rows agree on a value, and which it is."""
    return df.groupBy(*keys).agg((F.countDistinct(column) <= 1).alias("agree"), F.min(column).alias("value"))


def same_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Whether each group holds every member that any group holds."""
    total = df.agg(F.countDistinct(member).alias("_all"))
    return df.groupBy(group).agg(F.countDistinct(member).alias("members")).crossJoin(F.broadcast(total)).select(group, "members", (F.col("members") == F.col("_all")).alias("complete"))


def levels(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by all prefixes of keys, in one aggregation."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """W1"""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, keys: list[str], order: str, cancelled: str | None = None) -> DataFrame:
    """The latest row of each key that isn't cancelled; a missing time comes first, so it loses."""
    live = df.where(~F.coalesce(F.col(cancelled), F.lit(False))) if cancelled else df
    others = [x for x in df.columns if x not in keys]
    return live.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(order), F.struct(*others))).alias("_r")).select(*keys, "_r.*")


def concentration(df: DataFrame, key: str, value: str, fraction: float = 0.01) -> DataFrame:
    """What share of a field's light (value above its minimum) its brightest fraction holds.

    Places come from a two-level scan and the rest from aggregates: no task holds a field's rows."""
    values = df.select(key, F.col(value).alias("_v"))
    light = beside(values, values.groupBy(key).agg(F.min("_v").alias("_least")), [key]).withColumn("_light", F.col("_v") - F.col("_least"))
    placed = scan(light, [key], [F.desc("_v")], place="_i", total="_n")
    top = F.sum(F.when(F.col("_i") < F.greatest(F.lit(1), F.round(fraction * F.col("_n"))), F.col("_light")))
    return placed.groupBy(key).agg(F.when(F.sum("_light") > 0, top / F.sum("_light")).alias("concentration"))


def circular_gap(df: DataFrame, key: str, degrees: str) -> DataFrame:
    """The largest empty arc among a key's angles, and the arc that holds them all, NULL above 180 degrees.

    Each angle's follower comes from a two-level scan; only the one arc over 0h is closed from the key's extremes."""
    points = df.where(F.col(degrees).isNotNull()).select(key, F.col(degrees).alias("_d")).distinct()
    arcs = scan(points, [key], [F.col("_d")], following={"_next": F.col("_d")})
    inner = F.when(F.col("_next").isNotNull(), F.struct((F.col("_next") - F.col("_d")).alias("gap"), (-F.col("_d")).alias("from"), F.col("_next").alias("next")))
    ends = arcs.groupBy(key).agg(F.max(inner).alias("inner"), F.min("_d").alias("first"), F.max("_d").alias("last"))
    across = F.struct((F.col("first") + 360 - F.col("last")).alias("gap"), (-F.col("last")).alias("from"), (F.col("first") + 360).alias("next"))
    best = ends.select(key, F.greatest("inner", across).alias("g"))  # struct by struct: of equal gaps the one that begins first
    span = 360 - F.col("g.gap")
    return best.select(key, F.col("g.gap").alias("gap"), F.when(span <= 180, span).alias("span"), F.when(span <= 180, F.pmod("g.next", F.lit(360.0))).alias("start"))


def histogram(x, low: float, high: float, bins: int) -> Column:
    """The bin of x among equal ones, the last closed; NULL outside."""
    x = c(x)
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def density(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """All bins with count and density."""
    counts = df.select(histogram(column, low, high, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    total = counts.agg(F.sum("n").alias("total"))
    return every.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * ((high - low) / bins))).alias("density"))


def field_2d(df: DataFrame, x: str, y: str, ranges: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """Counts on a complete nx by ny grid."""
    x0, x1, y0, y1 = ranges
    binned = df.select(histogram(x, x0, x1, nx).alias("ix"), histogram(y, y0, y1, ny).alias("iy")).where("ix IS NOT NULL AND iy IS NOT NULL").groupBy("iy", "ix").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return grid.join(binned, ["iy", "ix"], "left").fillna(0, ["n"])


def paired_cells(df: DataFrame, unit: str, side: str, a, b, correct: str) -> DataFrame:
    """Of units seen on both sides, how many are right on both, one or neither."""
    at = lambda v: F.max(F.when(F.col(side) == v, F.col(correct).cast("int")))
    pairs = df.groupBy(unit).agg(at(a).alias("x"), at(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    count = lambda x, y: F.sum(((F.col("x") == x) & (F.col("y") == y)).cast("long"))
    return pairs.agg(count(1, 1).alias("both_right"), count(1, 0).alias("b"), count(0, 1).alias("c"), count(0, 0).alias("neither"))


def claims(df: DataFrame) -> DataFrame:
    """Section, claim, computed, paper -> ok for each row."""
    from ..functions.scalars import claim_holds

    return df.withColumn("ok", claim_holds("computed", "paper"))


def blank_panels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Panels without a finite value or with at most one distinct."""
    v = F.when(finite(value), F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("finite"), (F.countDistinct(v) <= 1).alias("blank"))


def first_answer(raw, response) -> Column:
    """The raw answer, or the response where that is empty or missing."""
    return F.coalesce(F.nullif(c(raw), F.lit("")), c(response))


def value_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least and largest finite value of each key, where they differ."""
    v = F.when(finite(value), F.col(value))
    return df.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high")).where("high > low")


def shared_limit(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Each group's largest count and the one that all of them share."""
    top = counts.groupBy(group).agg(F.max(n).alias("own"))
    return top.crossJoin(F.broadcast(top.agg(F.max("own").alias("shared"))))


def verified(answers: DataFrame, truths: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answers with a verified truth, and those skipped for want of one."""
    return answers.join(truths, keys), answers.join(truths.select(*keys), keys, "left_anti")


def run_difference(df: DataFrame, keys: list[str], run: str, first, second, correct: str) -> DataFrame:
    """Accuracy in two runs and the difference, by key, in one aggregation."""
    at = lambda v: 100 * F.avg(F.when(F.col(run) == v, F.col(correct).cast("double")))
    return df.groupBy(*keys).agg(at(first).alias("first"), at(second).alias("second"), (at(second) - at(first)).alias("change"))


def clip_stretch(df: DataFrame, key: str, value: str, percent: float = 99.0, log: float | None = None) -> DataFrame:
    """Values clipped to the central percent of their field and rescaled to 0..1; with log = a stretched by
    log(a x + 1) / log(a + 1). NULL stays NULL; a field of one value becomes 0."""
    tail = (1 - percent / 100) / 2
    bounds = quantiles(df, [key], value, {"_lo": tail, "_hi": 1 - tail})
    x = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    unit = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    unit = unit if log is None else F.log(log * unit + 1) / math.log(log + 1)
    return beside(df, bounds, [key], "left").withColumn("stretched", F.when(F.col(value).isNotNull(), unit)).drop("_lo", "_hi")


def unstretched(stretched, low, high, log: float | None = None) -> Column:
    """M26, backwards: the value of a stretched one between the limits of its field."""
    x = c(stretched)
    unit = x if log is None else (F.pow(F.lit(log + 1.0), x) - 1) / log
    return c(low) + unit * (c(high) - c(low))


def round_robin(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Which of `workers` each row goes to, in turn, by a column (missing values first); ties by all columns."""
    found = numbered(df, [F.col(order), *[F.col(x) for x in df.columns]], "_n")
    return found.withColumn("worker", (F.col("_n") % workers).cast("int")).drop("_n")


#: Statistics by name.
STATISTICS = {"minimum": F.min, "maximum": F.max, "median": None, "mean": F.avg}


def statistics(df: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """The named statistics of a value."""
    out = df.groupBy(*keys).agg(F.count(value).alias("_n"), *[STATISTICS[n](value).alias(n) for n in names if n != "median"])
    if "median" in names:
        out = beside(out, quantiles(df, keys, value, {"median": 0.5}), keys, "left" if keys else "inner")
    return out.select(*keys, *names)


def extremes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A2: least, largest and summed value of each key."""
    return df.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.sum(column).alias("sum"))


def finite_mean(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows, finite values and their mean by key."""
    v = F.when(finite(column), F.col(column))
    return df.groupBy(*keys).agg(F.count("*").alias("size"), F.count(v).alias("finite"), F.avg(v).alias("mean"))


def row_of_largest(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Each key's row with the largest measure; of equal ones the row that is largest as a whole."""
    others = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(measure), F.struct(*others))).alias("_r")).select(*keys, "_r.*")


def value_sets(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The distinct values of columns by key, in order."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(x)).alias(x) for x in columns])


def tally(df: DataFrame, cases: list[tuple[str, Column]], other: str = "other") -> DataFrame:
    """How many rows have each status, the first whose condition holds; statuses without rows count 0."""
    status = reduce(lambda acc, case: F.when(case[1], case[0]).otherwise(acc), reversed(cases), F.lit(other))
    counts = df.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(name,) for name, _ in cases] + [(other,)], "status string")
    return every.join(counts, "status", "left").fillna(0, ["n"])


def substitutions(df: DataFrame, least_percent: float = 0.01, least_count: int | None = None) -> DataFrame:
    """Pairs of a read (ocr) and a true (pdf) token with percent and count: those above the least count (or else
    percent), insertions (^ read) and deletions (@ true) named so, and the numbers of pairs that are both made NULL."""
    kept = df.where(F.col("count") > least_count) if least_count is not None else df.where(F.col("percent") > least_percent)
    name = F.concat(F.round("percent", 2).cast("string"), F.lit("%"))
    ocr = F.when((F.col("ocr") == "^") & (F.col("pdf") != "^"), "INSERT").otherwise(F.col("ocr"))
    pdf = F.when((F.col("pdf") == "@") & (F.col("ocr") != "@"), "DELETE").otherwise(F.col("pdf"))
    named = kept.select(ocr.alias("ocr"), pdf.alias("pdf"), "percent", "count", name.alias("name"))
    both = (F.col("ocr") == "INSERT") & (F.col("pdf") == "DELETE")
    return named.select("ocr", "pdf", *[F.when(~both, F.col(x)).alias(x) for x in ("percent", "count")], "name")


def edge_bin(x, edges: list[float]) -> Column:
    """The bin of x among given ascending edges, the last closed; NULL outside."""
    x, last = c(x), len(edges) - 2
    return F.coalesce(*[F.when((x >= a) & ((x <= b) if i == last else (x < b)), i) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def histogram_of(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """All bins of given edges with their counts."""
    counts = df.select(edge_bin(column, edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["n"])


def largest_changes(df: DataFrame, first: str, second: str, n: int = 5) -> DataFrame:
    """O2: the n rows that differ most between two columns, either way; ties by all columns."""
    return df.withColumn("diff", F.col(second) - F.col(first)).orderBy(F.desc(F.abs("diff")), *df.columns).limit(n)


def frequent(df: DataFrame, word: str, most: int, dropped: list[str], then: int) -> DataFrame:
    """O3: of the `most` commonest words those that aren't dropped, at most `then`: word, n. Ties by word."""
    top = df.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.desc("n"), word).limit(most)
    return top.where(~F.col(word).isin(*dropped)).orderBy(F.desc("n"), word).limit(then)


def sky_features(df: DataFrame, key: str, value: str, width: str, height: str, fraction: float = 0.01) -> DataFrame:
    """The four features of a field: log size, concentration, log span and sign of its least value."""
    v = F.when(finite(value), F.col(value))
    spans = df.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.max(width).alias("_w"), F.max(height).alias("_h"))
    light = concentration(df.where(finite(value)), key, value, fraction)
    size = F.when(F.col("_w") * F.col("_h") > 0, F.log10(F.sqrt(F.col("_w") * F.col("_h"))))
    span = F.when(F.col("_hi") > F.col("_lo"), F.log10(F.col("_hi") - F.col("_lo"))).otherwise(-12.0)
    return spans.join(light, key, "left").select(key, size.alias("field_size"), F.coalesce("concentration", F.lit(0.0)).alias("concentration"), span.alias("span"), F.signum("_lo").alias("sign"))
