"""Evaluation queries: accuracy, ratios, counts, pivots, windows, tests, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import relate as R
from .registry import query, r


def answers(t):
    """The answers table as the events give it: truth from props, some answers missing, some negative."""
    e = t("events")
    value = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, -F.col("value")).otherwise(F.col("value"))
    return e.select(
        F.col("event_id").alias("vqa_id"), (F.col("user_id") % 2).cast("int").alias("run"), F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("int").alias("category"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("truth"), value.alias("answer"),
    )


ANSWERS = """a AS (SELECT event_id AS vqa_id, CAST(user_id % 2 AS INT) AS run, event_type AS model, CAST(user_id % 3 AS INT) AS category,
  TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS truth,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -value ELSE value END AS answer FROM events)"""


def worded(t):
    """Answers in words: some missing, some wrong, most with blanks and capitals."""
    e = t("events")
    said = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 5 == 0, "click").otherwise(F.concat(F.lit(" "), F.upper("event_type"), F.lit("_")))
    return e.select(F.col("event_id").alias("vqa_id"), (F.col("user_id") % 2).cast("int").alias("run"), F.col("event_type").alias("truth"), (F.col("user_id") % 3).cast("int").alias("model"), said.alias("answer"))


WORDED = """w AS (SELECT event_id AS vqa_id, CAST(user_id % 2 AS INT) AS run, event_type AS truth, CAST(user_id % 3 AS INT) AS model,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'click' ELSE ' ' || upper(event_type) || '_' END AS answer FROM events)"""
CORRECT = "coalesce(trim(regexp_replace(lower(answer), '[ _]', '', 'g')) = trim(regexp_replace(lower(truth), '[ _]', '', 'g')), false)"


@query(f"""WITH {ANSWERS}, r AS (SELECT *, CASE WHEN answer > 0 AND truth > 0 THEN log10(answer / truth) END AS dex FROM a)
SELECT run, model, count(*) AS answers, CAST(sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unparsable,
  CAST(sum(CASE WHEN answer <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonpositive, count(dex) AS plotted, round(median(dex), 6) AS median_dex,
  round(pow(10.0, median(dex)), 6) AS median_factor,
  round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(dex > 0 AS DOUBLE) END), 6) AS over, round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(dex < 0 AS DOUBLE) END), 6) AS under,
  round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(abs(dex) < log10(2) AS DOUBLE) END), 6) AS within2, round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(abs(dex) < 1 AS DOUBLE) END), 6) AS within10,
  round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(dex > 1 AS DOUBLE) END), 6) AS over10, round(100 * avg(CASE WHEN dex IS NOT NULL THEN CAST(dex < -1 AS DOUBLE) END), 6) AS under10
FROM r GROUP BY run, model""")
def logratio_summary(t):
    """A6-A9, M5, P14, P16"""
    found = E.log_ratio_summary(answers(t), ["run", "model"], "answer", "truth")
    whole = ("run", "model", "answers", "unparsable", "nonpositive", "plotted")
    return found.select(*[c if c in whole else r(c).alias(c) for c in found.columns])


@query(f"WITH {WORDED} SELECT run, model, round(100 * avg(CAST({CORRECT} AS DOUBLE)), 6) AS accuracy, count(*) AS size FROM w GROUP BY run, model")
def accuracy_by_run_model(t):
    """A3, F1"""
    return E.accuracy(worded(t), ["run", "model"], "answer", "truth").select("run", "model", r("accuracy").alias("accuracy"), "size")


@query(f"""WITH {ANSWERS}, m AS (SELECT DISTINCT model FROM a), n AS (SELECT DISTINCT run FROM a),
c AS (SELECT model, run, count(*) AS size, CAST(sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM a GROUP BY ALL)
SELECT model, run, coalesce(missing, 0) AS missing, coalesce(size, 0) AS size, round(100.0 * missing / size, 6) AS percent FROM m CROSS JOIN n LEFT JOIN c USING (model, run)""")
def unparsable_grid(t):
    """A4, A19, N11"""
    a = answers(t)
    rates = E.null_rate(a, ["model", "run"], "answer")
    grid = E.complete_grid(rates, {"model": a.select("model").distinct(), "run": a.select("run").distinct()}, {"missing": 0, "size": 0})
    return grid.select("model", "run", "missing", "size", r("percent").alias("percent"))


@query(f"WITH {ANSWERS} SELECT model, CAST(sum(CASE WHEN run = 0 AND answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS \"0\", CAST(sum(CASE WHEN run = 1 AND answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS \"1\" FROM a GROUP BY model")
def unparsable_pivot_filled(t):
    """A16, A18"""
    return E.pivot_counts(answers(t), "model", "run", [0, 1], F.col("answer").isNull())


@query(f"WITH {WORDED} SELECT model, round(avg(CASE WHEN run = 0 THEN CAST({CORRECT} AS DOUBLE) END), 6) AS \"0\", round(avg(CASE WHEN run = 1 THEN CAST({CORRECT} AS DOUBLE) END), 6) AS \"1\" FROM w GROUP BY model")
def accuracy_pivot(t):
    """A15"""
    w = worded(t).withColumn("ok", F.coalesce(S.normalise_answer("answer") == S.normalise_answer("truth"), F.lit(False)).cast("double"))
    return E.pivot_mean(w, "model", "run", [0, 1], "ok").select("model", r("0").alias("0"), r("1").alias("1"))


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.75), 6) AS q75, round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM lineitem GROUP BY 1""")
def describe_exact(t):
    """A5, A20, A22"""
    found = E.describe(t("lineitem"), ["l_returnflag"], "l_quantity", [0.25, 0.5, 0.75, 0.9])
    return found.select("l_returnflag", "n", r("mean").alias("mean"), "min", "max", *[r(q).alias(q) for q in ("q25", "q50", "q75", "q90")])


@query(f"""WITH {ANSWERS}, s AS (SELECT model, CASE WHEN (abs(answer) + abs(truth)) / 2 > 0 THEN (answer - truth) / ((abs(answer) + abs(truth)) / 2) END AS s FROM a)
SELECT model, count(s) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS largest FROM s GROUP BY model""")
def ssmape(t):
    """M4, A21"""
    s = answers(t).select("model", S.ssmape("answer", "truth").alias("s"))
    return s.groupBy("model").agg(F.count("s").alias("n"), r(F.avg("s")).alias("mean"), r(F.min("s")).alias("least"), r(F.max("s")).alias("largest"))


@query(f"""WITH {ANSWERS}, r AS (SELECT CASE WHEN answer > 0 AND truth > 0 THEN log10(answer / truth) END AS dex FROM a)
SELECT CAST(CASE WHEN dex < -1 THEN 0 WHEN dex < 0 THEN 1 WHEN dex < 1 THEN 2 WHEN dex >= 1 THEN 3 END AS INT) AS band, count(*) AS n FROM r GROUP BY 1""")
def band_filter(t):
    """P13"""
    return E.band_counts(answers(t).select(S.log_ratio("answer", "truth").alias("dex")), "dex", [-1.0, 0.0, 1.0])


RULES = [("both", ["the", "tion"]), ("article", ["the"]), ("ending", ["ment"]), ("french", ["que"])]


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'tion') THEN 'both' WHEN contains(lower(text), 'the') THEN 'article'
WHEN contains(lower(text), 'ment') THEN 'ending' WHEN contains(lower(text), 'que') THEN 'french' END AS rule FROM documents) GROUP BY rule""")
def question_select(t):
    """P4-P7"""
    return t("documents").select(R.select_question("text", RULES).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'N' THEN 'contour' WHEN l_linestatus = 'F' THEN 'sky-gmm' ELSE 'sky-real' END AS category FROM lineitem) GROUP BY category""")
def category_case(t):
    """P1"""
    x = t("lineitem").select(F.when(F.col("l_returnflag") == "N", "contour").otherwise("image of the sky").alias("type"), F.when(F.col("l_linestatus") == "F", "gmm").otherwise("sky").alias("d"))
    return x.select(R.figure_category("type", "d").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'contour' ELSE 'image of the sky' END AS type, CASE WHEN l_linestatus = 'F' THEN 'gmm' ELSE 'sky' END AS d FROM lineitem),
s AS (SELECT l_orderkey, bool_and(type = 'contour') AS only_contour, bool_or(type = 'contour') AS any_contour, count(DISTINCT d) AS k, min(d) AS d FROM p GROUP BY 1)
SELECT category, count(*) AS n FROM (SELECT CASE WHEN only_contour THEN 'contour' WHEN any_contour THEN 'other' WHEN k > 1 THEN 'sky-mixed' WHEN d = 'gmm' THEN 'sky-gmm' ELSE 'sky-real' END AS category FROM s) GROUP BY category""")
def category_sets(t):
    """P2, P3"""
    x = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "contour").otherwise("image of the sky").alias("type"), F.when(F.col("l_linestatus") == "F", "gmm").otherwise("sky").alias("d"))
    sets = x.groupBy("l_orderkey").agg(F.collect_set("type").alias("types"), F.collect_set("d").alias("ds"))
    return sets.select(R.category_of_sets("types", "ds").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT n, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def count_of_counts(t):
    """A13"""
    return E.count_of_counts(t("lineitem"), "l_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def having_cut(t):
    """A14"""
    return E.top_counts(t("orders"), "o_custkey", least=12)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20")
def topn_counts(t):
    """The 20 most frequent (the limit is the feature)"""
    return E.top_counts(t("part"), "p_type", 20)


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_extendedprice) AS exact, count(DISTINCT floor(l_extendedprice / 10.0)) AS coarse FROM lineitem GROUP BY 1, 2")
def nunique_rounded(t):
    """A10, A11 (rounded down, so that no tie depends on the engine)"""
    x = t("lineitem").withColumn("ten", F.floor(F.col("l_extendedprice") / 10.0).cast("double"))
    keys = ["l_returnflag", "l_linestatus"]
    a, b = E.distinct_rounded(x, keys, "l_extendedprice"), E.distinct_rounded(x, keys, "ten", 0)
    return a.withColumnRenamed("distinct", "exact").join(b.withColumnRenamed("distinct", "coarse"), keys)


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL)
SELECT nation, segment, coalesce(n, 0) AS n FROM (SELECT n_nationkey AS nation FROM nation) CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) LEFT JOIN c USING (nation, segment)""")
def complete_grid(t):
    """A19"""
    counts = t("customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return E.complete_grid(counts, {"nation": t("nation").select(F.col("n_nationkey").alias("nation")), "segment": counts.select("segment").distinct()}, {"n": 0})


@query("""WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 6) AS percent FROM c""")
def pct_within_key(t):
    """A34, A36, W2"""
    words = t("documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return E.share_within(words, "lang", "word").select("lang", "word", "n", r("percent").alias("percent"))


@query("""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT p, s, n, 100.0 * n / sum(n) OVER (PARTITION BY p) AS pct FROM c)
SELECT p AS o_orderpriority, CASE WHEN pct >= 40 THEN s END AS o_orderstatus, n, CASE WHEN pct >= 40 THEN 'kept' ELSE 'deleted' END AS change FROM x""")
def rare_values(t):
    """A35"""
    return E.rare_to_null(E.share_within(t("orders"), "o_orderpriority", "o_orderstatus"), "o_orderstatus", "percent", 40).drop("percent")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def levels_rollup(t):
    """A29"""
    return E.levels(t("lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS \"1\", min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS \"2\" FROM lineitem GROUP BY 1")
def pivot_first_two_values(t):
    """A17"""
    return E.pivot_first(t("lineitem"), ["l_orderkey"], "l_linenumber", [1, 2], "l_quantity")


@query("""WITH o AS (SELECT o_orderpriority AS model, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 1000 END AS i, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 300 END AS u FROM orders),
s AS (SELECT model, count(*) AS calls, count(i) AS known, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(u) AS BIGINT) AS tokens_out FROM o GROUP BY 1)
SELECT model, calls, known, tokens_in, tokens_out, calls = known AS exact, round((tokens_in * 0.25 + tokens_out * 1.25) / 1e6, 6) AS cost, round((tokens_in * 0.25 + tokens_out * 1.25) / 1e6 * calls / known, 6) AS scaled_cost FROM s""")
def usage_cost(t):
    """A23, A24"""
    known = F.col("o_orderkey") % 11 != 0
    calls = t("orders").select(F.col("o_orderpriority").alias("model"), F.when(known, F.col("o_custkey") % 1000).alias("input_tokens"), F.when(known, F.col("o_orderkey") % 300).alias("output_tokens"))
    prices = calls.select("model").distinct().withColumn("in_price", F.lit(0.25)).withColumn("out_price", F.lit(1.25))
    return E.usage_cost(calls, ["model"], prices).withColumn("cost", r("cost")).withColumn("scaled_cost", r("scaled_cost"))


@query("""WITH x AS (SELECT c_custkey, unnest(list_distinct(string_split(c_name, '0'))) AS item FROM customer)
SELECT item, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM x GROUP BY item""")
def effects_frequency(t):
    """A25"""
    x = t("customer").select(F.split("c_name", "0").alias("items"))
    return E.effect_frequency(x, "items").withColumn("share", r("share"))


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) <= 1 AS agree, min(c_mktsegment) AS value FROM customer GROUP BY 1")
def one_value(t):
    """A26, A27"""
    return E.one_value(t("customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS members, count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders) AS complete FROM orders GROUP BY 1")
def coverage_equal(t):
    """U3, A27"""
    return E.same_members(t("orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT 'union all' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)""")
def set_ops(t):
    """U1, U2, U4-U6"""
    cust, supp = t("customer"), t("supplier")
    a, b = cust.select(F.col("c_custkey").alias("k")), supp.select(F.col("s_suppkey").alias("k"))
    every = {"union all": cust.select("c_nationkey").union(supp.select("s_nationkey")), "distinct": cust.select("c_nationkey").distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct()}
    out = None
    for name, df in every.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = part if out is None else out.union(part)
    return out


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS i, l_returnflag FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM p WHERE i <= 50""")
def first_n_per_cat(t):
    """W1, O1"""
    return E.first_n(t("lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], 50).select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH live AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS i FROM live)
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE o_orderstatus END AS status FROM customer LEFT JOIN (SELECT * FROM x WHERE i = 1) ON c_custkey = o_custkey""")
def latest_else_default(t):
    """W4"""
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "P").alias("gone"))
    last = E.latest(o, ["o_custkey"], "o_orderdate", "gone")
    joined = t("customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), F.when(F.col("o_orderkey").isNull(), "missing").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""WITH p AS (SELECT DISTINCT CAST(user_id % 1000 AS BIGINT) AS k, CAST(event_id % 97 AS DOUBLE) * 1.25 + (user_id % 7) * 30 AS deg FROM events),
n AS (SELECT k, deg, coalesce(lead(deg) OVER (PARTITION BY k ORDER BY deg), first_value(deg) OVER (PARTITION BY k ORDER BY deg) + 360) AS nxt FROM p),
g AS (SELECT k, nxt - deg AS gap, nxt, row_number() OVER (PARTITION BY k ORDER BY nxt - deg DESC, deg) AS i FROM n)
SELECT k, gap, CASE WHEN 360 - gap <= 180 THEN 360 - gap END AS span, CASE WHEN 360 - gap <= 180 THEN nxt % 360.0 END AS start FROM g WHERE i = 1""")
def circular_gap(t):
    """W5, M16"""
    e = t("events").select((F.col("user_id") % 1000).alias("k"), ((F.col("event_id") % 97).cast("double") * 1.25 + (F.col("user_id") % 7) * 30).alias("deg"))
    return E.circular_gap(e, "k", "deg")


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings), m AS (SELECT vec_id, CAST(v AS DOUBLE) - min(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id) AS light FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY light DESC) AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM m)
SELECT vec_id, round(sum(CASE WHEN i <= greatest(1, round(0.1 * n)) THEN light END) / sum(light), 5) AS concentration FROM p GROUP BY 1 HAVING sum(light) > 0""")
def concentration(t):
    """A39, W3, T9"""
    e = t("embeddings").select("vec_id", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return E.concentration(e, "vec_id", "v", 0.1).where("concentration IS NOT NULL").withColumn("concentration", r("concentration", 5))


@query("""SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INT) AS bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 50) * 4.9), 6) AS density
FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1""")
def hist_density(t):
    """A38"""
    return E.density(t("lineitem"), "l_quantity", 1.0, 50.0, 10).where("n > 0").withColumn("density", r("density"))


@query("""WITH g AS (SELECT CAST(a AS INT) AS iy, CAST(b AS INT) AS ix FROM range(8) x(a) CROSS JOIN range(5) y(b)),
c AS (SELECT CAST(least(floor(l_discount / (0.1 / 8)), 7) AS INT) AS iy, CAST(least(floor((l_quantity - 1) / 9.8), 4) AS INT) AS ix, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY ALL)
SELECT iy, ix, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (iy, ix)""")
def hist2d(t):
    """A37, G4"""
    return E.field_2d(t("lineitem"), "l_quantity", "l_discount", (1.0, 50.0, 0.0, 0.1), 5, 8)


PAIRED = """p AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity > 25 AS INT) END) AS x, max(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity > 25 AS INT) END) AS y FROM lineitem GROUP BY 1),
k AS (SELECT CAST(sum(CASE WHEN x = 1 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS both_right, CAST(sum(CASE WHEN x = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b,
  CAST(sum(CASE WHEN x = 0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN x = 0 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neither FROM p WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH {PAIRED}, z AS (SELECT *, CASE WHEN b + c > 0 THEN pow(greatest(0, abs(b - c) - 1), 2) / (b + c) ELSE 0 END AS chi FROM k) SELECT both_right, b, c, neither, round(chi, 6) AS chi, round(CASE WHEN b + c > 0 THEN {S.erfc_sql('sqrt(chi / 2)')} ELSE 1 END, 6) AS p FROM z")
def paired_mcnemar(t):
    """J6, T5 (T6, the exact p, is tested against factorials)"""
    x = t("lineitem").withColumn("ok", F.col("l_quantity") > 25)
    cells = E.paired_cells(x, "l_orderkey", "l_returnflag", "R", "N", "ok")
    chi, p, _ = S.mcnemar("b", "c")
    return cells.select("both_right", "b", "c", "neither", r(chi).alias("chi"), r(p).alias("p"))


Z = f"CAST({S.Z95} AS DOUBLE)"


@query(f"""WITH g AS (SELECT l_linestatus AS side, l_returnflag AS k, count(*) AS n, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS x FROM lineitem GROUP BY ALL),
s AS (SELECT *, x / n AS p, {Z} * {Z} AS z2 FROM g)
SELECT side, k, n, x, round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS wilson_low,
  round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS wilson_high,
  round(p - {Z} * sqrt(p * (1 - p) / n), 6) AS wald_low, round(p + {Z} * sqrt(p * (1 - p) / n), 6) AS wald_high,
  round(100 * {Z} * sqrt(0.25 / n + z2 / (4.0 * n * n)) / (1 + z2 / n), 6) AS halfwidth, round(100 * ({Z} + CAST(0.8416 AS DOUBLE)) * sqrt(0.5 / n), 6) AS detectable FROM s""")
def wilson_wald(t):
    """T1, T2, T4"""
    g = t("lineitem").groupBy(F.col("l_linestatus").alias("side"), F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("x"))
    (wl, wh), (al, ah) = S.wilson("x", "n"), S.wald("x", "n")
    return g.select("side", "k", "n", "x", r(wl).alias("wilson_low"), r(wh).alias("wilson_high"), r(al).alias("wald_low"), r(ah).alias("wald_high"), r(S.wilson_halfwidth_pp("n")).alias("halfwidth"), r(S.detectable_difference_pp("n")).alias("detectable"))


@query(f"""WITH g AS (SELECT CAST(l_suppkey % 12 AS BIGINT) AS k, count(*) FILTER (l_linenumber = 1) AS n1, count(*) FILTER (l_linenumber = 2) AS n2,
  count(*) FILTER (l_linenumber = 1 AND l_quantity > 25) AS x1, count(*) FILTER (l_linenumber = 2 AND l_quantity > 25) AS x2 FROM lineitem GROUP BY 1),
z AS (SELECT *, (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM g WHERE n1 > 0 AND n2 > 0),
p AS (SELECT k, z, {S.erfc_sql('abs(z) / sqrt(2)')} AS p FROM z)
SELECT k, round(z, 6) AS z, round(p, 6) AS p, p < 0.05 / (SELECT count(*) FROM p) AS significant FROM p""")
def two_proportions(t):
    """T3, T7"""
    one, two, hit = F.col("l_linenumber") == 1, F.col("l_linenumber") == 2, F.col("l_quantity") > 25
    n = lambda cond: F.sum(cond.cast("long"))
    g = t("lineitem").groupBy((F.col("l_suppkey") % 12).alias("k")).agg(n(one & hit).alias("x1"), n(one).alias("n1"), n(two & hit).alias("x2"), n(two).alias("n2")).where("n1 > 0 AND n2 > 0")
    z, p = S.two_proportions("x1", "n1", "x2", "n2")
    tested = g.select("k", z.alias("z"), p.alias("p"))
    family = tested.agg(F.count("*").alias("m"))
    return tested.crossJoin(F.broadcast(family)).select("k", r("z").alias("z"), r("p").alias("p"), S.bonferroni("p", "m").alias("significant"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(t):
    """Tumbling windows (a Spark built-in that a user gets besides)"""
    from ..streaming.incremental import windowed_counts as w

    return w(t("events")).withColumn("total", r("total", 4))


@query("""WITH v AS (SELECT l_orderkey AS fig, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem) SELECT fig, count(v) AS finite, count(DISTINCT v) <= 1 AS blank FROM v GROUP BY fig""")
def blank_panels(t):
    """P15"""
    return E.blank_panels(t("lineitem").select(F.col("l_orderkey").alias("fig"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("v")), ["fig"], "v")


@query("""SELECT said, count(*) AS n FROM (SELECT coalesce(nullif(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END, ''), 'fallback') AS said FROM events) GROUP BY said""")
def first_answer(t):
    """P16"""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "").when(k == 1, None).otherwise(F.col("event_type"))
    return t("events").select(E.first_answer(raw, F.lit("fallback")).alias("said")).groupBy("said").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) > min(l_extendedprice)")
def value_ranges(t):
    """A31, A32"""
    return E.value_ranges(t("lineitem"), ["l_orderkey"], "l_extendedprice")


@query("""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT p, max(n) AS own FROM c GROUP BY 1) SELECT p, own, (SELECT max(own) FROM m) AS shared FROM m""")
def shared_limit(t):
    """A40"""
    return E.shared_limit(t("orders").groupBy(F.col("o_orderpriority").alias("p"), "o_orderstatus").agg(F.count("*").alias("n")), "p", "n")


@query("""WITH v AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10) SELECT 'verified' AS kind, count(*) AS n FROM orders WHERE o_custkey IN (SELECT k FROM v) UNION ALL SELECT 'skipped', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM v)""")
def verified_truth(t):
    """J2"""
    good, skipped = E.verified(t("orders").select(F.col("o_custkey").alias("k")), t("customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")), ["k"])
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(good, "verified").union(count(skipped, "skipped"))


@query(f"""WITH {WORDED}, a AS (SELECT model, truth, 100 * avg(CASE WHEN run = 0 THEN CAST({CORRECT} AS DOUBLE) END) AS x, 100 * avg(CASE WHEN run = 1 THEN CAST({CORRECT} AS DOUBLE) END) AS y FROM w GROUP BY ALL)
SELECT model, truth, round(x, 6) AS first, round(y, 6) AS second, round(y - x, 6) AS change FROM a""")
def run_difference(t):
    """J7"""
    w = worded(t).withColumn("ok", F.coalesce(S.normalise_answer("answer") == S.normalise_answer("truth"), F.lit(False)))
    found = E.run_difference(w, ["model", "truth"], "run", 0, 1, "ok")
    return found.select("model", "truth", r("first").alias("first"), r("second").alias("second"), r("change").alias("change"))


@query("""WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(avg((least(greatest(l_extendedprice, lo), hi) - lo) / (hi - lo)), 6) AS mean FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1""")
def clip_stretch(t):
    """M26"""
    s = E.clip_stretch(t("lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return s.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("stretched")).alias("mean"))


@query("SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 4 AS INT) AS worker FROM nation")
def round_robin(t):
    """W9, D1, D5"""
    return E.round_robin(t("nation").select("n_nationkey"), "n_nationkey", 4)


@query("SELECT p_brand, min(p_retailprice) AS minimum, max(p_retailprice) AS maximum, round(median(p_retailprice), 6) AS median, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def named_statistics(t):
    """D8"""
    found = E.statistics(t("part"), ["p_brand"], "p_retailprice", ["minimum", "maximum", "median", "mean"])
    return found.withColumn("median", r("median")).withColumn("mean", r("mean"))

