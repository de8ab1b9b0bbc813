"""Queries of tallies, samples and flags, and of generated fields and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import fields as G
from ..operators import relate as R
from ..operators.keys import small_side
from .registry import query, r


@query("SELECT n_regionkey, min(c) AS min, max(c) AS max, sum(c)::BIGINT AS sum FROM (SELECT n_nationkey, n_regionkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def group_extremes(t):
    """A2"""
    n = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return E.extremes(n.join(t("nation"), "n_nationkey"), ["n_regionkey"], "c")


@query("SELECT c_mktsegment, count(*) AS size, count(v) AS finite, round(avg(v), 6) AS mean FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 9 > 1 THEN c_acctbal END AS v FROM customer) GROUP BY 1")
def finite_means(t):
    """Neither NaN nor infinity counts"""
    k = F.col("c_custkey") % 9
    v = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).otherwise(F.col("c_acctbal"))
    return E.finite_mean(t("customer").select("c_mktsegment", v.alias("v")), ["c_mktsegment"], "v").withColumn("mean", r("mean"))


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS i FROM customer) WHERE i = 1")
def largest_rows(t):
    """The row of the largest value of each key"""
    return E.row_of_largest(t("customer").select("c_mktsegment", "c_acctbal", "c_custkey"), ["c_mktsegment"], "c_acctbal")


@query("SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS statuses, array_to_string(list_sort(list(DISTINCT o_custkey % 7)), '|') AS keys FROM orders GROUP BY 1")
def value_sets(t):
    """A30"""
    s = E.value_sets(t("orders").select("o_orderpriority", F.col("o_orderstatus").alias("statuses"), (F.col("o_custkey") % 7).alias("keys")), ["o_orderpriority"], ["statuses", "keys"])
    return s.select("o_orderpriority", F.array_join("statuses", "|").alias("statuses"), F.array_join(F.transform("keys", lambda x: x.cast("string")), "|").alias("keys"))


@query("SELECT s AS status, count(l_quantity) AS n FROM (VALUES ('ok'), ('gave up'), ('error'), ('never'), ('other')) v(s) LEFT JOIN lineitem ON s = CASE WHEN l_quantity > 30 THEN 'ok' WHEN l_discount > 0.05 THEN 'gave up' WHEN l_tax > 0.04 THEN 'error' ELSE 'other' END GROUP BY 1")
def status_tally(t):
    """The first status that holds; one that never does counts 0"""
    q = F.col("l_quantity")
    return E.tally(t("lineitem"), [("ok", q > 30), ("gave up", F.col("l_discount") > 0.05), ("error", F.col("l_tax") > 0.04), ("never", q < 0)])


@query("SELECT i::INT AS bin, count(l_quantity) AS n FROM (VALUES (0, 1, 5), (1, 5, 20), (2, 20, 20.5), (3, 20.5, 50)) e(i, a, b) LEFT JOIN lineitem ON l_quantity >= a AND (l_quantity < b OR i = 3 AND l_quantity = b) GROUP BY 1")
def edge_histogram(t):
    """Given edges of unequal width, the last closed"""
    return E.histogram_of(t("lineitem"), "l_quantity", [1.0, 5.0, 20.0, 20.5, 50.0])


@query("""WITH x AS (SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal) FILTER (c_custkey % 2 = 0), 4) AS a, round(avg(c_acctbal) FILTER (c_custkey % 2 = 1), 4) AS b FROM customer GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, a, b, round(b - a, 4) AS diff FROM x WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY abs(b - a) DESC, c_mktsegment, c_nationkey LIMIT 5""")
def largest_changes(t):
    """O2: the five cells that differ most (the limit is the feature)"""
    even = F.col("c_custkey") % 2 == 0
    mean = lambda cond: r(F.avg(F.when(cond, F.col("c_acctbal"))), 4)
    x = t("customer").groupBy("c_mktsegment", "c_nationkey").agg(mean(even).alias("a"), mean(~even).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return E.largest_changes(x, "a", "b", 5).withColumn("diff", r("diff", 4))


ORDER = "({} * 7919 + 104729) % 1000003"


@query(f"""WITH kept AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000), rest AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {ORDER.format('o_orderkey')}, o_orderkey) AS i FROM orders WHERE o_totalprice <= 400000)
SELECT o_orderpriority, o_orderkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderpriority, o_orderkey FROM rest WHERE i <= 35""")
def grown_sample(t):
    """A sample kept and 35 more of each class (the limit is the feature)"""
    o = t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    kept = o.where("o_totalprice > 400000").select("o_orderkey")
    return R.grow_sample(o.drop("o_totalprice"), kept, ["o_orderpriority"], "o_orderkey", 35)


@query(f"SELECT o_orderkey, ['fold', 'ink', 'stain'][1 + least(2, CAST(floor({ORDER.format('o_orderkey')} / 1000003.0 * 3) AS INT))] AS choice FROM orders")
def uniform_choice(t):
    """O6"""
    items = F.array(F.lit("fold"), F.lit("ink"), F.lit("stain"))
    return t("orders").select("o_orderkey", R.uniform_choice(R.keyed_order("o_orderkey") / 1000003.0, items).alias("choice"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM e WHERE i NOT IN (0, 5, vec_id % 64) GROUP BY 1""")
def deleted_places(t):
    """Arrays without the elements at some places"""
    kept = R.without_places("embedding", F.array(F.lit(0), F.lit(5), (F.col("vec_id") % 64).cast("int")))
    return t("embeddings").select("vec_id", F.size(kept).cast("long").alias("n"), r(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS k, 'A' AS v FROM supplier WHERE s_acctbal > 5000) SELECT c_custkey, c_nationkey AS k, m.k IS NOT NULL AS known, c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') AS allowed FROM customer LEFT JOIN m ON m.k = c_nationkey AND m.v = CASE WHEN c_acctbal > 0 THEN 'A' ELSE 'B' END""")
def known_flags(t):
    """A flag for composite keys on a list, and exclusion of a set"""
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") > 0, "A").otherwise("B").alias("v"), (~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).alias("allowed"))
    listed = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit("A").alias("v"))
    return R.flagged(c, listed, ["k", "v"]).drop("v")


@query("""SELECT c_custkey, n_name, n_regionkey, CASE WHEN c_nationkey < 20 THEN n_name END AS enriched FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def checked_lookup(t):
    """A look-up in which every key must be found, and one in which some aren't"""
    nations = t("nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    found = R.required(t("customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), nations, "k")
    some = nations.where("k < 20").select("k", F.col("n_name").alias("enriched"))
    return R.enriched(found, some, "k", ["enriched"]).drop("k")


@query("SELECT fig, bool_and(ok) AS accepted, count_if(NOT ok)::BIGINT AS rejected FROM (SELECT l_orderkey AS fig, l_quantity BETWEEN 2 AND 48 AND l_discount * 4 + 0.3 > 0.38 AND l_tax * 100 BETWEEN -1 AND 8 AS ok FROM lineitem) GROUP BY fig")
def accepted_figures(t):
    """Figures all of whose panels pass the range tests"""
    ok = F.col("l_quantity").between(2, 48) & (F.col("l_discount") * 4 + 0.3 > 0.38) & (F.col("l_tax") * 100).between(-1, 8)
    return t("lineitem").groupBy(F.col("l_orderkey").alias("fig")).agg(F.bool_and(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query("""WITH n AS (SELECT DISTINCT (s_suppkey * 7) % 20 AS b, (s_suppkey * 3) % 15 AS c FROM supplier), m AS (SELECT b, c, b + c AS n, least(b, c) AS low FROM n),
i AS (SELECT b, c, n, unnest(range(0, low + 1)) AS i FROM m), p AS (SELECT b, c, n, sum(factorial(n::INT)::DOUBLE / (factorial(i::INT)::DOUBLE * factorial((n - i)::INT)::DOUBLE)) AS ways FROM i GROUP BY b, c, n)
SELECT b, c, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * ways / pow(2, n)) END, 9)::DOUBLE AS exact, round(CASE WHEN n = 0 THEN 0 ELSE pow(greatest(0, abs(b - c) - 1), 2) / n END, 6)::DOUBLE AS chi FROM p""")
def exact_binomial(t):
    """The exact two-sided p of discordant counts, by factorials in the SQL"""
    k = F.col("s_suppkey")
    x = t("supplier").select((k * 7 % 20).alias("b"), (k * 3 % 15).alias("c")).distinct()
    chi, _, exact = S.mcnemar("b", "c")
    return x.select("b", "c", r(exact, 9).alias("exact"), r(chi).alias("chi"))


@query("""WITH c AS (VALUES ('0.04', '<0.05', true), ('0.06', '<0.05', false), ('7', '>5', true), ('4', '>5', false), ('52', '~50', true), ('56', '~50', false), ('10.397', '10.4', true), ('10.2', '10.4', false), ('12.5', '12', true), ('12.6', '12', false), ('yes', 'yes', true), ('yes', 'no', false))
SELECT r_regionkey::INT AS section, col0 AS computed, col1 AS paper, col2 AS ok FROM c, region""")
def check_claims(t):
    """Bounds, approximate values, numbers as rounded in print, words"""
    cases = [("0.04", "<0.05"), ("0.06", "<0.05"), ("7", ">5"), ("4", ">5"), ("52", "~50"), ("56", "~50"), ("10.397", "10.4"), ("10.2", "10.4"), ("12.5", "12"), ("12.6", "12"), ("yes", "yes"), ("yes", "no")]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("computed"), F.lit(b).alias("paper")) for a, b in cases])).alias("c")
    return E.claims(t("region").select(F.col("r_regionkey").alias("section"), rows).select("section", "c.*"))


# --- generated fields and baselines ----------------------------------------------------------------------------


@query()
def noisy_field(t):
    """A plane with multiplicative and one with additive noise. Hashed draws: tested for mean, spread and repeatability"""
    f = t("region").select(F.col("r_regionkey").alias("k"), F.lit(64).alias("nx"), F.lit(64).alias("ny"))
    return G.linear_fields(f, "k", 1, noise=0.1).withColumn("added", S.noisy("value", 7, "k", "iy", "ix", scale=0.5, additive=True))


U = "(((k + {i} * 101) * 7919 + 104729) % 1000003 / 1000003.0)"


def keyed(k, i):
    """Draws that the SQL makes alike."""
    return R.keyed_order(k + (F.lit(i) if isinstance(i, int) else i) * 101) / 1000003.0


@query(f"""WITH q AS (SELECT c_custkey AS k FROM customer), t AS (SELECT k, i, -3 + {U.format(i='(4 * i)')} * 13 AS a, -3 + {U.format(i='(4 * i + 1)')} * 13 AS b, 2 + {U.format(i='(4 * i + 2)')} * 3 AS c, 2 + {U.format(i='(4 * i + 3)')} * 3 AS d FROM q, range(6) r(i)),
ok AS (SELECT k, min(i) AS i FROM t WHERE a <> b AND c <> d AND abs(a - b) <= 1.2 * abs(c - d) AND abs(c - d) <= 1.2 * abs(a - b) GROUP BY 1),
w AS (SELECT k, -3 + {U.format(i=24)} * 36 AS a, -3 + {U.format(i=25)} * 36 AS b, 2 + {U.format(i=26)} * 20 AS c, 2 + {U.format(i=27)} * 20 AS d FROM q),
r AS (SELECT k, a, b, c, d, true AS fits FROM t JOIN ok USING (k, i) UNION ALL SELECT k, a, b, c, d, false FROM w WHERE k NOT IN (SELECT k FROM ok))
SELECT k, round(least(a, b), 6) AS xmin, round(greatest(a, b), 6) AS xmax, round(least(c, d), 6) AS ymin, round(greatest(c, d), 6) AS ymax, round(10 * least({U.format(i=28)}, {U.format(i=29)}), 6) AS cmin, round(10 * greatest({U.format(i=28)}, {U.format(i=29)}), 6) AS cmax FROM r""")
def range_picks(t):
    """Ranges of fields, the first of six picks with an aspect within 1.2, else a wider one"""
    found = G.field_ranges(t("customer").select(F.col("c_custkey").alias("k")), "k", keyed, (-3.0, 10.0), (2.0, 5.0), (0.0, 10.0), 1.2, tries=6)
    return found.select("k", *[r(x).alias(x) for x in ("xmin", "xmax", "ymin", "ymax", "cmin", "cmax")])


@query(f"""WITH q AS (SELECT p_partkey AS k FROM part), u AS (SELECT k, {", ".join(U.format(i=i) + f" AS u{i}" for i in range(7))} FROM q),
s AS (SELECT *, CASE WHEN u0 < 0.5 THEN 'first' WHEN u0 < 0.8 THEN 'all' ELSE 'none' END AS style, ['flux', 'mass', 'age'][1 + least(2, CAST(floor(u1 * 3) AS INT))] AS n1, ['flux', 'mass', 'age'][1 + least(2, CAST(floor(u4 * 3) AS INT))] AS n2, ['$x$', '$y_2$'][1 + least(1, CAST(floor(u3 * 2) AS INT))] AS m1, ['$x$', '$y_2$'][1 + least(1, CAST(floor(u6 * 2) AS INT))] AS m2 FROM u),
w AS (SELECT *, CASE style WHEN 'first' THEN upper(n1[1]) || n1[2:] WHEN 'all' THEN upper(n1) ELSE n1 END AS w1, CASE style WHEN 'first' THEN upper(n2[1]) || n2[2:] WHEN 'all' THEN upper(n2) ELSE n2 END AS w2, u2 < 0.4 AS shown, CASE WHEN u1 < 0.5 THEN 'first' ELSE 'all' END AS cap, ['1900', '1950', '2000'][1 + least(2, CAST(floor(u3 * 3) AS INT))] AS year FROM s)
SELECT k, CASE WHEN u2 <= 0.25 THEN m1 ELSE w1 END || ' ' || CASE WHEN u5 <= 0.25 THEN m2 ELSE w2 END AS label, CASE WHEN u0 < 0.5 THEN CASE cap WHEN 'first' THEN 'Right Ascension' ELSE 'RIGHT ASCENSION' END ELSE '$\\alpha$' END || CASE WHEN shown THEN CASE WHEN u4 < 0.5 THEN ' (J' || year || ')' ELSE ' ' || year END ELSE '' END AS ra,
  CASE WHEN u0 < 0.5 THEN CASE cap WHEN 'first' THEN 'Declination' ELSE 'DECLINATION' END ELSE '$\\delta$' END || CASE WHEN shown THEN CASE WHEN u4 < 0.5 THEN ' (J' || year || ')' ELSE ' ' || year END ELSE '' END AS dec FROM w""")
def invented_labels(t):
    """Titles of nouns and inline math, and labels of sky axes with their equinox"""
    k = F.col("p_partkey")
    label = G.label_text(keyed, k, ["flux", "mass", "age"], 2, ["$x$", "$y_2$"], 0.25, [("first", 0.5), ("all", 0.3), ("none", 0.2)])
    ra, dec = G.sky_labels(keyed, k, [("right ascension", "declination"), ("$\\alpha$", "$\\delta$")], 0.4, [("(J", ")"), ("", "")], [("first", 1.0), ("all", 1.0)])
    return t("part").select(k.alias("k"), label.alias("label"), ra.alias("ra"), dec.alias("dec"))


@query(f"""WITH q AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT s_name AS object, s_nationkey AS pdf, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier), s AS (SELECT list_sort(list(n_name)) AS every FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7')),
m AS (SELECT DISTINCT s_name AS object, n_name AS survey FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 3 > 0 OR s_suppkey % 10 = 4), c AS (SELECT k, p.object, p.pdf, {U.format(i=1)} AS u FROM q JOIN p ON p.n = least((SELECT count(*) FROM p) - 1, CAST(floor({U.format(i=0)} * (SELECT count(*) FROM p)) AS BIGINT))),
l AS (SELECT p.object, list_sort(list(n_name)) AS rest FROM p, nation WHERE n_name NOT IN ('NATION_3', 'NATION_7') AND NOT EXISTS (SELECT 1 FROM m WHERE m.object = p.object AND m.survey = n_name) GROUP BY 1)
SELECT k, c.object, pdf, rest[1 + least(len(rest) - 1, CAST(floor(u * len(rest)) AS INT))] AS survey FROM c LEFT JOIN l USING (object)""")
def cutout_picks(t):
    """An object for each request, and one of the surveys that have it"""
    supplier = t("supplier")
    pool = E.numbered(supplier, [F.col("s_suppkey")], "n").select(F.col("s_name").alias("object"), F.col("s_nationkey").alias("pdf"), "n")
    surveys = t("nation").select(F.col("n_name").alias("survey"), "n_nationkey")
    gone = supplier.join(small_side(surveys), ((F.col("s_suppkey") + F.col("n_nationkey")) % 3 > 0) | (F.col("s_suppkey") % 10 == 4))
    missing = gone.select(F.col("s_name").alias("object"), F.col("s_nationkey").alias("pdf"), "survey")
    return G.pick_cutouts(t("orders").select(F.col("o_orderkey").alias("k")), "k", pool, surveys.select("survey"), missing, ["NATION_3", "NATION_7"], keyed)


@query()
def field_dispatch(t):
    """Random, linear and clustered fields of customers' figures. Hashed draws: tested for ranges, shape and repeatability"""
    n = t("nation").select(F.col("n_nationkey").cast("string").alias("fig_id"), F.element_at(F.array(F.lit("random"), F.lit("linear"), F.lit("gmm")), (F.col("n_nationkey") % 3 + 1)).alias("distribution"), (F.col("n_nationkey") % 5 + 12).alias("nx"), F.lit(9).alias("ny"))
    return G.fields(G.field_ranges(n, "fig_id", G.hashed(8), (-3.0, 10.0), (2.0, 5.0), (1.0, 10.0), 2.0), 5)


@query()
def plot_data(t):
    """Lines in order of x and scattered points"""
    n = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3 + 1).alias("lines"), F.lit(20).alias("points"))
    lines = G.line_data(n, "k", 3).withColumn("color", F.lit(None).cast("double"))
    return lines.unionByName(G.scatter_data(n, "k", 4).withColumn("line", F.lit(-1)))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders)
SELECT place % 4 AS worker, count(*) AS n, sum(place)::BIGINT AS places, round(sum(o_totalprice * 2 + place), 2)::DOUBLE AS total, min(place) AS first FROM o GROUP BY 1""")
def strided_work(t):
    """Work dealt to four workers in turn, done in Python, and gathered"""
    o = t("orders").select("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("price"))

    def work(frames):
        for f in frames:
            yield f.assign(value=2 * f.price + f.place)[["place", "worker", "value"]]

    done = R.strided_map(o, ["o_orderdate", "o_orderkey"], 4, work, "place long, worker long, value double")
    return done.groupBy("worker").agg(F.count("*").alias("n"), F.sum("place").alias("places"), r(F.sum("value"), 2).alias("total"), F.min("place").alias("first"))


FEATURES = ["field_size", "concentration", "span", "sign"]


def labelled_features(t):
    """Four features of fields, with a binary label."""
    e = t("embeddings").select("vec_id", F.col("label"), (F.col("vec_id") % 50 + 1).cast("double").alias("w"), (F.col("vec_id") % 30 + 1).cast("double").alias("h"), F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return E.sky_features(e, "vec_id", "v", "w", "h", 0.1).join(t("embeddings").select("vec_id", (F.col("label") % 2).alias("label")), "vec_id")


@query()
def baseline_table(t):
    """Boosted trees by stratified folds on four features of fields: the commonest label, all features, each alone, all but each"""
    return G.baselines(labelled_features(t), "label", "vec_id", FEATURES)


@query()
def feature_importances(t):
    """How much each feature adds to trees over all fields. A trained model: tested on separable data"""
    return G.importances(labelled_features(t), "label", FEATURES)
