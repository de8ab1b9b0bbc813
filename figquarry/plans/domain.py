"""Queries of the domain: joins, boxes, sampling, strings, numbers, sky geometry, nested records, fields, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import scalars as S
from ..operators import fields as G
from ..operators import relate as R
from ..operators.ordered import numbered
from ..sources import files as IO
from ..streaming import incremental as I
from .registry import query, r

# --- joins and sets --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def left_anti_resume(t):
    """J16, P9, ST1: orders not yet finished: finished ones have both parts"""
    li = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return I.remaining(t("orders").select("o_orderkey"), li.where("l_linestatus = 'F'"), li.where("l_returnflag = 'N'"), keys=["o_orderkey"])


NORM = "lower(trim(regexp_replace({}, '[\\s_\\-]+', ' ', 'g')))"


@query(f"""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN upper(replace(p_type, ' ', '_')) ELSE 'no ' || p_type END AS p_type FROM part),
d AS (SELECT p_type, max(p_size) AS size FROM part GROUP BY 1), n AS (SELECT {NORM.format('p_type')} AS norm, min_by(size, p_type) AS size FROM d GROUP BY 1)
SELECT p_partkey, coalesce(d.size, n.size) AS size, CASE WHEN d.size IS NOT NULL THEN 'exact' WHEN n.size IS NOT NULL THEN 'normalised' ELSE 'none' END AS tier
FROM l LEFT JOIN d USING (p_type) LEFT JOIN n ON n.norm = {NORM.format('l.p_type')}""")
def two_tier_lookup(t):
    """J4, F3"""
    k = F.col("p_partkey") % 3
    left = t("part").select("p_partkey", F.when(k == 0, F.col("p_type")).when(k == 1, F.upper(F.replace("p_type", F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("no "), "p_type")).alias("p_type"))
    right = t("part").groupBy("p_type").agg(F.max("p_size").alias("size"))
    return R.two_tier(left, right, "p_type", "size").select("p_partkey", "size", "tier")


@query("""WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey + 5 AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, customers, suppliers FROM a FULL JOIN b ON a.nation = b.nation""")
def fullouter_coalesce(t):
    """The suppliers' keys are moved, so that either side has some of its own"""
    a = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = t("supplier").groupBy((F.col("s_nationkey") + 5).alias("nation")).agg(F.count("*").alias("suppliers"))
    return R.merge_sides(a, b, "nation")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def reconcile_counts(t):
    """J8, J11"""
    count = lambda df: df.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return R.reconcile(count(t("lineitem")), count(t("lineitem").where("l_quantity > 3")), "k", "n")


@query("SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def category_join(t):
    """Facts with dimension rows; nothing is left over"""
    nations, lost = R.with_category(t("nation").withColumnRenamed("n_regionkey", "key"), t("region").withColumnRenamed("r_regionkey", "key"), "key")
    facts, lost = R.with_category(t("customer").select(F.col("c_nationkey").alias("key")), nations.select(F.col("n_nationkey").alias("key"), "n_name", "r_name"), "key")
    return facts.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"))


BOXES = """x AS (SELECT l_orderkey AS fig, l_linenumber AS label, l_quantity AS xmin, l_quantity + 8 AS xmax, l_discount * 100 AS ymin, l_discount * 100 + 4 AS ymax FROM lineitem)"""


def boxes(t):
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return t("lineitem").select(F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("label"), q.alias("xmin"), (q + 8).alias("xmax"), d.alias("ymin"), (d + 4).alias("ymax"))


@query(f"""WITH {BOXES}, p AS (SELECT a.fig, a.label AS first, b.label AS second, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS w, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS h,
  (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) AS area FROM x a JOIN x b ON a.fig = b.fig AND a.label < b.label)
SELECT fig, first, second, round(w * h / (area - w * h + 1e-6), 6) AS iou FROM p WHERE w > 1e-9 AND h > 1e-9""")
def box_overlap_selfjoin(t):
    """J12, B1-B4, O10"""
    return R.overlapping(boxes(t), "fig", "label").where("iou > 1e-12").withColumn("iou", r("iou"))


@query("SELECT fig, round(sum((xmax - xmin) * (ymax - ymin)) / 10000.0, 6) AS fraction, bool_and(xmax <= 60 AND ymax <= 15) AS on_page FROM (SELECT * FROM (WITH " + BOXES + " SELECT * FROM x)) GROUP BY fig")
def area_fraction(t):
    """B5, P18"""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return boxes(t).groupBy("fig").agg(r(F.sum(area) / 10000.0).alias("fraction"), F.bool_and((F.col("xmax") <= 60) & (F.col("ymax") <= 15)).alias("on_page"))


@query("""WITH k AS (SELECT *, floor(c_acctbal / 10.0) AS b FROM customer), d AS (SELECT b, count(*) AS rows, count(DISTINCT c_mktsegment) AS sources FROM k GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1)
SELECT c_custkey, rows, sources FROM k JOIN d USING (b)""")
def dup_coord(t):
    """J13, W6, P17"""
    return R.duplicates(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), [F.floor(F.col("c_acctbal") / 10.0)], "c_mktsegment").select("c_custkey", "rows", "sources")


SEP = "2 * asin(least(1.0, sqrt(pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2))))"


@query(f"""WITH p AS (SELECT c_custkey, c_nationkey AS k, CAST(c_custkey * 37 % 360 AS DOUBLE) AS ra1, CAST(c_custkey * 11 % 120 AS DOUBLE) - 60 AS dec1 FROM customer),
q AS (SELECT s_suppkey, s_nationkey AS k, CAST(s_suppkey * 53 % 360 AS DOUBLE) + 0.5 AS ra2, CAST(s_suppkey * 17 % 120 AS DOUBLE) - 60.25 AS dec2 FROM supplier),
s AS (SELECT c_custkey, s_suppkey, degrees({SEP}) AS sep FROM p JOIN q USING (k))
SELECT c_custkey, round(min(sep), 6) AS separation FROM s GROUP BY 1""")
def nearest_target(t):
    """J14, M19"""
    p = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 37 % 360).cast("double").alias("ra"), ((F.col("c_custkey") * 11 % 120).cast("double") - 60).alias("dec"))
    q = t("supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("k"), ((F.col("s_suppkey") * 53 % 360).cast("double") + 0.5).alias("ra"), ((F.col("s_suppkey") * 17 % 120).cast("double") - 60.25).alias("dec"))
    return R.nearest(p, q, "k").select("c_custkey", r("separation").alias("separation"))


@query("""WITH s AS (SELECT l_orderkey AS fig, l_quantity AS x0, l_quantity + 10 + l_linenumber * 3 AS x1, l_tax * 100 AS y FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY fig ORDER BY x1 - x0 DESC, x0, y) AS r FROM s),
p AS (SELECT a.fig, a.r AS i, b.r AS j, a.y AS y0, b.y AS y1, row_number() OVER (PARTITION BY a.fig ORDER BY a.r, b.r) AS n FROM k a JOIN k b ON a.fig = b.fig AND a.r < b.r
  WHERE a.r <= 8 AND b.r <= 8 AND abs(a.y - b.y) > 0.15 * 10 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) > 0.5)
SELECT fig, CAST(i AS INT) AS i, CAST(j AS INT) AS j, y0, y1 FROM p WHERE n = 1""")
def segment_pairs(t):
    """J15, B8"""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    s = t("lineitem").select(F.col("l_orderkey").alias("fig"), q.alias("x0"), (q + 10 + n * 3).alias("x1"), (F.col("l_tax") * 100).alias("y"))
    return R.segment_pairs(s, "fig", 10.0)


ORDER = "({} * 7919 + 104729) % 1000003"


@query(f"WITH x AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {ORDER.format('o_orderkey')}, o_orderkey) AS i FROM orders) SELECT o_orderpriority, o_orderkey FROM x WHERE i <= 35")
def keyed_sample(t):
    """A sampling operator (the limit is the feature)"""
    return R.sample_per_group(t("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 35)


@query(f"""WITH known AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS number FROM supplier WHERE s_suppkey % 2 = 0), new AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 <> 0)
SELECT k, number FROM known UNION ALL SELECT k, (SELECT max(number) FROM known) + row_number() OVER (ORDER BY {ORDER.format('k')}, k) FROM new""")
def assign_ids(t):
    """W7, O9, U6"""
    s = t("supplier").select(F.col("s_suppkey").alias("k"))
    known = numbered(s.where("k % 2 = 0"), [F.col("k")]).withColumn("number", F.col("number") + 1)
    return R.assign_ids(known, s, "k")


@query(f"""WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY {ORDER.format('s_suppkey')}, s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier),
k AS (SELECT c_custkey, row_number() OVER (ORDER BY {ORDER.format('c_custkey')}, c_custkey) - 1 AS k FROM customer)
SELECT c_custkey, s_suppkey FROM k JOIN p ON k.k % p.n = p.p""")
def pool_assign(t):
    """W8, G7"""
    return R.assign_pool(t("customer").select("c_custkey"), t("supplier").select("s_suppkey"), "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query(f"""WITH u AS (SELECT o_orderkey, {ORDER.format('o_orderkey')} / 1000003.0 AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'random' WHEN u < 0.8 THEN 'linear' ELSE 'gmm' END AS choice FROM u""")
def weighted_choice(t):
    """O5, O6"""
    u = R.keyed_order("o_orderkey") / 1000003.0
    return t("orders").select("o_orderkey", R.weighted_choice(u, [("random", 5), ("linear", 3), ("gmm", 2)]).alias("choice"))


@query("SELECT object, wavelength, pdf, itable FROM (SELECT p_name AS object, p_type AS wavelength, p_brand AS pdf, p_size AS itable FROM part) WHERE contains(lower(replace(object, ' ', '')), 'redwidget') AND contains(lower(wavelength), 'e') AND contains(translate(lower(pdf), '._', ''), 'brand#1') AND wavelength NOT IN ('EXCLUDED')")
def object_filter(t):
    """P8, P10-P12"""
    p = t("part").select(F.col("p_name").alias("object"), F.col("p_type").alias("wavelength"), F.col("p_brand").alias("pdf"), F.col("p_size").alias("itable"))
    return p.where(R.object_filter(object="Red Widget", wavelength="E", pdf="Brand_#1") & ~F.col("wavelength").isin("EXCLUDED"))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 60.0 * (s_suppkey % 7 + 1) WHEN 2 THEN 2.5 * (s_suppkey % 9 + 1) ELSE s_suppkey % 30 END::DOUBLE AS res,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 11 * 4000 AS DOUBLE) END AS fov, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 13 * 60 AS DOUBLE) END AS major, (s_suppkey % 100) / 100.0 AS u FROM supplier),
h AS (SELECT *, CASE WHEN res IS NOT NULL AND fov > 0 THEN 50 * res END AS lo, CASE WHEN res IS NOT NULL AND fov > 0 THEN least(0.75 * fov, 18000) END AS hi FROM s),
b AS (SELECT k, CASE WHEN lo >= hi THEN hi ELSE lo END AS low, hi AS high, CASE WHEN lo < hi THEN lo END AS strict_low, CASE WHEN major > 0 THEN 3 * major END AS size3, u FROM h)
SELECT k, low, high, strict_low, round(CASE WHEN size3 IS NULL THEN exp(ln(low) + u * (ln(high) - ln(low))) WHEN low IS NULL THEN size3 ELSE least(greatest(size3, low), high) END, 4) AS size,
  CASE WHEN low IS NULL THEN 'none' ELSE 'ranged' END AS policy FROM b""")
def survey_field_size(t):
    """By the published rule: 50 resolutions to 0.75 of the field of view, 5 degrees at most; where they cross, the upper end holds"""
    k = F.col("s_suppkey")
    stated = F.when(k % 5 == 1, F.concat((k % 7 + 1).cast("string"), F.lit(" arcmin"))).when(k % 5 > 2, F.concat((k % 30).cast("string"), F.lit('"'))).otherwise("unknown")
    pixel = F.when(k % 5 == 2, (k % 9 + 1).cast("double"))
    s = t("supplier").select(k.alias("k"), R.survey_resolution(stated, pixel).alias("res"), F.when(k % 3 != 0, (k % 11 * 4000).cast("double")).alias("fov"), F.when(k % 4 != 0, (k % 13 * 60).cast("double")).alias("major"), ((k % 100) / 100.0).alias("u"))
    low, high = R.survey_range("res", "fov")
    strict, _ = R.survey_range("res", "fov", on_conflict="none")
    ranged = s.withColumn("low", low).withColumn("high", high).withColumn("strict_low", strict)
    sized = R.field_size_by(ranged, lambda low, high, major, u: r(R.field_size(major, low, high, u), 4), "size")
    sized = R.field_size_by(sized, lambda low, high, major, u: F.when(low.isNull(), "none").otherwise("ranged"), "policy")
    return sized.select("k", "low", "high", "strict_low", "size", "policy")


@query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS plan FROM customer), p AS (SELECT c_custkey + 40 AS k, CASE WHEN c_acctbal < 0 THEN 'OTHER' ELSE c_mktsegment END AS plan FROM customer)
SELECT coalesce(s.k, p.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.plan ELSE p.plan END AS plan, CASE WHEN s.k IS NULL THEN 'new' WHEN p.k IS NULL THEN 'unverified' WHEN s.plan IS NOT DISTINCT FROM p.plan THEN 'same' ELSE 'changed' END AS status FROM s FULL JOIN p ON s.k = p.k""")
def plan_drift(t):
    """ST3: the recomputed plans' keys are moved by 40, so that the first are unverified and the last new"""
    k = F.col("c_custkey")
    s = t("customer").select(k.alias("k"), F.col("c_mktsegment").alias("plan"))
    p = t("customer").select((k + 40).alias("k"), F.when(F.col("c_acctbal") < 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("plan"))
    return I.drift(s, p, "k", ["plan"])


# --- strings and numbers ---------------------------------------------------------------------------------------


@query("""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p[^>]*>')) AS paragraphs FROM pages""")
def regex_fields(t):
    """F12, S13, S15"""
    return t("pages").select("page_id", IO.html_field("html", "<title>(.*?)</title>").alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<p[^>]*>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN '1,234' WHEN 1 THEN '1.5^-2' WHEN 2 THEN '2**3' WHEN 3 THEN '1.2e(-5)' WHEN 4 THEN chr(8722) || '7.25' WHEN 5 THEN 'abc' WHEN 6 THEN 'inf' WHEN 7 THEN '1_0' ELSE CAST(c_custkey AS VARCHAR) || '.5' END AS s FROM customer)
SELECT c_custkey, round(CASE c_custkey % 9 WHEN 0 THEN 1234.0 WHEN 1 THEN 0.015 WHEN 2 THEN 2000.0 WHEN 3 THEN 0.000012 WHEN 4 THEN -7.25 WHEN 8 THEN c_custkey + 0.5 END::DOUBLE, 6) AS x FROM n""")
def numeric_strings(t):
    """M1, M2"""
    k = F.col("c_custkey") % 9
    text = F.lit(None).cast("string")
    for i, s in enumerate(["1,234", "1.5^-2", "2**3", "1.2e(-5)", "−7.25", "abc", "inf", "1_0"]):
        text = F.when(k == i, s).otherwise(text)
    return t("customer").select("c_custkey", r(S.as_float(F.coalesce(text, F.concat(F.col("c_custkey").cast("string"), F.lit(".5"))))).alias("x"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'J2000' WHEN 1 THEN 'B1950' WHEN 2 THEN '1987' ELSE 'none' END AS epoch, round(CASE p_partkey % 4 WHEN 0 THEN 4 / 3.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.4 END, 6) AS aspect,
'Figure_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS id, lower(regexp_replace(p_name, '[\\s_\\-]+', '', 'g')) AS norm FROM part""")
def text_functions(t):
    """F2, F6, F21, M3"""
    k = F.col("p_partkey") % 4
    pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
    label = pick("RA (J 2000)", "Dec B1950", "alpha (1987)", "none here")
    aspect = pick("approximately 4:3 (wide)", "1.5", "1.2 to 1.4", "square")
    return t("part").select("p_partkey", S.epoch(label).alias("epoch"), r(S.aspect_ratio(aspect)).alias("aspect"), S.padded_id("Figure_", "p_partkey").alias("id"), S.normalise_key("p_name").alias("norm"))


@query()
def cer(t):
    """F5, on the whole texts of a conversation's first two turns, in any script (without SQL: the SQL engine counts bytes; tested against a slow version)"""
    first = lambda k: F.min(F.when(F.col("turn") == k, F.col("text")))
    w = t("conversations").groupBy("conv_id").agg(first(0).alias("a"), first(1).alias("b"))
    return w.select("conv_id", r(S.cer("a", "b")).alias("cer"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 42.0 * 60 WHEN 1 THEN 0.85 * 3600 WHEN 2 THEN 3.0 WHEN 4 THEN 7200.0 END::DOUBLE AS arcsec FROM part""")
def angle_parse(t):
    """M11"""
    k, text = F.col("p_partkey") % 5, F.lit("0.02")
    for i, s in enumerate(["26' x 42'", "0.85 degrees", '3"', "0.02", "2 deg 30'"]):
        text = F.when(k == i, s).otherwise(text)
    return t("part").select("p_partkey", S.angle_arcsec(text).alias("arcsec"))


HMS = "CAST(round(d / 15.0 * 360000) AS BIGINT) % 8640000"


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderkey * 7 % 360 AS DOUBLE) + 0.125 AS d FROM orders), h AS (SELECT o_orderkey, {HMS} AS c FROM x)
SELECT o_orderkey, printf('%02dh%02dm%02d.%02ds', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS hms, round(c / 100.0 / 240, 6) AS degrees FROM h""")
def hms_format(t):
    """M14, M15"""
    d = (F.col("o_orderkey") * 7 % 360).cast("double") + 0.125
    return t("orders").select("o_orderkey", S.hms(d).alias("hms")).select("o_orderkey", "hms", r(S.parse_hms("hms")).alias("degrees"))


@query(f"""WITH x AS (SELECT c_custkey, CAST(c_custkey * 37 % 360 AS DOUBLE) AS ra1, CAST(c_custkey * 11 % 140 AS DOUBLE) - 70 AS dec1, CAST(c_custkey % 50 AS DOUBLE) / 20 AS xi, CAST(c_custkey % 40 AS DOUBLE) / 25 AS eta FROM customer),
d AS (SELECT *, cos(radians(dec1)) - radians(eta) * sin(radians(dec1)) AS d FROM x),
s AS (SELECT *, (ra1 + degrees(atan2(radians(xi), d)) + 360) % 360.0 AS ra2, degrees(atan2(sin(radians(dec1)) + radians(eta) * cos(radians(dec1)), sqrt(radians(xi) * radians(xi) + d * d))) AS dec2 FROM d)
SELECT c_custkey, round(ra2, 6) AS ra, round(dec2, 6) AS dec, round(degrees({SEP}), 6) AS sep, round(xi * cos(radians(dec1 + eta / 2)) * 60, 6) AS width, round(eta * 60, 6) AS height FROM s""")
def sep_and_tan(t):
    """M17, M19, M20, M22"""
    k = F.col("c_custkey")
    x = t("customer").select("c_custkey", (k * 37 % 360).cast("double").alias("ra1"), ((k * 11 % 140).cast("double") - 70).alias("dec1"), ((k % 50).cast("double") / 20).alias("xi"), ((k % 40).cast("double") / 25).alias("eta"))
    ra, dec = S.tan_sky("xi", "eta", "ra1", "dec1")
    width, height = S.field_extent("xi", "dec1", F.col("dec1") + F.col("eta"))
    s = x.select("*", ra.alias("ra2"), dec.alias("dec2"), width.alias("width"), height.alias("height"))
    return s.select("c_custkey", r("ra2").alias("ra"), r("dec2").alias("dec"), r(S.separation("ra1", "dec1", "ra2", "dec2")).alias("sep"), r("width").alias("width"), r("height").alias("height"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1)
SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN hi > lo THEN (CAST(v AS DOUBLE) - CAST(lo AS DOUBLE)) / (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) ELSE 0 END, 5) AS x FROM e JOIN m USING (vec_id)""")
def rescale_minmax(t):
    """M7, A32"""
    e = t("embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"), F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", (F.col("i") + 1).alias("i"), r(S.rescale(F.col("v").cast("double"), "lo", "hi"), 5).alias("x"))


@query("SELECT r_regionkey, CAST(a AS INT) AS i, CAST(b AS INT) AS j, round(CAST(r_regionkey + a * 0.25 AS DOUBLE), 6) AS x, round(CAST(b * 0.5 AS DOUBLE), 6) AS y FROM region, range(5) u(a), range(3) v(b)")
def meshgrid_linspace(t):
    """N16, N17, M28"""
    g = t("region").select("r_regionkey", F.posexplode(S.linspace(F.col("r_regionkey").cast("double"), F.col("r_regionkey") + 1.0, F.lit(5))).alias("i", "x"))
    return g.select("*", F.posexplode(S.linspace(F.lit(0.0), F.lit(1.0), F.lit(3))).alias("j", "y")).select("r_regionkey", "i", "j", r("x").alias("x"), r("y").alias("y"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'top' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band, round(100 * abs(l_extendedprice / (l_quantity * 1000) - 1), 9) AS pct FROM lineitem""")
def number_functions(t):
    """M6, P13"""
    q = F.col("l_quantity")
    band = F.when(S.in_band(q, None, 20.000001), "low").when(S.in_band(q, 20.000001, 40.000001), "mid").otherwise("top")
    return t("lineitem").select("l_orderkey", "l_linenumber", band.alias("band"), r(S.percent_difference("l_extendedprice", q * 1000), 9).alias("pct"))


# --- nested records --------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 5 <> 0 AS readable FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 5 = 0")
def json_double_decode(t):
    """Documents encoded twice, once, and broken ones"""
    twice = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("event_id") % 5
    doc = F.when(k == 0, F.concat(F.lit("{"), "props")).when(k < 3, twice).otherwise(F.col("props"))
    d = t("events").select("event_id", P.decode_twice(doc).alias("json"))
    return d.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"), F.col("json").isNotNull().alias("readable"))


@query("""SELECT conv_id, 'Level ' || (turn % 3 + 1) AS level, role AS kind, CAST(turn AS VARCHAR) AS name, CASE WHEN turn % 2 = 1 THEN 'plot0' END AS plot, length(text) AS n_chars FROM conversations""")
def tree_flatten(t):
    """Conversations as trees of level, kind and name, odd turns a level deeper, and back"""
    c = t("conversations")
    entry = F.to_json(F.struct(F.col("text").alias("Q")))
    node = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('{"plot0":'), entry, F.lit("}"))).otherwise(entry)
    level = F.concat(F.lit("Level "), (F.col("turn") % 3 + 1).cast("string"))
    join = lambda key, value: F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":'), F.col(value))))), F.lit("}"))
    names = c.select("conv_id", level.alias("level"), "role", "turn", node.alias("node")).groupBy("conv_id", "level", "role").agg(join("turn", "node").alias("kinds"))
    tree = names.groupBy("conv_id", "level").agg(join("role", "kinds").alias("levels")).groupBy("conv_id").agg(join("level", "levels").alias("tree"))
    return G.flatten_tree(tree, "tree").select("conv_id", "level", "kind", "name", "plot", F.length(F.get_json_object("entry", "$.Q")).cast("long").alias("n_chars"))


@query()
def tolerant_parse(t):
    """Answers damaged in eight ways, read by key. Not SQL; tested on a corpus"""
    v = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"plot types": "'), v, F.lit('", "explanation": "seen"}'))
    k = F.col("event_id") % 8
    broken = [
        whole, F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.concat(F.lit('{"plot_types": ["'), v, F.lit('"}]')), F.concat(F.lit("{'plot types': '"), v, F.lit("',}")),
        F.concat(F.lit('{"plot types": "a "'), v, F.lit('" b"}')), F.concat(F.lit("Well: "), whole, F.lit(' {"explanation": "more"}')), F.lit("none of this"), F.lit('{"plot types": null}'),
    ]
    text = F.lit(None).cast("string")
    for i, b in enumerate(broken):
        text = F.when(k == i, b).otherwise(text)
    key = S.expected_key(F.lit('{"plot types": "<type>"}'))
    e = t("events").select("event_id", text.alias("text")).select("event_id", P.tolerant("text").alias("p"))
    return e.select("event_id", P.answer_for("p", key).alias("answer"), F.col("p.explanation").alias("explanation"), F.col("p.failure").alias("failure"), F.col("p.n_objects").alias("n_objects"))


# --- generated fields and models -------------------------------------------------------------------------------


@query()
def mixture_field(t):
    """The clusters of regions' figures, binned. Hashed draws, not SQL: tested for totals and repeatability"""
    f = t("region").select(F.col("r_regionkey").alias("k"), F.lit(3).alias("clusters"), F.lit(2000).alias("points"))
    at = lambda v: F.least(F.floor(F.col(v) * 32), F.lit(31)).cast("int")
    return G.clustered_points(f, "k", 11).groupBy("k", at("y").alias("iy"), at("x").alias("ix")).agg(F.count("*").alias("n"))


@query()
def accepted_draws(t):
    """First accepted of fifty hashed draws"""
    p = t("part").select("p_partkey")
    drawn = G.accepted(p, "p_partkey", 5, 50, lambda u: 0.2 + 4 * u, lambda x: (x > 0.5) & (x < 2.0))
    return G.error_bars(drawn, "p_partkey", "value", 9).withColumn("label", G.label_text(G.hashed(3), "p_partkey", ["flux", "mass", "age", "radius"]))


@query("SELECT r_regionkey AS k, CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, round(CAST(b AS DOUBLE) / 15 + 0.5 * CAST(a AS DOUBLE) / 7, 6) AS value FROM region, range(8) y(a), range(16) x(b)")
def linear_field(t):
    """Planes of regions' figures"""
    f = t("region").select(F.col("r_regionkey").alias("k"), F.lit(16).alias("nx"), F.lit(8).alias("ny"))
    return G.linear_fields(f, "k", 1).withColumn("value", r("value"))


@query()
def gbt_oof(t):
    """Out-of-fold predictions of a binary label by the whole embedding"""
    e = t("embeddings")
    width = e.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    names = [f"f{i}" for i in range(width)]
    e = e.select(F.col("vec_id"), (F.col("label") % 2).alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(name) for i, name in enumerate(names)])
    return G.confusion(G.out_of_fold(e, "label", "vec_id", names), "label", "predicted")


@query("""WITH x AS (SELECT c_mktsegment AS model, CAST(c_custkey * 31 % 180 AS DOUBLE) + 0.25 AS sep FROM customer)
SELECT model, count(*) AS n, round(100 * avg(CAST(sep < 1 AS DOUBLE)), 6) AS below1, round(100 * avg(CAST(sep < 10 AS DOUBLE)), 6) AS below10, round(100 * avg(CAST(sep > 90 AS DOUBLE)), 6) AS above90, round(median(sep), 6) AS median FROM x GROUP BY 1""")
def angular_errors(t):
    """T12"""
    x = t("customer").select(F.col("c_mktsegment").alias("model"), ((F.col("c_custkey") * 31 % 180).cast("double") + 0.25).alias("sep"))
    found = G.angular_errors(x, ["model"], "sep")
    return found.select("model", "n", *[r(c).alias(c) for c in ("below1", "below10", "above90", "median")])


@query("""WITH m AS (SELECT o_orderpriority AS model, o_orderstatus AS kind, avg(o_totalprice) AS x FROM orders GROUP BY ALL), w AS (SELECT model, min(x) FILTER (kind = 'F') AS f, min(x) FILTER (kind = 'O') AS o, min(x) FILTER (kind = 'P') AS p FROM m GROUP BY 1)
SELECT model, round(o - f, 3) AS first_step, round(p - o, 3) AS second_step, round(p - f, 3) AS total FROM w""")
def gap_steps(t):
    """T13"""
    m = t("orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("kind")).agg(F.avg("o_totalprice").alias("x"))
    return G.gaps(m, "model", "kind", "x", "F", "O", "P").select("model", *[r(c, 3).alias(c) for c in ("first_step", "second_step", "total")])


@query("""WITH q AS (SELECT s_suppkey AS k, CAST(s_suppkey % 10 AS DOUBLE) AS x, CAST(s_suppkey % 7 AS DOUBLE) AS y FROM supplier)
SELECT k, x >= 1 AND x < 6 AND y >= 1 AND y < 4 AS inside, round(degrees(acos(greatest(-1, least(1, ((1 - x - 0.5) * (6 - x - 0.5) + (1 - y - 0.5) * (1 - y - 0.5)) / (sqrt(pow(1 - x - 0.5, 2) + pow(1 - y - 0.5, 2)) * sqrt(pow(6 - x - 0.5, 2) + pow(1 - y - 0.5, 2))))))), 5) AS angle FROM q""")
def polygon_points(t):
    """Points against a rectangle (its lower and left edges belong to it), and the angle its base is seen under"""
    q = t("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 10).cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"))
    quad = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((1, 1), (6, 1), (6, 4), (1, 4))])
    one, six, dx, dy = F.lit(1.0), F.lit(6.0), F.col("x") + 0.5, F.col("y") + 0.5
    return q.select("k", S.point_in_polygon("x", "y", quad).alias("inside"), r(S.corner_angle(one, one, dx, dy, six, one), 5).alias("angle"))


EFFECTS = [("fold", "paper", 0.5), ("ink bleed", "ink", 0.3), ("stain", "paper", 0.2), ("scan lines", "post", 0.8)]
DRAW = "(({k} + {i} * 101) * 7919 + 104729) % 1000003 / 1000003.0 < {p}"


@query("""SELECT c_custkey, list_filter([""" + ", ".join(f"CASE WHEN {DRAW.format(k='c_custkey', i=i, p=p)} THEN '{n}' END" for i, (n, _, p) in enumerate(EFFECTS)) + """], lambda x: x IS NOT NULL).array_to_string('|') AS effects,
CAST(CASE WHEN """ + DRAW.format(k="c_custkey", i=0, p=0.5) + """ THEN 1 ELSE 0 END + CASE WHEN """ + DRAW.format(k="c_custkey", i=2, p=0.2) + """ THEN 1 ELSE 0 END AS INT) AS on_paper FROM customer""")
def bernoulli_plan(t):
    """O8, N15"""
    plan = R.bernoulli_plan(t("customer").select("c_custkey"), "c_custkey", EFFECTS, lambda k, i: R.keyed_order(k + i * 101) / 1000003.0)
    return plan.select("c_custkey", F.array_join("effects", "|").alias("effects"), F.coalesce(F.size(F.try_element_at("effects_by_phase", F.lit("paper"))), F.lit(0)).alias("on_paper"))


@query("""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 30 AND l_discount > 0.05 THEN 'image + contour' WHEN l_quantity > 30 THEN 'image' WHEN l_discount > 0.05 THEN 'contour' ELSE 'none' END AS tag FROM lineitem) GROUP BY tag""")
def image_tags(t):
    """N14"""
    keys = F.array_compact(F.array(F.when(F.col("l_quantity") > 30, "image"), F.when(F.col("l_discount") > 0.05, "contour")))
    return t("lineitem").select(R.image_tag(keys).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_custkey % 400 + 50 AS INT) AS n, CAST(1 + 2 * (o_orderkey % 2) AS INT) AS step FROM orders)
SELECT o_orderkey, CAST(floor((n - 9 * step - 1) / 2.0) AS INT) AS first, CAST(floor((n - 9 * step - 1) / 2.0) + 9 * step AS INT) AS last, 10 AS size FROM s""")
def crop_decimate(t):
    """M25"""
    s = t("orders").select("o_orderkey", (F.col("o_custkey") % 400 + 50).cast("int").alias("n"), (1 + 2 * (F.col("o_orderkey") % 2)).cast("int").alias("step"))
    x = s.select("o_orderkey", S.crop_indexes("n", 10, "step").alias("i"))
    return x.select("o_orderkey", F.element_at("i", 1).alias("first"), F.element_at("i", -1).alias("last"), F.size("i").alias("size"))
