"""Queries of checked boxes, carried boxes and generated fields of figures that come from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import fields as G
from ..operators import questions as Q
from ..sources import labels as L
from .figures import figures
from .registry import query, r


def proposed(t):
    """Boxes that a detector might propose, one a customer."""
    k = F.col("c_custkey")
    x0, y0, w, h = (k % 40 + 10).cast("double"), (k % 30 + 20).cast("double"), (300 + k % 7 * 50).cast("double"), (200 + k % 5 * 50).cast("double")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(p(x0, y0), p(w - x0, y0), p(w - x0, h - y0), p(x0, h - y0))
    flags = F.when(k % 4 == 0, F.array(F.lit("low contrast"), F.lit("near edge"))).otherwise(F.array().cast("array<string>"))
    return t("customer").select(
        F.concat(F.lit("fig_"), k.cast("string")).alias("vqa_id"), F.col("c_mktsegment").alias("astroexplorer_id"), F.concat(k.cast("string"), F.lit(".png")).alias("image"), F.lit("lines").alias("method"), w.alias("width"), h.alias("height"),
        corners.alias("corners"), flags.alias("flags"), (k % 4 == 0).alias("needs_attention"), F.lit("[1.0, 2.0]").alias("ref_pixel"), k.alias("k"),
    )


BOXES = """b AS (SELECT c_custkey AS k, 'fig_' || c_custkey AS vqa_id, c_custkey % 40 + 10 AS x0, c_custkey % 30 + 20 AS y0, 300 + c_custkey % 7 * 50 AS w, 200 + c_custkey % 5 * 50 AS h, c_custkey % 4 = 0 AS odd, c_mktsegment AS source FROM customer)"""


@query(f"""WITH {BOXES} SELECT vqa_id, '/data/local-files/?d=images_nometa/' || k || '.png' AS image, vqa_id || CASE WHEN odd THEN '   [check carefully]' ELSE '' END AS title,
  vqa_id || ' | detector: lines' || CASE WHEN odd THEN ' | NEEDS ATTENTION: low contrast; near edge' ELSE '' END || ' | blue dot in overlays = AVM reference pixel [1.0, 2.0]' AS info, source,
  CASE WHEN odd THEN 0.5 ELSE 0.9 END::DOUBLE AS score, 'auto_' || vqa_id AS result, round(100.0 * (w - x0) / w, 6)::DOUBLE AS right_edge, round(100.0 * (h - y0) / h, 6)::DOUBLE AS low_edge, 4::INT AS points FROM b""")
def label_tasks(t):
    """Tasks for people who check boxes, as JSON, read again by paths"""
    task = L.label_tasks(proposed(t)).select("vqa_id", "task")
    at = lambda path: F.get_json_object("task", path)
    result = "$.predictions[0].result[0]"
    n = F.json_array_length(at(f"{result}.value.points"))
    return task.select(
        "vqa_id", at("$.data.image").alias("image"), at("$.data.title").alias("title"), at("$.data.info").alias("info"), at("$.data.astroexplorer_id").alias("source"), at("$.predictions[0].score").cast("double").alias("score"),
        at(f"{result}.id").alias("result"), r(at(f"{result}.value.points[2][0]").cast("double")).alias("right_edge"), r(at(f"{result}.value.points[2][1]").cast("double")).alias("low_edge"), n.alias("points"),
    )


@query(f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'missing' WHEN k % 6 IN (1, 2) THEN 'unreviewed (detector proposal)' ELSE 'reviewed' END AS status, CASE WHEN k % 6 = 3 THEN 10 ELSE 0 END AS moved, k % 6 = 4 AS deleted, k % 6 = 5 AS flagged FROM b)
SELECT vqa_id, status, CASE WHEN flagged THEN 'exclude: blurred' WHEN deleted THEN 'bad crop' ELSE '' END AS flags, CASE WHEN deleted THEN 'cut badly' ELSE '' END AS notes,
  CASE WHEN status = 'missing' OR deleted THEN NULL ELSE (x0 + moved)::DOUBLE END AS xmin, CASE WHEN status = 'missing' OR deleted THEN NULL ELSE (h - y0)::DOUBLE END AS ymax,
  status = 'missing' OR deleted OR flagged AS exclude, CASE WHEN deleted THEN 'box deleted by reviewer (bad crop)' WHEN status = 'missing' THEN 'no box available (missing)' WHEN flagged THEN 'flagged by reviewer: exclude: blurred' END AS exclude_reason,
  CASE WHEN status = 'missing' OR deleted THEN NULL ELSE round((degrees(atan(radians((w - x0 - 100) / 3600.0))) - degrees(atan(radians((x0 + moved - 100) / 3600.0)))) * 60, 2) END::DOUBLE AS middle FROM s""")
def reviewed_boxes(t):
    """Tasks that come back, some with annotations: moved, deleted, flagged, cancelled; the sky's middle line is checked"""
    b, k = proposed(t), F.col("k")
    points = lambda shift: F.transform("corners", lambda p: F.array(100.0 * (p["x"] + F.when(p["x"] < F.col("width") / 2, shift).otherwise(0)) / F.col("width"), 100.0 * p["y"] / F.col("height")))
    value = lambda **fields: F.struct(*[fields.get(n, F.lit(None).cast(x)).alias(n) for n, x in (("points", "array<array<double>>"), ("choices", "array<string>"), ("text", "array<string>"))])
    result = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    note = lambda at, gone, *results: F.struct(F.lit(gone).alias("was_cancelled"), F.lit(at).alias("updated_at"), F.array(*results).alias("result"))
    box = lambda shift: result("polygonlabels", value(points=points(shift)))
    choice = lambda text: result("choices", value(choices=F.array(F.lit(text))))
    old, cancelled = note("2024-01-01", False, box(77.0)), note("2024-09-09", True, box(50.0))
    deleted = note("2024-02-02", False, choice("bad crop"), result("textarea", value(text=F.array(F.lit("cut"), F.lit("badly")))))
    made = F.when(k % 6 == 2, F.array(cancelled)).when(k % 6 == 3, F.array(note("2024-03-03", False, box(10.0)), old, cancelled)).when(k % 6 == 4, F.array(old, deleted)).when(k % 6 == 5, F.array(note("2024-05-05", False, box(0.0), choice("exclude: blurred"))))
    task = F.to_json(F.struct(F.struct("vqa_id").alias("data"), F.when(k % 6 > 0, F.array(F.struct(F.array(box(0.0)).alias("result")))).alias("predictions"), made.alias("annotations")))
    source = F.struct(F.lit(0.0).alias("ra"), F.lit(0.0).alias("dec"), F.lit(1.0).alias("scale"), F.lit(100.0).alias("x"), (F.col("height") / 2).alias("y"), F.lit(180.0).alias("rotation"))
    found = L.reviewed_boxes(b.select(task.alias("task")), b.select("vqa_id", "width", "height", source.alias("source")))
    corner = lambda i: F.get("rectangle", F.lit(i))
    across = S.tan_sky((corner(2) - 100.0) / 3600.0, F.lit(0.0), F.lit(180.0), F.lit(0.0))[0] - S.tan_sky((corner(0) - 100.0) / 3600.0, F.lit(0.0), F.lit(180.0), F.lit(0.0))[0]
    return found.select("vqa_id", "status", F.array_join("flags", ";").alias("flags"), "notes", corner(0).alias("xmin"), corner(3).alias("ymax"), "exclude", "exclude_reason", r(across * 60, 2).alias("middle"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS x0, l_quantity + 8 AS x1, l_discount * 100 AS y0, l_discount * 100 + 4 AS y1, 100.0 + l_suppkey % 7 AS height FROM lineitem)
SELECT k, n, round(10 + x0 * 3, 6)::DOUBLE AS xmin, round(20 + (height - y1) / height * 300, 6)::DOUBLE AS ymin, round(10 + x1 * 3, 6)::DOUBLE AS xmax, round(20 + (height - y0) / height * 300, 6)::DOUBLE AS ymax FROM b""")
def carried_boxes(t):
    """Boxes turned from a bottom-left to a top-left origin and carried to another canvas"""
    q, d, height = F.col("l_quantity"), F.col("l_discount") * 100, 100.0 + F.col("l_suppkey") % 7
    low, high = S.flip_box(d, d + 4, height)
    x = lambda v: r(S.remapped(v, F.lit(0.0), F.lit(100.0), F.lit(10.0), F.lit(310.0)))
    y = lambda v: r(S.remapped(v, F.lit(0.0), height, F.lit(20.0), F.lit(320.0)))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x(q).alias("xmin"), y(low).alias("ymin"), x(q + 8).alias("xmax"), y(high).alias("ymax"))


@query("SELECT o_orderkey::VARCHAR AS fig_id, '{\"nrows\":1,\"ncols\":1}' AS a FROM orders")
def panel_counts(t):
    """Q1: rows and columns, asked of every figure"""
    asked = Q.questions(figures(t).select("fig_id", "figure", F.slice("plots", 1, 0).alias("plots")), count_panels=True)
    return asked.where("name = 'rows/columns'").select("fig_id", "a")


@query("""WITH u AS (SELECT p_partkey AS k, (p_partkey * 7919 + 104729) % 1000003 / 1000003.0 AS u FROM part) SELECT k, round(exp(ln(0.5) + u * (ln(30) - ln(0.5))), 6)::DOUBLE AS size FROM u""")
def log_uniform_sizes(t):
    """M9: log-uniform sizes from keyed uniform numbers"""
    u = ((F.col("p_partkey") * 7919 + 104729) % 1000003) / 1000003.0
    return t("part").select(F.col("p_partkey").alias("k"), r(S.log_uniform(u, 0.5, 30.0)).alias("size"))


@query("""WITH x AS (SELECT l_returnflag AS section, 100 * avg((l_linestatus = 'F')::INT::DOUBLE) AS share, count(*) AS n, avg(l_discount) AS mean FROM lineitem GROUP BY 1),
c AS (SELECT section, printf('%.4f', share) AS computed, printf('%.1f', share) AS paper, true AS ok FROM x UNION ALL SELECT section, printf('%.4f', share), '~' || printf('%.0f', share + 3), true FROM x UNION ALL SELECT section, printf('%.4f', share), '<' || printf('%.0f', floor(share)), false FROM x
UNION ALL SELECT section, n::VARCHAR, '>' || (n - 1)::VARCHAR, true FROM x UNION ALL SELECT section, n::VARCHAR, '<' || n::VARCHAR, false FROM x UNION ALL SELECT section, printf('%.4f', mean), printf('%.2f', mean + 0.02), false FROM x) SELECT * FROM c""")
def computed_claims(t):
    """Claims of several kinds against values computed from rows"""
    x = t("lineitem").groupBy(F.col("l_returnflag").alias("section")).agg((100 * F.avg((F.col("l_linestatus") == "F").cast("double"))).alias("share"), F.count("*").alias("n"), F.avg("l_discount").alias("mean"))
    say = lambda form, v: F.format_string(form, v)
    share, n, mean = say("%.4f", F.col("share")), F.col("n").cast("string"), say("%.4f", F.col("mean"))
    cases = [
        (share, say("%.1f", F.col("share"))), (share, F.concat(F.lit("~"), say("%.0f", F.col("share") + 3))), (share, F.concat(F.lit("<"), say("%.0f", F.floor("share").cast("double")))),
        (n, F.concat(F.lit(">"), (F.col("n") - 1).cast("string"))), (n, F.concat(F.lit("<"), n)), (mean, say("%.2f", F.col("mean") + 0.02)),
    ]
    rows = x.select("section", F.explode(F.array(*[F.struct(a.alias("computed"), b.alias("paper")) for a, b in cases])).alias("c")).select("section", "c.*")
    return E.claims(rows)


@query("""WITH f AS (SELECT n_nationkey AS k, n_nationkey % 6 + 5 AS nx, n_nationkey % 4 + 3 AS ny FROM nation)
SELECT k, iy::INT AS iy, ix::INT AS ix, round(ix / (nx - 1) + 0.5 * iy / (ny - 1), 6)::DOUBLE AS value FROM f, range(8) y(iy), range(10) x(ix) WHERE iy < ny AND ix < nx""")
def linear_fields(t):
    """Planes of figures of many sizes, without noise"""
    f = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 6 + 5).alias("nx"), (F.col("n_nationkey") % 4 + 3).alias("ny"))
    return G.linear_fields(f, "k", 1).withColumn("value", r("value"))


@query()
def clustered_points(t):
    """Clusters of figures with noise and colors, and uniform points beside them. Hashed draws: tested for range, totals and spread"""
    f = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3 + 2).alias("clusters"), (F.col("n_nationkey") % 5 * 20 + 40).alias("points"))
    gathered = G.clustered_points(f, "k", 11, noise=0.05, colors=(2.0, 5.0))
    spread = G.scattered_points(f, "k", 12, "points", 3).select("k", F.lit(-1).alias("cluster"), "i", F.col("x0").alias("x"), F.col("x1").alias("y"), F.col("x2").alias("color"))
    return gathered.unionByName(spread)
