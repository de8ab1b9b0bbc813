"""Queries of figures: questions and their prompts, quads, grids, axes, sizes and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import questions as Q
from ..operators import relate as R
from ..operators.keys import spread
from .registry import query, r

# Figures made from orders: one panel, of the sky for even keys; a tangent-plane header of 2 by 2 pixels around a point
# that moves with the key; colors from the customer's number; drawn keys and tick labels from the key.
FIG = """f AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS fig_id, o_orderkey % 2 = 0 AS sky, o_orderpriority AS title, CAST(o_custkey AS DOUBLE) AS v,
  CAST(o_orderkey * 7 % 300 + 30 AS DOUBLE) AS ra0, CAST(o_orderkey % 120 - 60 AS DOUBLE) AS dec0 FROM orders)"""


def figures(t):
    k, v = F.col("o_orderkey"), F.col("o_custkey").cast("double")
    sky = k % 2 == 0
    card = lambda key, value: F.concat(F.lit(f"{key:<8}= "), value.cast("string"), F.lit(" / deg "))
    header = F.concat(card("CRPIX1", F.lit(1.5)), card("CRPIX2", F.lit(1.5)), card("CDELT1", F.lit(-0.1)), card("CDELT2", F.lit(0.1)), card("CRVAL1", (k * 7 % 300 + 30).cast("double")), card("CRVAL2", (k % 120 - 60).cast("double")))
    null = lambda kind: F.lit(None).cast(kind)
    xs = F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    drawn = F.when(k % 3 == 0, F.array(F.lit("image"), F.lit("contour lines"))).when(k % 3 == 1, F.array(F.lit("image"))).otherwise(F.array(F.lit("contour lines")))
    panel = F.struct(
        F.lit(0).alias("plot_num"), F.when(sky, "image of the sky").otherwise("contour").alias("type"), F.when(k % 4 == 0, "sky").otherwise("gmm").alias("distribution"), xs.alias("xs"), xs.alias("ys"),
        F.array(F.array(v, v + 1), F.array(v + 5, v + 2)).alias("colors"), drawn.alias("drawn_keys"), null("array<double>").alias("x_pixel_limits"), null("array<double>").alias("y_pixel_limits"), F.when(sky, header).alias("wcs_header"), null("string").alias("fits_header"), F.lit("K").alias("bunit"),
        F.when(k % 4 == 0, "RA (J2000)").otherwise("RA").alias("xlabel"), F.lit("Dec").alias("ylabel"), F.col("o_orderpriority").alias("title"), F.array(F.when(k % 4 == 0, r"$2^\mathrm{h}30^\mathrm{m}$").otherwise(r"$2\mathregular{^h}$")).alias("xticks"), F.array(F.lit(r"$-3{^\circ}$")).alias("yticks"),
    )
    head = F.struct(F.lit(1).alias("nrows"), F.lit(1).alias("ncols"), F.lit("default").alias("plot style"), null("string").alias("color map"), F.lit(1.5).alias("aspect ratio"), F.array(F.array(F.lit(0), F.lit(0))).alias("plot indexes"))
    orders = spread(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    return orders.select(F.col("o_orderkey").cast("string").alias("fig_id"), head.alias("figure"), F.array(panel).alias("plots"))


_HMS = "printf('%02dh%02dm%02d.%02ds', {h} // 360000, {h} % 360000 // 6000, {h} % 6000 // 100, {h} % 100)"
_CONTOUR = "SELECT fig_id, 'Level {level}' AS level, {name} AS name, 'plot0' AS plot, {text} AS answer, {value}::DOUBLE AS value FROM f WHERE NOT sky"
_SKY = "SELECT fig_id, 'Level {level}' AS level, '{name}' AS name, 'plot0' AS plot, {text} AS answer, {value}::DOUBLE AS value FROM g"


def _parts() -> list[str]:
    def contour(level, name, text="NULL", value="NULL"):
        return _CONTOUR.format(level=level, name=f"'{name}'", text=text, value=value)

    def sky(level, name, text="NULL", value="NULL"):
        return _SKY.format(level=level, name=name, text=text, value=value)

    whole = {"plot style": "'default'", "colormap": "NULL", "titles": "'[\"' || title || '\"]'", "xlabels": "CASE WHEN k % 4 = 0 THEN '[\"RA (J2000)\"]' ELSE '[\"RA\"]' END", "ylabels": "'[\"Dec\"]'", "xtick values": r"""CASE WHEN k % 4 = 0 THEN '[["$2^\\mathrm{h}30^\\mathrm{m}$"]]' ELSE '[["$2\\mathregular{^h}$"]]' END""", "ytick values": r"""'[["$-3{^\\circ}$"]]'""", "plot types (list)": "CASE WHEN sky THEN '[\"image of the sky\"]' ELSE '[\"contour\"]' END", "plot types": "CASE WHEN sky THEN '[\"image of the sky\"]' ELSE '[\"contour\"]' END"}
    out = [f"SELECT fig_id, 'Level 1' AS level, '{name}' AS name, NULL AS plot, {text} AS answer, NULL::DOUBLE AS value FROM f" for name, text in whole.items()]
    out.append("SELECT fig_id, 'Level 1', 'aspect ratio', NULL, NULL, 1.5::DOUBLE FROM f")
    out.append(contour(1, "image or lines (list)", "CASE k % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'image' ELSE 'contour lines' END"))
    for axis in "xy":
        out += [contour(1, f"minimum {axis} axis limit", value="CASE WHEN k % 3 = 2 THEN 1 ELSE 0.5 END"), contour(1, f"maximum {axis} axis limit", value="CASE WHEN k % 3 = 2 THEN 4 ELSE 4.5 END")]
    for which, value in (("minimum", "v"), ("maximum", "v + 5"), ("median", "v + 1.5"), ("mean", "v + 2")):
        out += [contour(2, f"{which} color", value=value), sky(2, f"{which} color", value=value)]
    out += [contour(3, f"distribution-{axis} + list)", "'gaussian mixture model'") for axis in ("color", "x/y")]
    out.append(sky(3, "distribution-image + list)", "CASE WHEN k % 4 = 0 THEN 'real image of the sky' ELSE 'gaussian mixture model' END"))
    for which in ("minimum", "maximum"):
        end = "low" if which == "minimum" else "high"
        out += [sky(1, f"{which} right ascension axis limit", _HMS.replace("{h}", f"h_{end}")), sky(1, f"{which} declination axis limit", value=f"dec_{end}")]
    out += [sky(1, "epoch", "CASE WHEN k % 4 = 0 THEN 'J2000' ELSE 'none' END"), sky(1, "finest unit right ascension", "CASE WHEN k % 4 = 0 THEN 'minutes' ELSE 'hours' END"), sky(1, "finest unit declination", "'degrees'")]
    out += [sky(2, "field height", value="(dec_high - dec_low) * 60"), sky(2, "field width", value="(ra_high - ra_low) * cos(radians((dec_low + dec_high) / 2)) * 60"), sky(3, "pixel scale", value="(dec_high - dec_low) * 3600")]
    return out


BUILD = f"""WITH {FIG}, pt AS (SELECT fig_id, k, v, ra0, dec0, radians(-0.1 * a) AS xi, radians(0.1 * b) AS eta FROM f, (SELECT x.range / 191.0 - 0.5 AS a, y.range / 191.0 - 0.5 AS b FROM range(192) x, range(192) y WHERE x.range IN (0, 191) OR y.range IN (0, 191)) WHERE sky),
d AS (SELECT *, cos(radians(dec0)) - eta * sin(radians(dec0)) AS d FROM pt),
s AS (SELECT fig_id, any_value(k) AS k, any_value(v) AS v, min(ra0 + degrees(atan2(xi, d))) AS ra_low, max(ra0 + degrees(atan2(xi, d))) AS ra_high, min(degrees(atan2(sin(radians(dec0)) + eta * cos(radians(dec0)), sqrt(xi * xi + d * d)))) AS dec_low, max(degrees(atan2(sin(radians(dec0)) + eta * cos(radians(dec0)), sqrt(xi * xi + d * d)))) AS dec_high FROM d GROUP BY fig_id),
g AS (SELECT *, CAST(round(ra_low / 15 * 360000) AS BIGINT) % 8640000 AS h_low, CAST(round(ra_high / 15 * 360000) AS BIGINT) % 8640000 AS h_high FROM s)
SELECT fig_id, level, name, plot, answer, round(value, 6) AS value FROM ({" UNION ALL ".join(_parts())})"""


@query(BUILD)
def question_build(t):
    """Every question of figures made from orders, with its answer (numbers apart)"""
    q = Q.questions(figures(t))
    number = F.when(F.col("a").rlike(r"^-?\d+(\.\d+)?(E-?\d+)?$"), F.col("a").cast("double"))
    return q.select("fig_id", "level", "name", "plot", F.when(number.isNull(), F.col("a")).alias("answer"), r(number).alias("value"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 21 END::BIGINT AS questions, count(*) AS figures, 10 * count(*) AS of_figures FROM orders GROUP BY 1")
def question_counts(t):
    """Q2: 21 questions for a contour panel and 25 for one of the sky"""
    each = Q.questions(figures(t)).groupBy("fig_id").agg(F.count("*").alias("questions"), F.count_if(F.col("kind") == Q.FIGURE).alias("whole"))
    return each.groupBy("questions").agg(F.count("*").alias("figures"), F.sum("whole").alias("of_figures"))


PERSONA = Q.PERSONA


@query(f"""WITH {FIG} SELECT fig_id, 'epoch' AS name, '{PERSONA}  What coordinate epoch is given on the axis labels of this figure? Answer "none" if no epoch is stated. Please format the output as a json as {{"epoch":""}} for this figure, where the "epoch" value should be a string such as "J2000", "B1950" or "none".' AS q, 'epoch' AS tag FROM f WHERE sky
UNION ALL SELECT fig_id, 'minimum x axis limit', '{PERSONA}  What is the minimum x value covered by the x axis of this figure -- that is, the lower limit of the axis range, not of the data? Please format the output as a json as {{"minimum x axis limit":""}} for this figure, where the "minimum x axis limit" value should be a float, read from the x axis.', 'minimum x axis limit' FROM f WHERE NOT sky
UNION ALL SELECT fig_id, 'distribution-color + list)', '{PERSONA}  Please choose the distribution from the following list: [random, linear, gaussian mixture model]. What is the underlying distribution used to create the data in this figure along the color-axis? Please format the output as a json as {{"distribution color":""}} for this figure, where the "distribution color" value should be a string.', 'distribution + list)' FROM f WHERE NOT sky
UNION ALL SELECT fig_id, 'mean color', '{PERSONA}  What is the mean value of the data along the color-axis in this figure?  Please format the output as a json as {{"mean color":""}} for this figure, where the "mean color" value should be a float, calculated from the data values used to create the plot.', 'mean color' FROM f""")
def question_prompts(t):
    """Whole prompts of four questions (all wordings are compared in the tests)"""
    q = Q.questions(figures(t))
    return q.where(F.col("name").isin("epoch", "minimum x axis limit", "distribution-color + list)", "mean color")).select("fig_id", "name", "q", "tag")


# --- quads and boxes -------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT c_custkey AS k, (c_custkey % 21 - 10) / 40.0 AS s FROM customer)
SELECT k, abs(degrees(atan(s))) <= 12 AS rectangle, least(0, s)::DOUBLE AS xmin, 0.0::DOUBLE AS ymin, greatest(1, 1 + s)::DOUBLE AS xmax, 1.0::DOUBLE AS ymax,
  '0.0 0.0|1.0 0.0|' || printf('%.3f 1.0|%.3f 1.0', 1 + s, s) AS corners, CAST(20 + 2 * CASE WHEN s = 0 THEN 10 ELSE 11 END AS INT) AS edge_points FROM q""")
def quad_shapes(t):
    """Sheared squares, their corners given in any order"""
    k, s = F.col("c_custkey"), (F.col("c_custkey") % 21 - 10) / 40.0
    p = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    given = F.array(p(F.lit(0), 0), p(F.lit(1), 0), p(1 + s, 1), p(s, 1))
    turn = (k % 4).cast("int")
    mixed = F.concat(F.slice(given, turn + 1, 4 - turn), F.slice(given, F.lit(1), turn))
    q = spread(t("customer").select("c_custkey"), "c_custkey").select(k.alias("k"), F.when(k % 2 == 0, F.reverse(mixed)).otherwise(mixed).alias("given"))
    q = q.select("k", S.ordered_corners("given").alias("c"))
    box = S.bounding_box("c")
    text = F.concat_ws("|", F.lit("0.0 0.0"), F.lit("1.0 0.0"), *[F.concat(F.format_string("%.3f", F.get("c", F.lit(i))["x"]), F.lit(" "), F.get("c", F.lit(i))["y"].cast("string")) for i in (2, 3)])
    seen = F.when((F.get("c", F.lit(0))["x"] == 0) & (F.get("c", F.lit(0))["y"] == 0) & (F.get("c", F.lit(1))["x"] == 1) & (F.get("c", F.lit(1))["y"] == 0), text)
    return q.select("k", S.near_rectangle("c").alias("rectangle"), *[box[x].alias(x) for x in ("xmin", "ymin", "xmax", "ymax")], seen.alias("corners"), F.size(S.edge_points("c", 0.1)).alias("edge_points"))


@query("""WITH l AS (SELECT row_number() OVER () AS id, l_orderkey AS fig, l_linenumber AS plot, l_quantity AS q, l_discount * 100 AS d FROM lineitem),
b AS (SELECT fig, plot, 'square' AS label, 0 AS n, 10 AS xmin, 10 AS ymin, 90 AS xmax, 90 AS ymax FROM l UNION ALL SELECT fig, plot, 'title', 0, 10, 92, 10 + q, 98 FROM l WHERE d > 3
  UNION ALL SELECT fig, plot, 'x-tick labels', CAST(row_number() OVER (PARTITION BY id ORDER BY x) - 1 AS INT), x - 2, 2, x + 2, 6 FROM (SELECT id, fig, plot, unnest([q, q + 45, q + 60]) AS x FROM l) WHERE x BETWEEN 5 AND 95
  UNION ALL SELECT fig, plot, 'colorbar tick', 0, 95, d, 99, d + 1 FROM l)
SELECT label, count(*) AS boxes, sum(n)::BIGINT AS places, round(sum(xmin + 3 * ymin), 4) AS low, round(sum(xmax + 3 * ymax), 4) AS high FROM b GROUP BY label""")
def panel_boxes(t):
    """Squares, some titles, axis ticks within five of the square and color bar ticks wherever they are"""
    box = lambda *x: F.struct(*[v.cast("double").alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), x)])
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    tick = lambda x: F.struct(x.alias("tx"), F.lit(8.0).alias("ty"), (x - 2).alias("xmin"), F.lit(2.0).alias("ymin"), (x + 2).alias("xmax"), F.lit(6.0).alias("ymax"))
    panels = t("lineitem").select(
        F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("plot"), box(F.lit(10), F.lit(10), F.lit(90), F.lit(90)).alias("square"), F.when(d > 3, box(F.lit(10), F.lit(92), 10 + q, F.lit(98))).alias("title"),
        F.array(tick(q), tick(q + 45), tick(q + 60)).alias("xticks"), F.array(box(F.lit(95), d, F.lit(99), d + 1)).alias("colorbar_ticks"),
    )
    b = R.collect_boxes(panels, ["fig", "plot"])
    return b.groupBy("label").agg(F.count("*").alias("boxes"), F.sum("n").alias("places"), r(F.sum(F.col("xmin") + 3 * F.col("ymin")), 4).alias("low"), r(F.sum(F.col("xmax") + 3 * F.col("ymax")), 4).alias("high"))


_EDGE = "2 * asin(least(1.0, sqrt(pow(sin(radians(dec{b} - dec{a}) / 2), 2) + cos(radians(dec{a})) * cos(radians(dec{b})) * pow(sin(radians(ra{b} - ra{a}) / 2), 2))))"
_CORNER = "degrees(atan2(radians({x}), cos(radians(d0)) - radians({y}) * sin(radians(d0)))) AS ra{i}, degrees(atan2(sin(radians(d0)) + radians({y}) * cos(radians(d0)), sqrt(pow(radians({x}), 2) + pow(cos(radians(d0)) - radians({y}) * sin(radians(d0)), 2)))) AS dec{i}"


@query("WITH p AS (SELECT s_suppkey, CAST(s_suppkey * 11 % 160 AS DOUBLE) - 80 AS d0, 5 + s_suppkey % 7 AS h FROM supplier), c AS (SELECT s_suppkey, " + ", ".join(_CORNER.format(i=i, x=x, y=y) for i, (x, y) in enumerate((("-0.1", "-0.01 * h"), ("0.1", "-0.01 * h"), ("-0.1", "0.01 * h"), ("0.1", "0.01 * h")))) + f""" FROM p)
SELECT s_suppkey, round(degrees({_EDGE.format(a=0, b=1)} + {_EDGE.format(a=2, b=3)}) / 2, 7) AS width, round(degrees({_EDGE.format(a=0, b=2)} + {_EDGE.format(a=1, b=3)}) / 2, 7) AS height FROM c""")
def box_edges(t):
    """Mean angular width and height of boxes of 20 pixels by 2 h at 36 arc seconds a pixel"""
    k = F.col("s_suppkey")
    s = t("supplier").select("s_suppkey", (k * 37 % 360).cast("double").alias("ra"), ((k * 11 % 160).cast("double") - 80).alias("dec"), (5 + k % 7).cast("double").alias("h"))
    w, h = R.box_on_sky(F.lit(-10.0), -F.col("h"), F.lit(10.0), F.col("h"), F.lit(0.01), "ra", "dec")
    return s.select("s_suppkey", r(w, 7).alias("width"), r(h, 7).alias("height"))


# --- grids, axes and sizes -------------------------------------------------------------------------------------


@query("""WITH RECURSIVE q AS (SELECT DISTINCT o_custkey % 400 + 1 AS x, o_orderkey % 350 + 1 AS y FROM orders), c AS (SELECT x, y, least(1.0, 300 / x, 300 / y) AS f FROM q),
b AS (SELECT x, y, least(300, greatest(1, CAST(round_even(x * f, 0) AS BIGINT))) AS nx, least(300, greatest(1, CAST(round_even(y * f, 0) AS BIGINT))) AS ny FROM c),
s AS (SELECT x, y, nx, ny, greatest(1, least(300 // nx, 300 // ny)) AS k, 0 AS i FROM b
  UNION ALL SELECT x, y, a, b, greatest(1, least(300 // a, 300 // b)), i + 1 FROM (SELECT *, greatest(1, nx * k // (k + 1)) AS a, greatest(1, ny * k // (k + 1)) AS b FROM s WHERE k % 2 = 0 AND i < 8) WHERE a * (k + 1) <= 300 AND b * (k + 1) <= 300 AND NOT (a = nx AND b = ny)),
e AS (SELECT x, y, arg_max(nx, i) AS nx, arg_max(ny, i) AS ny, arg_max(CASE WHEN k % 2 = 0 THEN greatest(1, k - 1) ELSE k END, i) AS k FROM s GROUP BY ALL)
SELECT o_orderkey, nx::BIGINT AS nx, ny::BIGINT AS ny, k::BIGINT AS k, round((150.5 - (300 - nx * k) // 2 - (k - 1) // 2 - 1 + k) / k, 6)::DOUBLE AS crpix, round(-0.01 * k, 6)::DOUBLE AS cdelt FROM orders JOIN e ON x = o_custkey % 400 + 1 AND y = o_orderkey % 350 + 1""")
def pixel_grids(t):
    """The grid a panel is drawn on, its step, and the header that goes with it"""
    g = t("orders").select("o_orderkey", S.pixel_grid(F.col("o_custkey") % 400 + 1, F.col("o_orderkey") % 350 + 1).alias("g")).select("o_orderkey", "g.*")
    crpix, cdelt = S.decimated_header(F.lit(150.5), F.lit(-0.01), F.lit(300), "nx", "k")
    return g.select("o_orderkey", "nx", "ny", "k", r(crpix).alias("crpix"), r(cdelt).alias("cdelt"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey % 90 + 5 AS span, 6 + o_orderkey % 9 AS font, o_orderkey % 6 + 1 AS longest, o_orderkey % 3 = 0 AS vertical, (o_orderkey % 40) / 2.0 - 3 AS drawn, CASE o_orderkey % 3 WHEN 0 THEN 'squarish' WHEN 1 THEN 'horizontal' ELSE 'vertical' END AS layout, o_custkey % 2 = 0 AS flip, 4 + o_custkey % 17 AS w, 3 + o_orderkey % 11 AS h, 100 * (1 + o_custkey % 12) AS dpi FROM orders),
n AS (SELECT *, CAST(greatest(1, least(12, round_even(drawn, 0))) AS INT) AS n, CAST(floor(sqrt(greatest(1, least(12, round_even(drawn, 0))))) AS INT) AS a FROM x), m AS (SELECT *, CAST(round_even(n / a, 0) AS INT) AS b, layout = 'squarish' OR n > 8 AS even FROM n),
d AS (SELECT *, CASE WHEN w * h * dpi * dpi > 50000000 THEN sqrt(50000000 / (w * h)) ELSE dpi END AS used FROM m)
SELECT k, CAST(greatest(2, least(11, floor(span * 2 / (font * CASE WHEN vertical THEN 1.25 ELSE 0.62 * longest END * 100 / 72.0 * 1.15)))) AS INT) AS ticks, CASE WHEN even THEN CASE WHEN flip THEN b ELSE a END WHEN layout = 'horizontal' THEN 1 ELSE n END AS nrows, CASE WHEN even THEN CASE WHEN flip THEN a ELSE b END WHEN layout = 'horizontal' THEN n ELSE 1 END AS ncols,
  round(used, 6)::DOUBLE AS dpi, CAST(floor(w * used) AS INT) AS width, CAST(floor(h * used) AS INT) AS height, round(100 + (span / 100.0) * 400, 6)::DOUBLE AS moved FROM d""")
def figure_sizes(t):
    """Tick capacity, panel grids, dpi and pixels, a coordinate carried to another canvas"""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    layout = F.when(k % 3 == 0, "squarish").when(k % 3 == 1, "horizontal").otherwise("vertical")
    x = t("orders").select(k.alias("k"), (u % 90 + 5).cast("double").alias("span"), (6 + k % 9).cast("double").alias("font"), (k % 6 + 1).alias("longest"), (k % 3 == 0).alias("vertical"), ((k % 40) / 2.0 - 3).alias("drawn"), layout.alias("layout"), (u % 2 == 0).alias("flip"), (4 + u % 17).cast("double").alias("w"), (3 + k % 11).cast("double").alias("h"), (100 * (1 + u % 12)).alias("asked"))
    rows, columns = S.panel_grid("drawn", "layout", "flip", 1, 12, 8)
    x = x.withColumn("dpi", S.safe_dpi("w", "h", "asked", 50e6))
    width, height = S.pixel_size("w", "h", "dpi")
    ticks = S.tick_capacity(F.col("span") * 2, "font", F.lit(100.0), "longest", "vertical")
    return x.select("k", ticks.alias("ticks"), rows.alias("nrows"), columns.alias("ncols"), r("dpi").alias("dpi"), width.alias("width"), height.alias("height"), r(S.remapped("span", F.lit(0.0), F.lit(100.0), F.lit(100.0), F.lit(500.0))).alias("moved"))


@query("""WITH x AS (SELECT c_custkey AS k, (c_custkey % 97) / 97.0 AS a, (c_custkey % 89) / 89.0 AS b, (c_custkey % 83) / 83.0 AS d, (c_custkey % 79) / 79.0 AS e, c_acctbal AS v, c_custkey % 5 + 1 AS n, c_custkey % 2 = 0 AS lines FROM customer),
y AS (SELECT *, pow(10, -(0.01 + a * 4.99) * ln(1 - b)) AS s FROM x)
SELECT k, round(ln(s * (1 + 0.1 + e * 9.9)), 6) AS high, round((s * (1 - 0.1 - d * 9.9)) / s, 6) AS low, CASE WHEN n > 1 THEN CASE WHEN lines THEN 0.0 ELSE -0.5 END END::DOUBLE AS first, CASE WHEN n > 1 THEN CASE WHEN lines THEN n - 1 ELSE n - 0.5 END END::DOUBLE AS last,
  CASE WHEN k % 7 IN (1, 2) THEN 0 ELSE v END::DOUBLE AS cleaned, k % 2 = 0 OR n < 4 AS kept, round((CAST(k * 37 % 360 AS DOUBLE) + 0.5 / cos(radians(k % 120 - 60)) + 360) % 360, 6) AS ra, k % 120 - 60 + 0.25::DOUBLE AS dec, k % 3 = 0 AS round_value FROM y""")
def axis_draws(t):
    """Log axes from four uniform numbers, limits of contour axes, clean-up, a point offset on the sphere, round coordinates"""
    k = F.col("c_custkey")
    x = t("customer").select(k.alias("k"), *[((k % m) / float(m)).alias(n) for n, m in (("a", 97), ("b", 89), ("d", 83), ("e", 79))], F.when(k % 7 == 1, float("nan")).when(k % 7 == 2, float("inf")).otherwise(F.col("c_acctbal")).alias("v"), (k % 5 + 1).cast("int").alias("n"), (k % 2 == 0).alias("lines"))
    low, high = S.log_axis("a", "b", "d", "e")
    middle = F.pow(F.lit(10.0), -(0.01 + F.col("a") * 4.99) * F.log(1 - F.col("b")))
    first, last = S.contour_limits(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("double")), "lines")
    ra, dec = S.spherical_offset((F.col("k") * 37 % 360).cast("double"), (F.col("k") % 120 - 60).cast("double"), F.lit(0.5), F.lit(0.25))
    exact = F.when(F.col("k") % 3 == 0, F.col("k") / 2.0).otherwise(F.col("k") + 0.3)
    return x.select("k", r(F.log(high)).alias("high"), r(low / middle).alias("low"), first.alias("first"), last.alias("last"), S.clean("v").alias("cleaned"), S.halved("k", F.lit(0), F.lit(1), "n", 3).alias("kept"), r(ra).alias("ra"), dec.alias("dec"), S.is_round_sexagesimal(exact).alias("round_value"))


@query("""WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT e.vec_id, v - lo AS light, row_number() OVER (PARTITION BY e.vec_id ORDER BY v DESC) AS place, n FROM e JOIN m USING (vec_id)), c AS (SELECT vec_id, sum(light) FILTER (place <= greatest(1, round(0.1 * n))) / sum(light) AS con FROM k GROUP BY 1)
SELECT vec_id, round(log10(sqrt((vec_id % 50 + 1) * (vec_id % 30 + 1))), 6) AS field_size, round(con, 6) AS concentration, round(CASE WHEN hi > lo THEN log10(hi - lo) ELSE -12 END, 6) AS span, CAST(sign(lo) AS DOUBLE) AS sign FROM m JOIN c USING (vec_id)""")
def field_features(t):
    """Size, concentration, span and sign of fields"""
    e = t("embeddings").select("vec_id", (F.col("vec_id") % 50 + 1).cast("double").alias("w"), (F.col("vec_id") % 30 + 1).cast("double").alias("h"), F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    f = E.sky_features(e, "vec_id", "v", "w", "h", 0.1)
    return f.select("vec_id", r("field_size").alias("field_size"), r("concentration").alias("concentration"), r("span").alias("span"), "sign")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS v FROM part), b AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM p)
SELECT k, round(ln(1000 * (least(greatest(v, lo), hi) - lo) / (hi - lo) + 1) / ln(1001), 6) AS stretched, round(least(greatest(v, lo), hi), 6)::DOUBLE AS again FROM p, b""")
def log_stretch(t):
    """The log stretch of clipped values, and back"""
    p = t("part").select(F.col("p_partkey").alias("k"), F.lit(1).alias("field"), F.col("p_size").cast("double").alias("v"))
    s = E.clip_stretch(p, "field", "v", 90.0, log=1000.0)
    limits = E.quantiles(p, [], "v", {"lo": 0.05, "hi": 0.95})
    back = s.crossJoin(F.broadcast(limits)).withColumn("again", E.unstretched("stretched", "lo", "hi", 1000.0))
    return back.select("k", r("stretched").alias("stretched"), r("again").alias("again"))
