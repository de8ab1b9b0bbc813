
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import angle_arcsec, c, normalise_name, separation
from . import sky
from .boxes import overlapping as overlapping
from .ordered import numbered


def with_category(facts: DataFrame, dimension: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts with their dimension row, and the facts that have none (for the caller to raise on)."""
    return facts.join(dimension, key), facts.join(dimension.select(key), key, "left_anti")


def merge_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side, with both sides' columns."""
    return a.join(b, key, "full_outer")


def two_tier(left: DataFrame, right: DataFrame, name: str, value: str) -> DataFrame:
    """The right side's value by exact name, else by normalised name; of several with one normalised name the least name's."""
    exact = right.groupBy(name).agg(F.min(value).alias("_exact"))
    loose = right.groupBy(normalise_name(name).alias("_norm")).agg(F.min_by(value, F.struct(name, value)).alias("_loose"))
    keyed = left.withColumn("_norm", normalise_name(name)).join(exact, name, "left").join(loose, "_norm", "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "normalised").otherwise("none")
    return keyed.select(*left.columns, F.coalesce("_exact", "_loose").alias(value), tier.alias("tier"))


def reconcile(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose counts differ between two tables."""
    x, y = a.select(key, F.col(count).alias("left_n")), b.select(key, F.col(count).alias("right_n"))
    return x.join(y, key, "full_outer").where(~F.col("left_n").eqNullSafe(F.col("right_n")))


def duplicates(df: DataFrame, key: list[Column], source: str) -> DataFrame:
    """Rows whose (rounded) key stands in more than one source, with how many rows and sources it has."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select(*df.columns, *[k.alias(n) for k, n in zip(key, names)])
    counts = keyed.groupBy(*names).agg(F.count("*").alias("rows"), F.countDistinct(source).alias("sources")).where("sources > 1")
    return keyed.join(counts, names).drop(*names)


#: Targets that a cell of the sky may hold before it is split.
TARGET_BLOCK = 64


def nearest(points: DataFrame, targets: DataFrame, key: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """For each point the nearest of the targets that share its key; of equally near ones the least."""
    return sky.nearest(points, targets, key, ra, dec, TARGET_BLOCK)


def segment_pairs(segments: DataFrame, figure: str, height: float, longest: int = 8) -> DataFrame:
    """Of the longest segments of a figure, the first pair that is apart in y and overlaps in x by more than half."""
    from ..functions.scalars import interval_overlap

    ranked = segments.withColumn("_r", F.row_number().over(Window.partitionBy(figure).orderBy(F.desc(F.col("x1") - F.col("x0")), "x0", "y"))).where(F.col("_r") <= longest)
    a, b = ranked.alias("a"), ranked.alias("b")
    cond = (F.col(f"a.{figure}") == F.col(f"b.{figure}")) & (F.col("a._r") < F.col("b._r")) & (F.abs(F.col("a.y") - F.col("b.y")) > 0.15 * height) & (interval_overlap("a.x0", "a.x1", "b.x0", "b.x1") > 0.5)
    pair = F.struct(F.col("a._r").alias("i"), F.col("b._r").alias("j"), F.col("a.y").alias("y0"), F.col("b.y").alias("y1"))
    return a.join(b, cond).groupBy(F.col(f"a.{figure}").alias(figure)).agg(F.min(pair).alias("p")).select(figure, "p.*")


def keyed_order(key, multiplier: int = 7919, offset: int = 104729, modulus: int = 1_000_003) -> Column:
    """A pseudo-random order of integer keys by exact integer arithmetic, the same in any engine."""
    return F.pmod(c(key).cast("long") * multiplier + offset, F.lit(modulus))


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """N rows of each group, the same whatever the partitioning."""
    order = Window.partitionBy(*groups).orderBy(keyed_order(key), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def assign_ids(known: DataFrame, keys: DataFrame, key: str, number: str = "number") -> DataFrame:
    """Known numbers stay; new keys get the next ones in keyed order."""
    new = keys.select(key).distinct().join(known.select(key), key, "left_anti")
    last = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    placed = numbered(new, [keyed_order(key), F.col(key)], "_r").crossJoin(F.broadcast(last))
    return known.select(key, number).unionByName(placed.select(key, (F.col("_last") + F.col("_r") + 1).cast(known.schema[number].dataType).alias(number)))


def assign_pool(items: DataFrame, pool: DataFrame, item: str, value: str) -> DataFrame:
    """The k-th item gets the pool's k mod n-th value, both in keyed order."""
    n = pool.agg(F.count("*").alias("_n"))
    p = numbered(pool.select(value), [keyed_order(value), F.col(value)], "_p")
    k = numbered(items, [keyed_order(item), F.col(item)], "_k").crossJoin(F.broadcast(n))
    return k.withColumn("_p", F.col("_k") % F.col("_n")).join(p, "_p").drop("_p", "_k", "_n")


def strided_map(df: DataFrame, order: list[str], workers: int, run, schema: str) -> DataFrame:
    """Rows dealt to workers in turn, each worker's rows worked on by one task, and what it returns.

    run maps an iterator of pandas frames, which hold the columns of df, `place` (from 0) and `worker`, to one of frames
    of the schema: it is handed parts of a worker's rows, never all at once. Results come in any order; with place
    among them they can be put in that of the rows.
    """
    placed = numbered(df, [F.col(x) for x in order], "place").withColumn("worker", F.col("place") % workers)
    return placed.repartition(workers, "worker").mapInPandas(run, schema)


def weighted_choice(u, choices: list[tuple[str, float]]) -> Column:
    """The choice at a uniform number, weights renormalised."""
    total, reached, out = sum(w for _, w in choices), 0.0, F.lit(choices[-1][0])
    bounds = []
    for name, w in choices:
        reached += w / total
        bounds.append((name, reached))
    for name, bound in reversed(bounds[:-1]):
        out = F.when(c(u) < bound, name).otherwise(out)
    return out


def uniform_choice(u, items) -> Column:
    """The item of an array at a uniform number."""
    return F.get(c(items), F.least(F.floor(c(u) * F.size(c(items))).cast("int"), F.size(c(items)) - 1))


def object_filter(object: str | None = None, wavelength: str | None = None, pdf: str | None = None, itable: int | None = None) -> Column:
    """The conjunction of whichever filters are given: substrings, blanks (or dots and underscores) and case ignored; itable exactly."""
    conds = [F.lit(True)]
    if object:
        conds.append(F.contains(F.lower(F.replace("object", F.lit(" "), F.lit(""))), F.lit(object.replace(" ", "").lower())))
    if wavelength:
        conds.append(F.contains(F.lower("wavelength"), F.lit(wavelength.lower())))
    if pdf:
        conds.append(F.contains(F.translate(F.lower("pdf"), "._", ""), F.lit(pdf.lower().replace(".", "").replace("_", ""))))
    if itable is not None:
        conds.append(F.col("itable") == itable)
    return reduce(lambda a, b: a & b, conds)


def select_question(text, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule all of whose substrings are in the text, in lower case."""
    low, out = F.lower(c(text)), F.lit(None).cast("string")
    for name, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in parts]), name).otherwise(out)
    return out


def figure_category(type_, distribution) -> Column:
    """By the first panel."""
    return F.when(c(type_) == "contour", "contour").when(c(distribution) == "gmm", "sky-gmm").otherwise("sky-real")


def category_of_sets(types, distributions) -> Column:
    """By the sets of all panels' types and distributions."""
    t, d = F.array_sort(F.array_distinct(c(types))), F.array_sort(F.array_distinct(c(distributions)))
    return (
        F.when(t == F.array(F.lit("contour")), "contour")
        .when(~F.array_contains(t, "contour") & (d == F.array(F.lit("gmm"))), "sky-gmm")
        .when(~F.array_contains(t, "contour") & (d == F.array(F.lit("sky"))), "sky-real")
        .when(~F.array_contains(t, "contour") & (F.size(d) > 1), "sky-mixed")
        .otherwise("other")
    )


def survey_resolution(resolution_text, pixel_arcsec, beams: float = 2.5) -> Column:
    """A survey's resolution in arc seconds: as stated, else so many of its pixels."""
    return F.coalesce(angle_arcsec(resolution_text), beams * c(pixel_arcsec))


def survey_range(resolution_arcsec, fov_arcsec, res_factor: float = 50.0, fov_factor: float = 0.75, ceiling: float | None = 18000.0, on_conflict: str = "clamp") -> tuple[Column, Column]:
    """The field sizes (low, high; arc seconds) to ask a survey for: res_factor resolutions up to fov_factor of its
    field of view, and at most `ceiling`. Where they cross, high holds for both ("clamp") or there is no range ("none").
    Without resolution or a positive field of view there is none."""
    high = fov_factor * c(fov_arcsec)
    high = high if ceiling is None else F.least(high, F.lit(float(ceiling)))
    low = res_factor * c(resolution_arcsec)
    known = (c(fov_arcsec) > 0) & low.isNotNull()
    if on_conflict == "clamp":
        return F.when(known, F.least(low, high)), F.when(known, high)
    return F.when(known & (low < high), low), F.when(known & (low < high), high)


def field_size(major_arcsec, low, high, u, factor: float = 3.0) -> Column:
    """`factor` times the object's major axis, within the survey's range if it has one; without an object a
    log-uniform draw from the range; NULL with neither."""
    size = F.when(c(major_arcsec) > 0, factor * c(major_arcsec))
    held = F.when(c(low).isNotNull(), F.least(F.greatest(size, c(low)), c(high))).otherwise(size)
    return F.when(size.isNotNull(), held).otherwise(F.exp(F.log(c(low)) + c(u) * (F.log(c(high)) - F.log(c(low)))))


def field_size_by(df: DataFrame, policy, name: str = "field_size") -> DataFrame:
    """Df with the size that a policy gives; policy(low, high, major, u) -> Column. field_size is the usual one."""
    return df.withColumn(name, policy(F.col("low"), F.col("high"), F.col("major"), F.col("u")))


def bernoulli_plan(df: DataFrame, key: str, effects: list[tuple[str, str, float]], draw) -> DataFrame:
    """Which effects (name, phase, probability) each key gets: one draw for each effect in order. draw(key, i) -> uniform number."""
    made = [F.when(draw(F.col(key), i) < p, F.struct(F.lit(name).alias("name"), F.lit(phase).alias("phase"))) for i, (name, phase, p) in enumerate(effects)]
    chosen = df.withColumn("_e", F.filter(F.array(*made), lambda e: e.isNotNull()))
    phases = list(dict.fromkeys(phase for _, phase, _ in effects))
    by_phase = F.map_filter(F.create_map(*[x for ph in phases for x in (F.lit(ph), F.transform(F.filter("_e", _in_phase(ph)), lambda e: e["name"]))]), lambda _, v: F.size(v) > 0)
    return chosen.select(*df.columns, F.transform("_e", lambda e: e["name"]).alias("effects"), by_phase.alias("effects_by_phase"))


def _in_phase(phase: str):
    return lambda e: e["phase"] == phase


def image_tag(keys) -> Column:
    """Image, contour, image + contour, or none, from the drawn keys of a panel."""
    has = lambda k: F.array_contains(c(keys), k)
    return F.when(has("image") & has("contour"), "image + contour").when(has("image"), "image").when(has("contour"), "contour").otherwise("none")


def box_on_sky(x0, y0, x1, y1, scale, ra0, dec0) -> tuple[Column, Column]:
    """Mean angular width and height (degrees) of a box in pixels from the reference point, over its opposite edges."""
    from ..functions.scalars import tan_sky

    s = c(scale)
    corner = lambda x, y: tan_sky(c(x) * s, c(y) * s, ra0, dec0)
    a, b, d, e = corner(x0, y0), corner(x1, y0), corner(x0, y1), corner(x1, y1)
    side = lambda p, q: separation(p[0], p[1], q[0], q[1])
    return (side(a, b) + side(d, e)) / 2, (side(a, d) + side(b, e)) / 2


def required(left: DataFrame, right: DataFrame, key: str, optional: list | None = None) -> DataFrame:
    """Left with right's columns; a key without a row there that isn't optional is an error that names it."""
    found = right.withColumn("_found", F.lit(True))
    may_miss = F.col(key).isin(*optional) if optional else F.lit(False)
    checked = F.when(F.col("_found").isNull() & ~may_miss, F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col(key))
    others = [x for x in left.columns if x != key]
    return left.join(found, key, "left").select(checked.alias(key), *others, *[x for x in right.columns if x != key])


def enriched(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Df with columns of the other side's rows of a key, NULL where there is none (other has one row a key)."""
    return df.join(other.select(key, *columns), key, "left")


def flagged(df: DataFrame, members: DataFrame, keys: list[str], name: str = "known") -> DataFrame:
    """Df with a flag for keys (composite ones too) that stand in members."""
    return df.join(members.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def not_stopped(a, b, stop: list[str]) -> Column:
    """Not both words on the stop list."""
    return ~(c(a).isin(*stop) & c(b).isin(*stop))


def without_places(items, places) -> Column:
    """An array without the elements at the places (from 0) in another array."""
    return F.filter(c(items), lambda _, i: ~F.array_contains(c(places), i))


def grow_sample(df: DataFrame, kept: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """What is kept, and n more rows of each group from the rest."""
    rest = df.join(kept.select(key), key, "left_anti").select(*df.columns)
    return df.join(kept.select(key), key, "left_semi").select(*df.columns).unionByName(sample_per_group(rest, groups, key, n))


#: The parts of a panel that have a box of their own, with their labels.
PANEL_BOXES = [("square", "square"), ("title", "title"), ("xlabel", "xlabel"), ("ylabel", "ylabel"), ("x_offset", "x-offset text"), ("y_offset", "y-offset text"), ("colorbar", "colorbar"), ("colorbar_label", "colorbar label"), ("colorbar_offset", "colorbar offset text")]
TICK_BOXES = [("xticks", "x-tick labels", True), ("yticks", "y-tick labels", True), ("colorbar_ticks", "colorbar tick", False)]


def collect_boxes(panels: DataFrame, keys: list[str], grace: float = 5.0) -> DataFrame:
    """The boxes of panels as rows: keys, label, n (place among those of the label), xmin, ymin, xmax, ymax.

    panels have a struct of xmin, ymin, xmax, ymax for each part they hold (PANEL_BOXES) and arrays of tick boxes, those
    of the axes with their position tx, ty: axis ticks further than `grace` outside the square are left out.
    """
    q = F.col("square")
    box = lambda label, n, b: F.struct(F.lit(label).alias("label"), n.cast("int").alias("n"), *[b[x].cast("double").alias(x) for x in ("xmin", "ymin", "xmax", "ymax")])
    near = lambda t: t["tx"].between(q["xmin"] - grace, q["xmax"] + grace) & t["ty"].between(q["ymin"] - grace, q["ymax"] + grace)

    def ticks(name: str, label: str, on_axis: bool) -> Column:
        kept = F.filter(name, near) if on_axis else F.col(name)
        return F.coalesce(F.transform(kept, lambda t, i: box(label, i, t)), F.array())

    single = [F.when(F.col(name).isNotNull(), box(label, F.lit(0), F.col(name))) for name, label in PANEL_BOXES if name in panels.columns]
    every = [F.array_compact(F.array(*single))] + [ticks(*part) for part in TICK_BOXES if part[0] in panels.columns]
    return panels.select(*keys, F.explode(F.concat(*every)).alias("_b")).select(*keys, "_b.*")
