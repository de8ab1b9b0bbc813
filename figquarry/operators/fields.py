
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import c, gaussian, hash_u01, noisy, rescale
from ..sources.scratch import written
from .evaluate import field_2d
from .ordered import numbered
from .relate import keyed_order, uniform_choice, weighted_choice

#: A uniform number in [0, 1) for a key and the number of the draw: the same on every partitioning.
Draw = Callable[[Column, Column | int], Column]


def hashed(seed: int) -> Draw:
    """Draws by hash, a stream for each key."""
    return lambda key, i: hash_u01(seed, key, F.lit(i) if isinstance(i, int) else i)


def uniform_points(spark: SparkSession, n: int, seed: int, dims: int = 2) -> DataFrame:
    """N points in the unit cube: id, x0, x1, ..."""
    return spark.range(n).select("id", *[hash_u01(seed + k, "id").alias(f"x{k}") for k in range(dims)])


def linear_field(spark: SparkSession, nx: int, ny: int, seed: int, slope: tuple[float, float] = (1.0, 0.5), noise: float = 0.0) -> DataFrame:
    """A plane on a grid with multiplicative noise: iy, ix, value."""
    cell = spark.range(nx * ny).select("id", F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    value = slope[0] * F.col("ix") / max(1, nx - 1) + slope[1] * F.col("iy") / max(1, ny - 1)
    return cell.select("iy", "ix", (value * (1 + noise * gaussian(seed, "id"))).alias("value"))


def linear_fields(figures: DataFrame, key: str, seed: int, slope: tuple[float, float] = (1.0, 0.5), noise: float = 0.0) -> DataFrame:
    """The plane of each figure (key, nx, ny) with multiplicative noise: key, iy, ix, value."""
    cell = figures.select(key, "nx", "ny", F.explode(F.sequence(F.lit(0), F.col("nx").cast("int") * F.col("ny").cast("int") - 1)).alias("_c"))
    cell = cell.select("*", F.floor(F.col("_c") / F.col("nx")).cast("int").alias("iy"), (F.col("_c") % F.col("nx")).cast("int").alias("ix"))
    share = lambda i, n: F.col(i) / F.greatest(F.col(n) - 1, F.lit(1))
    value = slope[0] * share("ix", "nx") + slope[1] * share("iy", "ny")
    return cell.select(key, "iy", "ix", (value * (1 + noise * gaussian(seed, key, "_c"))).alias("value"))


def scattered_points(figures: DataFrame, key: str, seed: int, points: str, dims: int = 2) -> DataFrame:
    """Uniform points of each figure in the unit cube: key, i, x0, x1, ..."""
    drawn = figures.select(key, F.explode(F.sequence(F.lit(0), F.col(points).cast("int") - 1)).alias("i"))
    return drawn.select(key, "i", *[hash_u01(seed + k, key, "i").alias(f"x{k}") for k in range(dims)])


def clustered_points(figures: DataFrame, key: str, seed: int, spread: float = 0.1, oversample: float = 3.0, noise: float = 0.0, colors: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The clusters of each figure (key, clusters, points: of each cluster) within the unit square: key, cluster, i, x, y,
    color, as mixture_points has them. A cluster's points are drawn and chosen where its row is."""
    cluster = figures.select(key, "clusters", "points", F.explode(F.sequence(F.lit(0), F.col("clusters").cast("int") - 1)).alias("cluster"))
    at = lambda k, i: hash_u01(seed + k, key, "cluster") + spread * gaussian(seed + 10 + 2 * k, key, "cluster", i) + noise / 2 * gaussian(seed + 20 + 2 * k, key, "cluster", i)
    drawn = F.transform(F.sequence(F.lit(0), F.ceil(F.col("points") * oversample).cast("int") - 1), lambda i: F.struct(at(0, i).alias("x"), at(1, i).alias("y")))
    kept = F.slice(F.filter(drawn, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1)), F.lit(1), F.col("points").cast("int"))
    color = noisy(rescale(F.col("cluster").cast("double"), F.lit(0.0), F.greatest(F.col("clusters") - 1, F.lit(1)).cast("double"), *colors), seed + 30, key, "cluster", "i", scale=noise)
    return cluster.select(key, "clusters", "cluster", F.posexplode(kept).alias("i", "p")).select(key, "cluster", "i", "p.x", "p.y", color.alias("color"))


def mixture_points(spark: SparkSession, clusters: int, points: int, seed: int, spread: float = 0.1, oversample: float = 3.0, noise: float = 0.0, colors: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Gaussian clusters within the unit square: cluster, id, x, y, color. Instead of drawing again for points that fall
    outside, each cluster draws `oversample` times as many and keeps the first that lie inside. Noise shifts points by
    half its size and scales colors, which run over the clusters in order."""
    drawn = spark.range(int(clusters * points * oversample)).select((F.col("id") % clusters).cast("int").alias("cluster"), "id")
    at = lambda k: hash_u01(seed + k, "cluster") + spread * gaussian(seed + 10 + 2 * k, "id") + noise / 2 * gaussian(seed + 20 + 2 * k, "id")
    inside = drawn.select("cluster", "id", at(0).alias("x"), at(1).alias("y")).where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
    color = noisy(rescale(F.col("cluster").cast("double"), F.lit(0.0), F.lit(float(clusters - 1)), *colors), seed + 30, "id", scale=noise)
    kept = inside.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("_r") <= points).drop("_r")
    return kept.withColumn("color", color)


def mixture_field(spark: SparkSession, clusters: int, points: int, nx: int, ny: int, seed: int, noise: float = 0.0, colors: tuple[float, float] | None = None) -> DataFrame:
    """The points binned on a grid: iy, ix, n; with colors also value: n rescaled to that range, with multiplicative noise."""
    field = field_2d(mixture_points(spark, clusters, points, seed), "x", "y", (0.0, 1.0, 0.0, 1.0), nx, ny)
    if colors is None:
        return field
    ends = F.broadcast(field.agg(F.min("n").alias("_lo"), F.max("n").alias("_hi")))
    return field.crossJoin(ends).select("iy", "ix", "n", noisy(rescale(F.col("n"), F.col("_lo"), F.col("_hi"), *colors), seed + 40, "iy", "ix", scale=noise).alias("value"))


def picked_range(draw: Draw, key: Column, i, low, high) -> tuple[Column, Column]:
    """Two uniform draws from [low, high], the lesser first."""
    span = c(high) - c(low) if isinstance(high, Column) else F.lit(float(high - low))
    a, b = (low + draw(key, i + k) * span for k in (0, 1))
    return F.least(a, b), F.greatest(a, b)


def field_ranges(df: DataFrame, key: str, draw: Draw, x: tuple[float, float], y: tuple[float, float], colors: tuple[float, float], aspect_limit: float, tries: int = 50) -> DataFrame:
    """Df with xmin, xmax, ymin, ymax, cmin, cmax: the first of `tries` picks whose aspect is within the limit either
    way; where there is none, one pick with the upper ends at eleven times the size of the lower ones."""

    def pick(i: Column, wide: bool) -> Column:
        end = lambda r: 11.0 * abs(r[0]) if wide else r[1]
        (x0, x1), (y0, y1) = picked_range(draw, F.col(key), 4 * i, x[0], end(x)), picked_range(draw, F.col(key), 4 * i + 2, y[0], end(y))
        return F.struct(x0.alias("xmin"), x1.alias("xmax"), y0.alias("ymin"), y1.alias("ymax"))

    def fits(r: Column) -> Column:
        w, h = r["xmax"] - r["xmin"], r["ymax"] - r["ymin"]
        return (w > 0) & (h > 0) & (w <= aspect_limit * h) & (h <= aspect_limit * w)

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: pick(i, False)), fits)
    c0, c1 = picked_range(draw, F.col(key), 4 * tries + 4, *colors)
    ranged = df.withColumn("_r", F.coalesce(F.get(found, F.lit(0)), pick(F.lit(tries), True)))
    return ranged.select(*df.columns, "_r.*", c0.alias("cmin"), c1.alias("cmax"))


def fields(figures: DataFrame, seed: int, clusters: int = 5, points: int = 2000, spread: float = 0.1, noise: float = 0.05) -> DataFrame:
    """The fields of figures (fig_id, distribution, nx, ny, xmin, xmax, ymin, ymax, cmin, cmax) on their grids: fig_id,
    iy, ix, x, y, value. random: uniform colors; linear: a plane with noise; gmm: binned clusters, rescaled, with noise.
    Other distributions have no rows. A figure's cells and points are made where its row is, by explode."""
    spec = figures.select("fig_id", "distribution", *[F.col(k).cast("int") for k in ("nx", "ny")], *[F.col(k).cast("double") for k in ("xmin", "xmax", "ymin", "ymax", "cmin", "cmax")])
    cell = spec.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)).alias("_c"))
    cell = cell.select("*", F.floor(F.col("_c") / F.col("nx")).cast("int").alias("iy"), (F.col("_c") % F.col("nx")).cast("int").alias("ix"))
    centre = lambda i, n, low, high: F.col(low) + (F.col(i) + 0.5) * (F.col(high) - F.col(low)) / F.col(n)
    cell = cell.withColumn("x", centre("ix", "nx", "xmin", "xmax")).withColumn("y", centre("iy", "ny", "ymin", "ymax"))
    span = F.col("cmax") - F.col("cmin")
    share = lambda k: hash_u01(seed + k, "fig_id")
    plane = (share(1) * (F.col("ix") + 0.5) / F.col("nx") + share(2) * (F.col("iy") + 0.5) / F.col("ny")) / (share(1) + share(2))
    value = F.when(F.col("distribution") == "random", F.col("cmin") + span * hash_u01(seed + 3, "fig_id", "_c")).when(F.col("distribution") == "linear", noisy(F.col("cmin") + span * plane, seed + 4, "fig_id", "_c", scale=noise))
    out = ["fig_id", "iy", "ix", "x", "y", "value"]
    plain = cell.where(F.col("distribution").isin("random", "linear")).withColumn("value", value).select(*out)
    # the square of each figure is the unit square until the points are binned
    drawn = spec.where("distribution = 'gmm'").select("fig_id", "nx", "ny", F.explode(F.sequence(F.lit(0), F.lit(clusters * points - 1))).alias("_i")).withColumn("_k", F.col("_i") % clusters)
    at = lambda k: hash_u01(seed + 10 + k, "fig_id", "_k") + spread * gaussian(seed + 20 + 2 * k, "fig_id", "_i")
    place = lambda v, n: F.when((v >= 0) & (v <= 1), F.least(F.floor(v * F.col(n)), F.col(n) - 1).cast("int"))
    counts = drawn.select("fig_id", place(at(0), "nx").alias("ix"), place(at(1), "ny").alias("iy")).where("ix IS NOT NULL AND iy IS NOT NULL").groupBy("fig_id", "iy", "ix").agg(F.count("*").alias("n"))
    grid = cell.where("distribution = 'gmm'").join(counts, ["fig_id", "iy", "ix"], "left").fillna(0, ["n"])
    w = Window.partitionBy("fig_id")  # one figure's grid
    lit = grid.withColumn("_lo", F.min("n").over(w)).withColumn("_hi", F.max("n").over(w))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col("n") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    binned = lit.withColumn("value", noisy(F.col("cmin") + span * unit, seed + 5, "fig_id", "_c", scale=noise)).select(*out)
    return plain.unionByName(binned)


def line_data(figures: DataFrame, key: str, seed: int, lines: str = "lines", points: str = "points") -> DataFrame:
    """Random lines of figures, their points in order of x within the unit square: key, line, i, x, y."""
    line = figures.select(key, points, F.explode(F.sequence(F.lit(0), F.col(lines) - 1)).alias("line"))
    xs = F.array_sort(F.transform(F.sequence(F.lit(0), F.col(points) - 1), lambda i: hash_u01(seed, key, "line", i)))
    return line.select(key, "line", F.posexplode(xs).alias("i", "x")).withColumn("y", hash_u01(seed + 1, key, "line", "i"))


def scatter_data(figures: DataFrame, key: str, seed: int, points: str = "points") -> DataFrame:
    """Random points of figures in the unit square, with a color: key, i, x, y, color; histograms take x alone."""
    each = figures.select(key, F.explode(F.sequence(F.lit(0), F.col(points) - 1)).alias("i"))
    return each.select(key, "i", *[hash_u01(seed + k, key, "i").alias(name) for k, name in enumerate(("x", "y", "color"))])


def pick_cutouts(requests: DataFrame, key: str, pool: DataFrame, surveys: DataFrame, missing: DataFrame, excluded: list[str], draw: Draw) -> DataFrame:
    """For each request an object of the pool (object, pdf, n: numbered from 0) and one of the surveys (survey) that is
    neither excluded nor known to lack it (missing: object, pdf, survey); NULL where none is left."""
    total = pool.agg(F.count("*").alias("_n"))
    asked = requests.crossJoin(F.broadcast(total)).withColumn("n", F.least(F.floor(draw(F.col(key), 0) * F.col("_n")), F.col("_n") - 1).cast("long")).drop("_n")
    chosen = asked.join(pool.withColumn("n", F.col("n").cast("long")), "n", "left").drop("n")
    usable = surveys.where(~F.col("survey").isin(*excluded)).agg(F.array_sort(F.collect_set("survey")).alias("_every"))  # the catalogue of surveys: some hundred names
    lacking = missing.groupBy("object", "pdf").agg(F.collect_set("survey").alias("_gone"))
    left = chosen.join(lacking, ["object", "pdf"], "left").crossJoin(F.broadcast(usable))
    rest = F.when(F.col("_gone").isNotNull(), F.array_except("_every", "_gone")).otherwise(F.col("_every"))
    kept = left.withColumn("_rest", F.array_sort(rest))
    return kept.select(key, "object", "pdf", F.when((F.size("_rest") > 0) & F.col("object").isNotNull(), uniform_choice(draw(F.col(key), 1), F.col("_rest"))).alias("survey"))


def accepted(df: DataFrame, key: str, seed: int, tries: int, draw, accept) -> DataFrame:
    """Rejection sampling: of `tries` draws for a key (draw: uniform number -> value) the first that is accepted, else NULL."""
    first = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: draw(hash_u01(seed, key, i))), accept)
    return df.withColumn("value", F.get(first, F.lit(0)))


def error_bars(df: DataFrame, key: str, value: str, seed: int, most: float = 0.1) -> DataFrame:
    """G8"""
    return df.withColumn("error", F.abs(F.col(value)) * most * hash_u01(seed, key))


def label_text(draw: Draw, key, nouns: list[str], words: int = 2, math: list[str] | None = None, math_share: float = 0.0, capitals: list[tuple[str, float]] = (("first", 1.0),)) -> Column:
    """Words picked for a key: nouns in one of the styles none, first (each word) or all, some replaced by inline math."""
    key = c(key)
    pick = lambda i, items: uniform_choice(draw(key, i), F.array(*map(F.lit, items)))
    style = weighted_choice(draw(key, 0), list(capitals))

    def word(k: int) -> Column:
        noun = pick(3 * k + 1, nouns)
        styled = F.when(style == "first", F.initcap(noun)).when(style == "all", F.upper(noun)).otherwise(noun)
        return F.when(draw(key, 3 * k + 2) <= math_share, pick(3 * k + 3, math)).otherwise(styled) if math else styled

    return F.concat_ws(" ", *[word(k) for k in range(words)])


#: Equinoxes that invented coordinates are given.
EQUINOXES = ["1900", "1950", "2000"]


def sky_labels(draw: Draw, key, names: list[tuple[str, str]], epoch_share: float, styles: list[tuple[str, str]], capitals: list[tuple[str, float]] = (("none", 1.0),), equinox=None) -> tuple[Column, Column]:
    """The labels of the axes of a sky panel: one pair of names, capitalised alike unless they hold math, and with some
    share the equinox (the header's, or else any of EQUINOXES) in a style of (start, end)."""
    key = c(key)
    one = lambda i, n: F.least(F.floor(draw(key, i) * n).cast("int"), F.lit(n - 1))
    of = lambda items, i: F.get(F.array(*map(F.lit, items)), i)
    cap, shown = weighted_choice(draw(key, 1), list(capitals)), draw(key, 2) < epoch_share
    year = F.coalesce(c(equinox).cast("string") if equinox is not None else F.lit(None).cast("string"), of(EQUINOXES, one(3, len(EQUINOXES))))
    stamp = F.concat(F.lit(" "), of([a for a, _ in styles], one(4, len(styles))), year, of([b for _, b in styles], one(4, len(styles))))

    def label(k: int) -> Column:
        name = of([pair[k] for pair in names], one(0, len(names)))
        plain = ~F.contains(name, F.lit("$"))
        styled = F.when(plain & (cap == "first"), F.initcap(name)).when(plain & (cap == "all"), F.upper(name)).otherwise(name)
        return F.when(shown, F.concat(styled, stamp)).otherwise(styled)

    return label(0), label(1)


def flatten_tree(df: DataFrame, tree: str) -> DataFrame:
    """Level -> kind -> name -> entry, or -> plot -> entry, as rows: level, kind, name, plot, entry (JSON). An entry holds Q.

    A tree is parsed once, as a VARIANT; its levels are opened by lateral table functions over parts of that value. Trees
    that aren't JSON, or in which a key stands twice in one object, have no rows.
    """
    spark, kept = df.sparkSession, [x for x in df.columns if x != tree]

    def opened(frame: DataFrame, value: str, key: str) -> DataFrame:
        """A row for each member of an object: key, and value instead of the object."""
        members = frame.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()))
        return members.where("key IS NOT NULL").select(*[x for x in frame.columns if x != value], F.col("key").alias(key), F.col("value").alias(value))

    leaf = df.select(*kept, F.try_parse_json(tree).alias("_t"))
    for name in ("level", "kind", "name"):
        leaf = opened(leaf, "_t", name)
    holds = lambda e: F.try_variant_get(e, "$.Q", "string").isNotNull()
    plot_or_self = F.when(holds(F.col("_t")), F.parse_json(F.lit("null"))).otherwise(F.col("_t"))
    # an entry stands for itself; what isn't one is opened once more
    deeper = leaf.withColumn("_p", plot_or_self).lateralJoin(spark.tvf.variant_explode_outer(F.col("_p").outer()))
    entry = F.when(holds(F.col("_t")), F.col("_t")).otherwise(F.col("value"))
    rows = deeper.select(*kept, "level", "kind", "name", F.when(~holds(F.col("_t")), F.col("key")).alias("plot"), entry.alias("_e")).where(holds(F.col("_e")))
    return rows.select(*kept, "level", "kind", "name", "plot", F.to_json("_e").alias("entry"))


def answers_map(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Each key's answers as one map, the least value for a name that stands twice."""
    return df.groupBy(key, name).agg(F.min(value).alias(value)).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("answers"))


#: Models that are trained at once.
PARALLEL = 8


def stratified_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """A fold for each row, labels spread alike: each label's rows are numbered in keyed order, by a scan."""
    return numbered(df, [keyed_order(key), F.col(key)], "_n", [label]).withColumn("fold", (F.col("_n") % folds).cast("int")).drop("_n")


def _trees(trees: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="_y", featuresCol="_f", maxIter=trees, maxDepth=3, seed=1)


def assembled(df: DataFrame, label: str, key: str, sets: dict[str, list[str]], folds: int) -> DataFrame:
    """key, label, _y, fold and a vector for each set of features, computed once and written: all models read that."""
    from pyspark.ml.feature import VectorAssembler

    every = sorted({f for chosen in sets.values() for f in chosen})
    data = written(stratified_folds(df.select(key, label, *every), label, key, folds).withColumn("_y", F.col(label).cast("double")))
    for name, chosen in sets.items():
        data = VectorAssembler(inputCols=chosen, outputCol=name).transform(data)
    return data.select(key, label, "_y", "fold", *sets)


def fold_models(data: DataFrame, sets: list[str], folds: int, trees: int) -> list[list]:
    """For each fold the models of all sets of features that didn't see it, by one cross validation over the fold column."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    gbt = _trees(trees)
    right = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
    grid = ParamGridBuilder().addGrid(gbt.featuresCol, sets).build()
    found = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=right, numFolds=folds, foldCol="fold", parallelism=PARALLEL, collectSubModels=True).fit(data)
    return found.subModels


def _predictions(data: DataFrame, models: list[list], keep: list[str]) -> DataFrame:
    """Each row with the predictions (_p0, _p1, ...) of its fold's models."""
    out = None
    for k, own in enumerate(models):
        part = data.where(F.col("fold") == k)
        for i, model in enumerate(own):
            part = model.setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("").transform(part)
        part = part.select(*keep, *[F.col(f"_p{i}").cast("int").alias(f"_p{i}") for i in range(len(own))])
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, label: str, key: str, features: list[str], folds: int = 5, trees: int = 10) -> DataFrame:
    """Gradient-boosted predictions for each row by a model that didn't see its fold: key, label, fold, predicted."""
    data = assembled(df, label, key, {"_f": features}, folds)
    return _predictions(data, fold_models(data, ["_f"], folds, trees), [key, label, "fold"]).withColumnRenamed("_p0", "predicted")


def baselines(df: DataFrame, label: str, key: str, features: list[str], folds: int = 5, trees: int = 10) -> DataFrame:
    """Accuracy in percent (out of fold) of the commonest label, of all features, of each alone and of all but each:
    features, n, accuracy, its standard deviation over folds, and recall (percent of label 1 that is found)."""
    sets = {"all": features} | {f"only {f}": [f] for f in features} | ({f"without {f}": [g for g in features if g != f] for f in features} if len(features) > 1 else {})
    columns = {f"_f{i}": chosen for i, chosen in enumerate(sets.values())}
    data = assembled(df, label, key, columns, folds)
    most = data.groupBy(label).agg(F.count("*").alias("n")).agg(F.max_by(label, F.struct("n", -F.col(label)))).first()[0]
    predicted = _predictions(data, fold_models(data, list(columns), folds, trees), [label, "fold"])
    named = F.array(F.struct(F.lit("majority").alias("features"), F.lit(most).cast("int").alias("p")), *[F.struct(F.lit(name).alias("features"), F.col(f"_p{i}").alias("p")) for i, name in enumerate(sets)])
    each = predicted.select(label, "fold", F.explode(named).alias("x")).select(label, "fold", "x.*")
    right, positive = (F.col(label) == F.col("p")).cast("long"), (F.col(label) == 1).cast("long")
    by_fold = each.groupBy("features", "fold").agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.sum(positive).alias("ones"), F.sum(right * positive).alias("found"))
    share = lambda a, b: 100 * F.sum(a) / F.sum(b)
    return by_fold.groupBy("features").agg(F.sum("n").alias("n"), share("right", "n").alias("accuracy"), (100 * F.stddev_pop(F.col("right") / F.col("n"))).alias("deviation"), share("found", "ones").alias("recall"))


def importances(df: DataFrame, label: str, features: list[str], trees: int = 10) -> DataFrame:
    """How much each feature adds to boosted trees over all rows; they sum to 1."""
    from pyspark.ml.feature import VectorAssembler

    data = written(VectorAssembler(inputCols=features, outputCol="_f").transform(df.withColumn("_y", F.col(label).cast("double"))).select("_y", "_f"))
    model = _trees(trees).fit(data)
    return df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of each pair, with the label's recall."""
    counts = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def angular_errors(df: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """Percent of separations below 1 and 10 and above 90 degrees, and their median."""
    from .evaluate import quantiles
    from .keys import beside

    share = lambda cond: 100 * F.avg(cond.cast("double"))
    s, known = F.col(sep), df.where(F.col(sep).isNotNull())
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), share(s < 1).alias("below1"), share(s < 10).alias("below10"), share(s > 90).alias("above90"))
    return beside(out, quantiles(known, keys, sep, {"median": 0.5}), keys)


def gaps(df: DataFrame, row: str, kind: str, measure: str, first: str, middle: str, last: str) -> DataFrame:
    """The steps from first to middle to last of a measure, and their sum."""
    from .evaluate import pivot_first

    wide = pivot_first(df, [row], kind, [first, middle, last], measure)
    a, b, d = F.col(first), F.col(middle), F.col(last)
    return wide.select(row, (b - a).alias("first_step"), (d - b).alias("second_step"), (d - a).alias("total"))
