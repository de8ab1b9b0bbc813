"""Nearest targets on the sky (J14, M19) by a tree of cells, none of which a point meets without need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, separation
from ..sources.scratch import written
from .keys import small_side

#: Depth at which cells aren't split any more: sides of 2^-19 radians.
DEEPEST = 10
#: What squared chords may be off by rounding.
SLACK = 1e-13


def _unit(ra: str, dec: str) -> list[Column]:
    """x, y, z of a direction: neither the poles nor 0h are special there, and chords order like separations."""
    a, d = F.radians(ra), F.radians(dec)
    return [(F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z")]


def _cell(level: int) -> Column:
    """The cell of x, y, z at a level: cubes around the sphere, four to a side in each cube of the level above."""
    n = 4**level
    place = lambda v: F.least(F.greatest(F.floor((F.col(v) + 1) / 2 * n), F.lit(0)), F.lit(n - 1))
    return (place("x") * 2**20 + place("y")) * 2**20 + place("z")


def nearest(points: DataFrame, targets: DataFrame, key: str, ra: str, dec: str, leaf: int) -> DataFrame:
    """points with separation and target: the nearest of the targets that share the key, of equally near ones the least.

    Targets lie in a tree of cells; cells of more than `leaf` are split. All points go down the tree together, a level at a
    time: each holds the cells whose least possible distance isn't beyond the nearest target known by then (each cell names
    one), so it widens its search just until the best separation rules the rest out. What a point meets in the end
    are the targets of a few leaves, as arrays of at most `leaf`.

    Each level is a join of the cells that are held with their children and is written; there are DEEPEST + 1 at most.
    Places are searched once, however many points or targets share them. Rows without key or without a finite place
    find nothing and aren't found; points of a key without targets have no row.
    """
    at, spot = [key, "ra", "dec"], lambda df: df.where(F.col(key).isNotNull() & finite(ra) & finite(dec))
    place = lambda df: spot(df).select(key, F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"), *([F.col("target")] if "target" in df.columns else []))
    open_targets = written(place(targets.select(key, ra, dec, "target")).groupBy(*at).agg(F.min("target").alias("target")).select("*", *_unit("ra", "dec")))
    if open_targets.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > leaf).isEmpty():  # each key is one leaf
        single = open_targets.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("ra", "dec", "target")).alias("_t"))
        least = F.array_min(F.transform("_t", lambda t: F.struct(separation(ra, dec, t["ra"], t["dec"]).alias("separation"), t["target"].alias("target"))))
        met = spot(points).join(small_side(single), F.col(key) == F.col("_k")).select(*points.columns, least.alias("_m"))
        return met.select(*points.columns, "_m.separation", "_m.target")
    asked = place(points.select(key, ra, dec)).distinct().select("*", *[u.alias(f"p{n}") for u, n in zip(_unit("ra", "dec"), "xyz")])
    front, results = asked.withColumn("parent", F.lit(0).cast("long")).withColumn("bound", F.lit(float("inf"))), []
    for level in range(DEEPEST + 1):
        celled = open_targets.withColumn("cell", _cell(level)).withColumn("parent", _cell(max(level - 1, 0)))
        sides = [f(v).alias(f"{n}{v}") for v in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = written(celled.groupBy(key, "parent", "cell").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y", "z"), "target").alias("named"), *sides))
        is_leaf = (F.col("n") <= leaf) if level < DEEPEST else F.lit(True)
        met = front.join(small_side(nodes), [key, "parent"])
        gap = lambda v: F.greatest(F.col(f"lo{v}") - F.col(f"p{v}"), F.col(f"p{v}") - F.col(f"hi{v}"), F.lit(0.0))
        square = lambda parts: reduce(lambda a, b: a + b, [p * p for p in parts])
        known = F.least("bound", F.min(square([F.col("named")[v] - F.col(f"p{v}") for v in "xyz"])).over(Window.partitionBy(*at)))
        held = met.withColumn("bound", known).where(square([gap(v) for v in "xyz"]) <= F.col("bound") + SLACK)
        held = written(held.select(*at, "px", "py", "pz", "bound", "cell", is_leaf.alias("leaf")))
        blocks = celled.join(small_side(nodes.where(is_leaf).select(key, "cell", F.ceil(F.col("n") / leaf).cast("int").alias("parts"))), [key, "cell"])
        dealt = blocks.groupBy(key, "cell", F.pmod(F.xxhash64("ra", "dec"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("ra", "dec", "target")).alias("targets"))
        best = F.array_min(F.transform("targets", lambda t: F.struct(separation("ra", "dec", t["ra"], t["dec"]).alias("separation"), t["target"].alias("target"))))
        results.append(held.where("leaf").join(dealt.drop("part"), [key, "cell"]).select(*at, best.alias("best")))
        if nodes.where(~is_leaf).isEmpty():
            break
        front = held.where("NOT leaf").withColumnRenamed("cell", "parent").drop("leaf")
        open_targets = written(celled.join(small_side(nodes.where(~is_leaf).select(key, "cell")), [key, "cell"], "left_semi").drop("cell", "parent"))
    found = written(reduce(DataFrame.union, results).groupBy(*[F.col(x).alias(f"_{x}") for x in at]).agg(F.min("best").alias("_m")))
    same = (F.col(key) == F.col(f"_{key}")) & (F.col(ra).cast("double") == F.col("_ra")) & (F.col(dec).cast("double") == F.col("_dec"))
    return points.join(small_side(found), same).select(*points.columns, "_m.separation", "_m.target")
