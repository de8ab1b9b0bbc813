"""Overlapping boxes of a figure (J12, B1-B4, O10) by tiles as large as the boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import boxes_overlap, finite, iou
from .keys import small_side

_SIDES = ("xmin", "ymin", "xmax", "ymax")
#: Boxes of a figure up to which all are compared with each other.
FEW = 64
#: A place is at most 4^FINEST tiles from 0, so that places in tiles are exact.
FINEST = 25


def _level(low: str, high: str) -> Column:
    """The power of 4 that is the side of a box's tiles: not less than its own side."""
    power = lambda x: F.ceil(F.log(4.0, x))
    furthest = F.greatest(F.abs(low), F.abs(high), F.lit(1e-300))
    return F.greatest(power(F.col(high) - F.col(low)), power(furthest) - FINEST).cast("int")


def _tile(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(4.0), level))


def _tiles(low: str, high: str, level: str) -> Column:
    return F.explode(F.sequence(_tile(F.col(low), F.col(level)), _tile(F.col(high), F.col(level))))


def _compared(boxes: DataFrame, figure: str) -> DataFrame:
    """overlapping for figures of few boxes: all of a figure's with each other."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.fig") == F.col("b.fig")) & (F.col("a.label") < F.col("b.label")) & boxes_overlap("a", "b")
    return a.join(b, on).select(F.col("a.fig").alias(figure), F.col("a.label").alias("first"), F.col("b.label").alias("second"), iou("a", "b").alias("iou"))


def overlapping(boxes: DataFrame, figure: str, label: str) -> DataFrame:
    """Pairs of a figure's boxes that share area, the lesser label first, with their IoU.

    A box belongs to a level of widths and one of heights, powers of 4, and covers at most two tiles of that size each way.
    Two boxes meet in tiles of the larger width and the larger height of both. Either one of them has both, then the
    other is dealt into tiles of the levels that its figure holds and that aren't finer than its own; or one is the wider and
    the other the taller, then each is dealt into tiles of its own larger side and the others' larger sides. So small
    boxes never meet by lying in one large tile. The tile that holds the corner where an overlap begins reports it: each pair
    is found once. Boxes of figures that hold FEW at most are compared directly.

    Boxes without four finite corners, figure or label, and those without area, overlap nothing; boxes with the same label
    aren't compared.
    """
    live = boxes.select(F.col(figure).alias("fig"), F.col(label).alias("label"), *[F.col(s).cast("double").alias(s) for s in _SIDES])
    live = live.where(" AND ".join(["fig IS NOT NULL", "label IS NOT NULL", "xmin < xmax", "ymin < ymax"])).where(finite("xmin") & finite("xmax") & finite("ymin") & finite("ymax"))
    counts = live.groupBy("fig").agg(F.count("*").alias("_n"))
    many = small_side(counts.where(F.col("_n") > FEW).select("fig"))
    if many.isEmpty():
        return _compared(live, figure)
    few, live = _compared(live.join(many, "fig", "left_anti"), figure), live.join(many, "fig", "left_semi")
    sized = live.withColumn("lx", _level("xmin", "xmax")).withColumn("ly", _level("ymin", "ymax"))
    # a figure's levels are few: one for each power of 4 between its smallest and largest box
    levels = sized.groupBy("fig").agg(F.collect_set(F.struct("lx", "ly")).alias("both"), F.collect_set("lx").alias("wide"), F.collect_set("ly").alias("tall"))
    levels = small_side(levels.withColumn("apart", F.bitwise_not(F.xxhash64("fig"))).withColumnRenamed("fig", "of"))
    known = sized.join(levels, (F.bitwise_not(F.xxhash64("fig")) == F.col("apart")) & (F.col("fig") == F.col("of"))).drop("apart", "of")
    plain = ["fig", "label", *_SIDES, "lx", "ly"]

    def dealt(df: DataFrame) -> DataFrame:
        """A row for each tile of level (cx, cy) that a box touches."""
        return df.select(*plain, "cx", "cy", _tiles("xmin", "xmax", "cx").alias("tx")).select("*", _tiles("ymin", "ymax", "cy").alias("ty"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = dealt(a).alias("a"), dealt(b).alias("b")
        same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("fig", "cx", "cy", "tx", "ty")]
        begins = [F.col(f"a.t{v}") == _tile(F.greatest(F.col(f"a.{v}min"), F.col(f"b.{v}min")), F.col(f"a.c{v}")) for v in "xy"]
        # of two boxes of one level both are natives: they meet twice, once in each order
        once = (F.col("a.label") != F.col("b.label")) & ((F.col("b.lx") < F.col("a.lx")) | (F.col("b.ly") < F.col("a.ly")) | (F.col("a.label") < F.col("b.label")))
        least, most = F.least("a.label", "b.label"), F.greatest("a.label", "b.label")
        on = once & boxes_overlap("a", "b") & begins[0] & begins[1]
        for s in same:
            on = s & on
        return a.join(b, on).select(F.col("a.fig").alias(figure), least.alias("first"), most.alias("second"), iou("a", "b").alias("iou"))

    native = sized.withColumn("cx", F.col("lx")).withColumn("cy", F.col("ly"))
    finer = known.select(*plain, F.explode(F.filter("both", lambda c: (c["lx"] >= F.col("lx")) & (c["ly"] >= F.col("ly")))).alias("c")).select(*plain, F.col("c.lx").alias("cx"), F.col("c.ly").alias("cy"))
    wider = known.select(*plain, F.col("lx").alias("cx"), F.explode(F.filter("tall", lambda y: y > F.col("ly"))).alias("cy"))
    taller = known.select(*plain, F.explode(F.filter("wide", lambda x: x > F.col("lx"))).alias("cx"), F.col("ly").alias("cy"))
    return few.union(met(native, finer)).union(met(wider, taller))
