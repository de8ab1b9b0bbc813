"""Tasks for people who check boxes, and what they have answered, as records (X4; W4 and M22 on real shapes).

A task is JSON as labelling tools exchange it: data, predictions, annotations; each of the latter holds results of types
polygonlabels, choices and textarea, points in percent of the image from its top left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bounding_box, ordered_corners, separation, tan_sky

_RESULT = "array<struct<id: string, from_name: string, to_name: string, type: string, original_width: double, original_height: double, image_rotation: int, value: struct<points: array<array<double>>, closed: boolean, polygonlabels: array<string>, choices: array<string>, text: array<string>>>>"
TASK = f"data struct<image: string, vqa_id: string, astroexplorer_id: string, title: string, info: string>, predictions array<struct<model_version: string, score: double, result: {_RESULT}>>, annotations array<struct<was_cancelled: boolean, updated_at: string, result: {_RESULT}>>"

# Names that the labelling project gives its parts.
VERSION, LABEL, FOLDER, SCORES = "detect_plot_box_v1", "plot box", "/data/local-files/?d=images_nometa/", (0.5, 0.9)


def label_tasks(boxes: DataFrame) -> DataFrame:
    """X4, out: a task for each proposed box (vqa_id, astroexplorer_id, image, method, width, height, corners: array of
    struct<x, y> in pixels from the top left, flags, needs_attention, ref_pixel): vqa_id, task (JSON). The box is its prediction."""
    b = F.col
    points = F.transform("corners", lambda p: F.array(100.0 * p["x"] / b("width"), 100.0 * p["y"] / b("height")))
    attention = F.when(F.size("flags") > 0, F.concat(F.lit(" | NEEDS ATTENTION: "), F.array_join("flags", "; "))).otherwise("")
    info = F.concat(b("vqa_id"), F.lit(" | detector: "), b("method"), attention, F.lit(" | blue dot in overlays = AVM reference pixel "), b("ref_pixel"))
    data = F.struct(
        F.concat(F.lit(FOLDER), b("image")).alias("image"), b("vqa_id"), b("astroexplorer_id"),
        F.concat("vqa_id", F.when(b("needs_attention"), "   [check carefully]").otherwise("")).alias("title"), info.alias("info"),
    )
    value = F.struct(points.alias("points"), F.lit(True).alias("closed"), F.array(F.lit(LABEL)).alias("polygonlabels"))
    result = F.struct(
        F.concat(F.lit("auto_"), "vqa_id").alias("id"), F.lit("box").alias("from_name"), F.lit("image").alias("to_name"), F.lit("polygonlabels").alias("type"),
        b("width").cast("double").alias("original_width"), b("height").cast("double").alias("original_height"), F.lit(0).alias("image_rotation"), value.alias("value"),
    )
    prediction = F.struct(F.lit(VERSION).alias("model_version"), F.when(b("needs_attention"), SCORES[0]).otherwise(SCORES[1]).alias("score"), F.array(result).alias("result"))
    return boxes.select("vqa_id", F.to_json(F.struct(data.alias("data"), F.array(prediction).alias("predictions"))).alias("task"))


def _of_type(results: Column, kind: str) -> Column:
    return F.filter(results, lambda r: r["type"] == kind)


def picked(tasks: DataFrame, task: str = "task") -> DataFrame:
    """W4, X4, in: of each task (JSON) vqa_id, status, flags, notes and points (percent; NULL without a box): the latest
    annotation that wasn't cancelled (of equal times the last), else the first prediction, else nothing."""
    read = tasks.select(F.from_json(task, TASK).alias("t")).select("t.*")
    live = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    timed = F.transform(live, lambda a, i: F.struct(F.coalesce(a["updated_at"], F.lit("")).alias("at"), i.alias("i"), a["result"].alias("result")))
    last = F.reduce(timed, F.get(timed, F.lit(0)), lambda x, y: F.when(y["at"] >= x["at"], y).otherwise(x))
    result = F.when(F.size(live) > 0, last["result"]).otherwise(F.get("predictions", F.lit(0))["result"])
    status = F.when(F.size(live) > 0, "reviewed").when(F.size("predictions") > 0, "unreviewed (detector proposal)").otherwise("missing")
    chosen = read.select(F.col("data.vqa_id").alias("vqa_id"), status.alias("status"), F.coalesce(result, F.array()).alias("_r"))
    joined = lambda kind, field: F.flatten(F.transform(_of_type(F.col("_r"), kind), lambda r: F.coalesce(r["value"][field], F.array())))
    points = F.get(_of_type(F.col("_r"), "polygonlabels"), F.lit(0))["value"]["points"]
    return chosen.select("vqa_id", "status", joined("choices", "choices").alias("flags"), F.array_join(joined("textarea", "text"), " ").alias("notes"), points.alias("points"))


def reviewed_boxes(tasks: DataFrame, figures: DataFrame, task: str = "task") -> DataFrame:
    """The checked boxes of figures (vqa_id, width, height, source: struct<ra, dec, scale, x, y, rotation> in
    degrees, arc seconds a pixel and pixels from the bottom left): status, flags, notes, corners (in pixels, from the top left
    clockwise), their rectangle, the field they span on the sky in arc minutes, whether it is excluded and why.

    A box of other than four points counts as its rectangle, with a warning. Reviewed figures without a box, those
    without any, and those flagged so are excluded.
    """
    s, w, h = F.col("source"), F.col("width"), F.col("height")
    known = picked(tasks, task).join(figures, "vqa_id")
    pixels = F.transform("points", lambda p: F.struct((p[0] * w / 100.0).alias("x"), (p[1] * h / 100.0).alias("y")))
    box, four = F.col("_box"), F.size("points") == 4
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    rectangle = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    placed = known.withColumn("_px", pixels).withColumn("_box", bounding_box("_px")).withColumn("_c", F.when(F.col("points").isNotNull(), ordered_corners(F.when(four, F.col("_px")).otherwise(rectangle))))
    turn, scale = F.radians(F.coalesce(s["rotation"], F.lit(180.0)) - 180.0), s["scale"] / 3600.0

    def sky(p: Column) -> tuple[Column, Column]:
        dx, dy = p["x"] - s["x"], h - p["y"] - s["y"]
        return tan_sky(scale * (F.sin(turn) * dy - F.cos(turn) * dx), scale * (F.sin(turn) * dx + F.cos(turn) * dy), s["ra"], s["dec"])

    tl, tr, br, bl = (sky(F.get("_c", F.lit(i))) for i in range(4))
    side = lambda a, b: separation(a[0], a[1], b[0], b[1])
    arcmin = lambda a, b: F.round(30.0 * (a + b), 4)
    has, excluding = F.col("points").isNotNull(), F.filter("flags", lambda f: F.contains(f, F.lit("exclude")))
    among = lambda flags: F.when(F.size(flags) > 0, F.concat(F.lit(" ("), F.array_join(flags, "; "), F.lit(")"))).otherwise("")
    why = F.when(~has & (F.col("status") == "reviewed"), F.concat(F.lit("box deleted by reviewer"), among(F.col("flags"))))
    why = why.when(~has, F.concat(F.lit("no box available ("), "status", F.lit(")"))).when(F.size(excluding) > 0, F.concat(F.lit("flagged by reviewer: "), F.array_join(excluding, "; ")))
    tenth = lambda v: F.round(v, 1)
    return placed.select(
        "vqa_id", "status", "flags", "notes", F.transform("_c", lambda p: F.array(tenth(p["x"]), tenth(p["y"]))).alias("corners"),
        F.when(has, F.array(*[tenth(box[k]) for k in ("xmin", "ymin", "xmax", "ymax")])).alias("rectangle"), F.when(has, arcmin(side(tl, tr), side(bl, br))).alias("field_width"), F.when(has, arcmin(side(tl, bl), side(tr, br))).alias("field_height"),
        F.when(has & ~four, F.concat(F.lit("polygon has "), F.size("points").cast("string"), F.lit(" points; using its bounding rectangle"))).alias("warning"),
        why.isNotNull().alias("exclude"), why.alias("exclude_reason"),
    )
