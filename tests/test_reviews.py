"""Checked boxes against plain arithmetic, and generated points of figures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from figquarry.operators import fields as G
from figquarry.sources import labels as L


def result(kind, **value):
    return {"type": kind, "value": value}


def box(*points):
    return result("polygonlabels", points=[list(p) for p in points], polygonlabels=["plot box"])


def sky(x, y, height, s):
    turn, scale = math.radians(s["rotation"] - 180), math.radians(s["scale"] / 3600)
    dx, dy = x - s["x"], height - y - s["y"]
    xi, eta = scale * (math.sin(turn) * dy - math.cos(turn) * dx), scale * (math.sin(turn) * dx + math.cos(turn) * dy)
    d0 = math.radians(s["dec"])
    d = math.cos(d0) - eta * math.sin(d0)
    return math.radians(s["ra"]) + math.atan2(xi, d), math.atan2(math.sin(d0) + eta * math.cos(d0), math.hypot(xi, d))


def apart(a, b):
    return 60 * math.degrees(math.acos(min(1, math.sin(a[1]) * math.sin(b[1]) + math.cos(a[1]) * math.cos(b[1]) * math.cos(a[0] - b[0]))))


def test_reviewed_boxes(spark):
    square = [(10, 20), (90, 20), (90, 80), (10, 80)]
    note = lambda at, *r, **more: {"updated_at": at, "result": list(r), **more}
    tasks = {
        "last": {"predictions": [{"result": [box((0, 0), (1, 0), (1, 1), (0, 1))]}], "annotations": [note("2", box(*square[::-1]), result("choices", choices=["ok", "fine"])), note("1", box((0, 0), (5, 0), (5, 5), (0, 5))), note("9", box((0, 0), (9, 0), (9, 9), (0, 9)), was_cancelled=True)]},
        "tie": {"annotations": [note("2", box((0, 0), (5, 0), (5, 5), (0, 5))), note("2", box(*square))]},
        "untimed": {"annotations": [{"result": [box(*square)], "was_cancelled": None}]},
        "proposal": {"predictions": [{"result": [box(*square)]}], "annotations": []},
        "five": {"annotations": [note("1", box((10, 20), (50, 10), (90, 20), (90, 80), (10, 80)), result("textarea", text=["a", "b"]), result("choices", choices=["exclude this", "dim"]))]},
        "deleted": {"annotations": [note("1", result("choices", choices=["cut"]))]}, "empty": {}, "none": {"predictions": [], "annotations": None},
    }
    source = {"ra": 150.0, "dec": 60.0, "scale": 20.0, "x": 30.0, "y": 40.0, "rotation": 203.0}
    rows = spark.createDataFrame([(json.dumps({"data": {"vqa_id": k}, **v}),) for k, v in tasks.items()], "task string")
    figures = spark.createDataFrame([(k, 200.0, 100.0, source) for k in tasks], "vqa_id string, width double, height double, source struct<ra: double, dec: double, scale: double, x: double, y: double, rotation: double>")
    got = {r.vqa_id: r for r in L.reviewed_boxes(rows, figures).collect()}
    assert len(got) == 8
    corners = [sky(x, y, 100, source) for x, y in ((20, 20), (180, 20), (180, 80), (20, 80))]
    wide, high = (apart(corners[0], corners[1]) + apart(corners[3], corners[2])) / 2, (apart(corners[0], corners[3]) + apart(corners[1], corners[2])) / 2
    for k in ("last", "tie", "untimed", "proposal"):
        r = got[k]
        assert r.corners == [[20, 20], [180, 20], [180, 80], [20, 80]] and r.rectangle == [20, 20, 180, 80] and not r.exclude and r.warning is None
        assert (r.field_width, r.field_height) == (pytest.approx(wide, abs=1e-3), pytest.approx(high, abs=1e-3))
    assert got["last"].flags == ["ok", "fine"] and got["last"].status == "reviewed" and got["proposal"].status == "unreviewed (detector proposal)"
    five = got["five"]
    assert five.rectangle == [20, 10, 180, 80] and five.corners[0] == [20, 10] and five.warning.startswith("polygon has 5") and five.notes == "a b" and five.exclude and five.exclude_reason == "flagged by reviewer: exclude this"
    assert (got["deleted"].exclude_reason, got["empty"].exclude_reason, got["none"].status) == ("box deleted by reviewer (cut)", "no box available (missing)", "missing")
    assert all(got[k].corners is None and got[k].field_width is None for k in ("deleted", "empty", "none"))


def test_tasks_go_out_and_come_back(spark):
    at = "array<struct<x: double, y: double>>"
    boxes = spark.createDataFrame([("v1", "a", "v1.png", "m", 200, 100, [(20.0, 20.0), (180.0, 20.0), (180.0, 80.0), (20.0, 80.0)], ["x"], True, "[1, 2]"), ("v2", "b", "v2.png", "m", 10, 10, [(0.0, 0.0)], [], False, "[]")], f"vqa_id string, astroexplorer_id string, image string, method string, width int, height int, corners {at}, flags array<string>, needs_attention boolean, ref_pixel string")
    tasks = {r.vqa_id: json.loads(r.task) for r in L.label_tasks(boxes).collect()}
    assert tasks["v1"]["data"]["title"] == "v1   [check carefully]" and "NEEDS ATTENTION: x" in tasks["v1"]["data"]["info"] and tasks["v2"]["predictions"][0]["score"] == 0.9
    assert tasks["v1"]["predictions"][0]["result"][0]["value"] == {"points": [[10.0, 20.0], [90.0, 20.0], [90.0, 80.0], [10.0, 80.0]], "closed": True, "polygonlabels": ["plot box"]}
    back = {r.vqa_id: r for r in L.picked(L.label_tasks(boxes)).collect()}
    assert back["v1"].points[2] == [90.0, 80.0] and back["v1"].status.startswith("unreviewed") and back["v2"].flags == []


def test_points_of_figures(spark):
    f = spark.createDataFrame([(1, 3, 50), (2, 1, 400)], "k int, clusters int, points int")
    p = G.clustered_points(f, "k", 5, spread=0.05, colors=(2.0, 4.0)).toPandas()
    assert p.groupby(["k", "cluster"]).size().max() <= 400 and set(zip(p.k, p.cluster)) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert p.x.between(0, 1).all() and p.y.between(0, 1).all() and set(p[p.k == 1].groupby("cluster").color.first()) == {2.0, 3.0, 4.0}
    assert (p[p.k == 2].x.std() < 0.06)
    u = G.scattered_points(f, "k", 5, "points", 3).agg(*[F.min(f"x{i}") for i in range(3)], *[F.max(f"x{i}") for i in range(3)], F.count("*")).first()
    assert u[6] == 450 and all(0 <= v < 0.1 for v in u[:3]) and all(0.9 < v < 1 for v in u[3:6])
    plane = G.linear_fields(spark.createDataFrame([(1, 4, 3), (2, 1, 1)], "k int, nx int, ny int"), "k", 1).collect()
    assert len(plane) == 13 and {(r.k, r.iy, r.ix): r.value for r in plane}[1, 2, 3] == 1.5
