"""Operators that must not bring one large key together: scans, quantiles, nearest targets, overlapping boxes."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from figquarry.operators import boxes as boxes_module
from figquarry.operators import evaluate as E
from figquarry.operators import ordered, sky
from figquarry.operators import relate as R
from figquarry.operators.boxes import overlapping


def skewed(n=4000):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(n) < 0.9, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    keys[:40] = None
    x = np.where(rng.random(n) < 0.5, 7.0, np.exp(3 * rng.normal(size=n)))
    return pd.DataFrame({"k": keys, "id": np.arange(n), "x": x, "v": rng.integers(0, 9, n).astype(float)})


@pytest.mark.parametrize("ranges", [1, 7, None])
@pytest.mark.parametrize("down", [False, True])
def test_scan(spark, ranges, down):
    p = skewed()
    p.loc[::11, "v"] = np.nan
    df = spark.createDataFrame([(k, int(i), float(x), None if v != v else float(v)) for k, i, x, v in p.itertuples(index=False)], "k string, id long, x double, v double")
    order = [F.desc("x") if down else F.col("x"), F.col("id")]
    got = ordered.scan(df, ["k"], order, place="place", total="n", sums={"s": F.col("v")}, previous={"before": F.col("v"), "id0": F.col("id")}, following={"after": F.col("v"), "id1": F.col("id")}, ranges=ranges)
    assert got.columns == ["k", "id", "x", "v", "place", "n", "s", "before", "id0", "after", "id1"]
    got = got.toPandas().set_index("id")
    for _, group in p.groupby("k", dropna=False):
        group = group.sort_values(["x", "id"], ascending=[not down, True])
        mine = got.loc[group.id]
        assert list(mine.place) == list(range(len(group))) and set(mine.n) == {len(group)}
        assert np.allclose(mine.s, group.v.fillna(0).cumsum())
        for name, want in (("before", group.v.shift(1)), ("after", group.v.shift(-1)), ("id0", group.id.shift(1)), ("id1", group.id.shift(-1))):
            assert np.array_equal(mine[name].astype(float).to_numpy(), want.astype(float).to_numpy(), equal_nan=True)


def test_a_hot_key_and_equal_rows_are_spread(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    sizes = [r["count"] for r in ordered.ranged(df, ["k"], [F.col("x")], 10).groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 4000
    same = spark.range(9_000).select(F.lit(1).alias("k"))
    assert sorted(r.p for r in ordered.scan(same, ["k"], [F.col("k")], place="p", ranges=6).collect()) == list(range(9_000))
    assert max(r["count"] for r in ordered.ranged(same, ["k"], [F.col("k")], 6).groupBy("_range").count().collect()) < 3000
    assert ordered.numbered(same.limit(0), [F.col("k")]).count() == 0 and ordered.numbered(same, [F.col("k")]).agg(F.max("number")).first()[0] == 8_999


@pytest.mark.parametrize("most", [5, 100_000])
@pytest.mark.parametrize("sketch", [8, 1000])
def test_quantiles_through_the_scan(spark, most, sketch):
    p = skewed()
    df = spark.createDataFrame([(k, float(x)) for k, x in zip(p.k, p.x)], "k string, x double")
    at = {"low": 0.01, "half": 0.5, "again": 0.5, "high": 0.999, "top": 1.0}
    got = {r.k: list(r)[1:] for r in E.quantiles(df, ["k"], "x", at, sketch, most).collect()}
    assert got == {None if k != k else k: pytest.approx(np.quantile(g.x, list(at.values())).tolist()) for k, g in p.groupby("k", dropna=False)}
    assert list(E.quantiles(df, [], "x", at, sketch, most).first()) == pytest.approx(np.quantile(p.x, list(at.values())).tolist())
    assert E.quantiles(df.limit(0), ["k"], "x", at).count() == 0


@pytest.mark.parametrize("large", [50, 100_000])
def test_light_and_gaps_of_a_large_key(spark, monkeypatch, large):
    monkeypatch.setattr(ordered, "LARGE", large)
    p = skewed()
    df = spark.createDataFrame([(k, float(x), float(x % 300)) for k, x in zip(p.k, p.x)], "k string, x double, deg double")
    got = {r.k: r.concentration for r in E.concentration(df.where("k IS NOT NULL"), "k", "x", 0.05).collect()}
    for k, g in p.dropna().groupby("k"):
        light = np.sort(g.x - g.x.min())[::-1]
        assert got[k] == pytest.approx(light[: max(1, math.floor(0.05 * len(g) + 0.5))].sum() / light.sum())
    gaps = {r.k: r.gap for r in E.circular_gap(df.where("k IS NOT NULL"), "k", "deg").collect()}
    for k, g in p.dropna().groupby("k"):
        d = np.unique(g.x % 300)
        assert gaps[k] == pytest.approx(max([*np.diff(d), d[0] + 360 - d[-1]]))


# --- nearest targets -------------------------------------------------------------------------------------------


def apart(a, b):
    (ra1, dec1), (ra2, dec2) = ([math.radians(x) for x in s] for s in (a, b))
    return 2 * math.asin(min(1.0, math.sqrt(math.sin((dec2 - dec1) / 2) ** 2 + math.cos(dec1) * math.cos(dec2) * math.sin((ra2 - ra1) / 2) ** 2)))


def by_hand(points, targets):
    found = {}
    for i, k, ra, dec in points:
        same = [(round(math.degrees(apart((ra, dec), (r, d))), 9), t) for t, key, r, d in targets if key == k and None not in (r, d, ra, dec)]
        if same:
            found[i] = min(same)
    return found


@pytest.mark.parametrize("leaf", [2, 16])
def test_nearest_everywhere_on_the_sky(spark, monkeypatch, leaf):
    rng = np.random.default_rng(3)
    anywhere = lambda n: list(zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))))
    cluster = [(200 + x, 10 + y) for x, y in rng.normal(scale=1e-3, size=(250, 2))]
    poles, wrap = [(float(r), d) for r in (0, 90, 181) for d in (89.9, -89.99, 90.0)], [(359.999, 0.0), (0.001, 0.0), (0.0, 0.5), (360.0, -0.25)]
    spots = [*anywhere(120), *cluster, *poles, *wrap, (50.0, 0.0), (50.0, 0.0), (10.0, 10.0), (30.0, 10.0)]
    targets = [(i, i % 2 if i > 20 else 0, float(r), float(d)) for i, (r, d) in enumerate(spots)] + [(900, 0, None, 1.0), (901, 5, 1.0, 1.0)]
    asked = [*anywhere(80), *cluster[:20], *poles, *wrap, (20.0, 10.0), (0.0, 0.0), (200.0, 10.0), (20.0, -10.0)]
    points = [(i, i % 2, float(r), float(d)) for i, (r, d) in enumerate(asked)] + [(700, 9, 1.0, 1.0), (701, 0, None, 1.0), (702, None, 1.0, 1.0), (703, 0, 50.0, 0.0)]
    held, write = [], sky.written

    def counted(df):
        out = write(df)
        held.append(out.count() if "leaf" in out.columns else 0)
        return out

    monkeypatch.setattr(sky, "written", counted)
    monkeypatch.setattr(R, "TARGET_BLOCK", leaf)
    p, q = spark.createDataFrame([*points, points[0]], "id int, k int, ra double, dec double"), spark.createDataFrame(targets, "target int, k int, ra double, dec double")
    rows = R.nearest(p, q, "k").collect()
    got, want = {r.id: (round(r.separation, 9), r.target) for r in rows}, by_hand(points, targets)
    assert set(got) == set(want) and len(rows) == len(want) + 1
    assert all(got[i][0] == pytest.approx(want[i][0], abs=1e-7) for i in want) and sum(got[i][1] == want[i][1] for i in want) >= len(want) - 2
    assert max(held) <= 12 * len(points)  # cells that points hold at a level, not points times targets (380)
    assert R.nearest(p, q.limit(0), "k").count() == 0 and R.nearest(p.limit(0), q, "k").count() == 0


def test_equally_near_targets_give_the_least(spark):
    targets = [(7 - i, 0, 90.0 * i, 0.0) for i in range(4)] + [(k, 1, 120.0, 45.0) for k in (9, 3, 5)]
    points = [(1, 0, 10.0, 90.0), (2, 0, 45.0, 0.0), (3, 1, 300.0, -45.0)]
    got = {r.id: r.target for r in sky.nearest(spark.createDataFrame(points, "id int, k int, ra double, dec double"), spark.createDataFrame(targets, "target int, k int, ra double, dec double"), "k", "ra", "dec", 1).collect()}
    assert got == {1: 4, 2: 6, 3: 3}


# --- overlapping boxes -----------------------------------------------------------------------------------------


def pairs_by_hand(boxes):
    out = set()
    for (f, i, ax0, ay0, ax1, ay1), (g, j, bx0, by0, bx1, by1) in itertools.combinations(boxes, 2):
        if f == g and i != j and max(ax0, bx0) < min(ax1, bx1) and max(ay0, by0) < min(ay1, by1):
            out.add((f, min(i, j), max(i, j)))
    return out


BOX = "fig string, label int, xmin double, ymin double, xmax double, ymax double"


@pytest.mark.parametrize("few", [0, 64, 1000])
def test_boxes_of_all_shapes(spark, monkeypatch, few):
    monkeypatch.setattr(boxes_module, "FEW", few)
    rng = np.random.default_rng(4)
    boxes, n = [], 260
    for i in range(n):
        x, y = rng.uniform(-100, 100, 2)
        w, h = np.exp(rng.uniform(-7, 5, 2))
        boxes.append(("f" if i % 3 else "g", i, *map(float, (x, y, x + w, y + h))))
    boxes += [("f", 1000, -500.0, -500.0, 500.0, 500.0), ("f", 1001, -500.0, 0.0, 500.0, 1e-9), ("f", 1002, 0.0, -1e12, 1e-9, 1e12), ("f", 1003, -4.0, -4.0, 0.0, 0.0), ("f", 1004, 0.0, 0.0, 4.0, 4.0), ("f", 1005, 0.0, 0.0, 4.0, 4.0), ("f", 1006, 3.0, 3.0, 3.0, 9.0)]
    boxes += [("f", i, 1e15 + i, 0.0, 1e15 + i + 2, 1e-3) for i in range(1100, 1110)]
    got = [(r.fig, r.first, r.second) for r in overlapping(spark.createDataFrame(boxes, BOX), "fig", "label").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_by_hand(boxes)
    odd = [("f", 1, None, 0.0, 1.0, 1.0), ("f", 2, 0.0, 0.0, 1.0, float("nan")), ("f", None, 0.0, 0.0, 9.0, 9.0), (None, 3, 0.0, 0.0, 9.0, 9.0), ("f", 4, float("-inf"), 0.0, 9.0, 9.0), ("f", 5, 0.0, 0.0, 2.0, 2.0), ("f", 5, 1.0, 1.0, 2.0, 2.0), ("f", 6, 5.0, 5.0, 4.0, 4.0)]
    assert overlapping(spark.createDataFrame(odd, BOX), "fig", "label").count() == 0


def test_a_figure_of_many_boxes(spark):
    n = 100_000
    grid = spark.range(n).select(F.lit("f").alias("fig"), F.col("id").cast("int").alias("label"), (F.col("id") % 400).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("y"))
    small = grid.select("fig", "label", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 0.9).alias("xmax"), (F.col("y") + 0.9).alias("ymax"))
    more = [("f", n + i, 0.95 + i, -1.0, 0.98 + i, 300.0) for i in range(300)] + [("f", 2 * n + i, -1.0, 0.95 + i, 500.0, 0.98 + i) for i in range(200)] + [("f", 3 * n, 10.5, 10.5, 12.5, 12.5)]
    found = overlapping(small.unionByName(spark.createDataFrame(more, BOX)), "fig", "label")
    kinds = {(r.a, r.b): r["count"] for r in found.groupBy(F.floor(F.col("first") / n).alias("a"), F.floor(F.col("second") / n).alias("b")).count().collect()}
    assert kinds == {(1, 2): 300 * 200, (0, 3): 9, (1, 3): 2, (2, 3): 2}
