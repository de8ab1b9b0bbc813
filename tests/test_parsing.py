"""One-pass HTML, question trees as VARIANT, edit distances, sky ranges of displayed boxes, cross-validated baselines."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from figquarry.functions import html as H
from figquarry.functions import scalars as S
from figquarry.operators import fields as G
from figquarry.operators import questions as Q

ODD = [
    ("<table><tr><th>a</th><td>1</td></tr></table>", [(0, 0, 0, True, "a"), (0, 0, 1, False, "1")]),
    ("<TABLE><TR><TH>a<TD>1<TR><TH>b<TD>2 &amp; 3</TABLE>", [(0, 0, 0, True, "a"), (0, 0, 1, False, "1"), (0, 1, 0, True, "b"), (0, 1, 1, False, "2 & 3")]),  # nothing is closed
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", [(0, 0, 0, False, "x"), (0, 0, 1, False, "y"), (0, 1, 1, False, "z")]),
    ("<table><tr><td colspan='2'>x</td><td>y</td></tr><tr><td>1<td>2<td rowspan=3>3<tr><td>4<td>5</table>", [(0, 0, 0, False, "x"), (0, 0, 2, False, "y"), (0, 1, 0, False, "1"), (0, 1, 1, False, "2"), (0, 1, 2, False, "3"), (0, 2, 0, False, "4"), (0, 2, 1, False, "5")]),
    ("<table><tr><td>out <table><tr><td>in</td></tr></table> side<td>next</table>", [(1, 0, 0, False, "in"), (0, 0, 0, False, "out side"), (0, 0, 1, False, "next")]),
    ("<table><td>no row<!-- <td>not</td> --><td>&eacute;&#233;&#xe9;&nbsp;&bogus;</table>", [(0, 0, 0, False, "no row"), (0, 0, 1, False, "ééé &bogus;")]),
    ("<td>no table</td></table></tr>", []), ("", []), (None, []), ("<table><tr><td>open", [(0, 0, 0, False, "open")]),
    ("<table><tr><td>a<br>b<script>if (a<b) {'</td>'}</script><p>c</p>d</td></tr></table><table><caption>t</caption><tr><td>2nd</table>", [(0, 0, 0, False, "ab c d"), (1, 0, 0, False, "2nd")]),
]


def test_cells_of_odd_tables(spark):
    ODD[-1][1][0] = (0, 0, 0, False, "a b c d")  # a line break parts words
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(ODD)], "i int, html string")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", H.html_cells("html").alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(ODD)}
    pairs = df.select("i", H.html_pairs("html").alias("m")).collect()
    assert {r.i: r.m for r in pairs if r.m} == {0: {"a": "1"}, 1: {"a": "1", "b": "2 & 3"}}


def test_elements(spark):
    page = "<title>T &lt;x&gt;</title><script>var a='<p>no</p>'</script><ul><li><a href='/1'>one <b>bold</b></a><li>two</ul><P>first<p>second <a HREF=\"/2\">link</a><div>not in it</div><p/>"
    got = spark.createDataFrame([(page,), (None,)], "html string").select(H.html_elements("html", ["title", "LI", "p", "a"]).alias("e")).collect()
    assert [tuple(x) for x in got[0].e] == [("title", "T <x>", None), ("a", "one bold", "/1"), ("li", "one bold", None), ("li", "two", None), ("p", "first", None), ("a", "link", "/2"), ("p", "second link not in it", None), ("p", "", None)] and got[1].e == []


def test_elements_with_references_as_written(spark):
    page = "<title>a &amp;amp; &quot;b&quot; &copy &am</title><a href='/?a&amp;b=&lt;'>&#65;</a>"
    df = spark.createDataFrame([(page,)], "html string")
    got = df.select(H.html_elements("html", ["title", "a"], resolve=False).alias("e")).first().e
    assert [tuple(x) for x in got] == [("title", "a &amp;amp; &quot;b&quot; &copy &am", None), ("a", "&#65;", "/?a&amp;b=&lt;")]
    got = df.select(H.html_elements("html", ["title", "a"]).alias("e")).first().e
    assert [tuple(x) for x in got] == [("title", 'a &amp; "b" © &am', None), ("a", "A", "/?a&b=<")]


def test_a_deep_page_is_one_pass(spark):
    page = "<table><tr><td>" * 3000 + "x" + "</table>" * 1500
    began = time.perf_counter()
    assert len(H.parsed(page).cells) == 3000 and time.perf_counter() - began < 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abé😀", k=rng.randint(0, 40))) for _ in range(2))
        assert S.bit_distance(a, b) == distance(a, b) == S.diagonal_distance(a, b, 40)
        assert S.diagonal_distance(a, b, 3) == (distance(a, b) if distance(a, b) <= 3 else None)


def test_edit_distance_of_long_texts(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghé ", k=100_000))
    changed = list(text)
    for _ in range(30):
        changed[rng.randrange(len(changed))] = "X"
    near = "".join(changed[:50_000]) + "new" + "".join(changed[50_003:])
    other = "".join(rng.choices("abcdefghé ", k=3_000))
    rows = [(0, text, near), (1, text[:3_000], other), (2, None, "a"), (3, "", "abc"), (4, "kitten", "sitting"), (5, text[:2_000], text[1_000:3_000])]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    began = time.perf_counter()
    got = {r.i: r.d for r in df.select("i", S.edit_distance("a", "b").alias("d")).collect()}
    assert time.perf_counter() - began < 60
    want = {i: distance(a, b) for i, a, b in rows[1:] if a is not None}
    assert {i: got[i] for i in want} == want and got[2] is None and 0 < got[0] <= 36 and got[0] == S.bit_distance(text, near)


def test_question_trees_are_parsed_once(spark):
    trees = [{"L1": {"Figure": {"rows": {"Q": "how many?", "n": 1.5}, "type": {"plot0": {"Q": "a"}, "plot1": {"Q": "b"}, "note": 3}}, "empty": {}}, "L2": "text", "L3": ["Q"]}, {"L1": {"k": {"x": {"Q": None}, "y": {"Q": {"deep": 1}}, "z": {"Q": 7}}}}, {}]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(9, "{"), (10, None), (11, "[1]"), (12, '{"a":1,"a":2}')]
    found = G.flatten_tree(spark.createDataFrame(rows, "fig int, tree string"), "tree")
    got = sorted((r.fig, r.level, r.kind, r.name, r.plot or "", json.loads(r.entry)["Q"]) for r in found.collect() if r.fig == 0)
    assert got == [(0, "L1", "Figure", "rows", "", "how many?"), (0, "L1", "Figure", "type", "plot0", "a"), (0, "L1", "Figure", "type", "plot1", "b")]
    assert sorted((r.fig, r.name) for r in found.collect() if r.fig) == [(1, "y"), (1, "z")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2 and "from_json" not in plan  # the other one is the literal null


def grid_ranges(ra0, dec0, cd, p, box, n):
    """All points of a grid, as the definition has it."""
    gx, gy = np.meshgrid(np.linspace(box[0], box[1], n), np.linspace(box[2], box[3], n))
    dx, dy = gx + 1 - p[0], gy + 1 - p[1]
    xi, eta, d0 = np.radians(cd[0] * dx + cd[1] * dy), np.radians(cd[2] * dx + cd[3] * dy), np.radians(dec0)
    d = np.cos(d0) - eta * np.sin(d0)
    ra, dec = np.mod(ra0 + np.degrees(np.arctan2(xi, d)), 360).ravel(), np.degrees(np.arctan2(np.sin(d0) + eta * np.cos(d0), np.hypot(xi, d)))
    s = np.sort(ra)
    gaps = np.append(np.diff(s), s[0] + 360 - s[-1])
    i = int(np.argmax(gaps))
    arc, low = 360 - gaps[i], s[(i + 1) % len(s)]
    return (None, None) + (dec.min(), dec.max()) if arc > 180 else (low, low + arc, dec.min(), dec.max())


@pytest.mark.parametrize("n", [192, 5])
def test_sky_ranges_are_those_of_the_whole_grid(spark, n):
    rng, rows, want = np.random.default_rng(n), [], []
    for k in range(150):
        dec0 = float(rng.choice([rng.uniform(-90, 90), rng.uniform(88.5, 90), rng.uniform(-90, -89), 0.0, 90.0]))
        ra0, turn, size = float(rng.choice([0.0, 359.9, rng.uniform(0, 360)])), rng.uniform(0, 2 * np.pi), float(10 ** rng.uniform(-3, -1.3))
        cd = [-size * np.cos(turn), size * np.sin(turn), size * np.sin(turn), size * np.cos(turn)]
        p = (float(rng.uniform(1, 40)), float(rng.uniform(1, 30)))
        limits = ([3.0, 30.0], [2.0, 25.0]) if k % 2 else (None, None)
        header = f"CRVAL1 = {ra0} CRVAL2 = {dec0} CRPIX1 = {p[0]} CRPIX2 = {p[1]} CD1_1 = {cd[0]} CD1_2 = {cd[1]} CD2_1 = {cd[2]} CD2_2 = {cd[3]}"
        rows.append((k, header, *limits))
        want.append(grid_ranges(ra0, dec0, cd, p, (3, 30, 2, 25) if k % 2 else (0, 39, 0, 29), n))
    df = spark.createDataFrame(rows, "k int, wcs_header string, x_pixel_limits array<double>, y_pixel_limits array<double>")
    panel = F.struct("wcs_header", "x_pixel_limits", "y_pixel_limits", F.array_repeat(F.array_repeat(F.lit(1.0), 40), 30).alias("colors"))
    got = {r.k: tuple(r.s) for r in df.select("k", Q.sky_ranges(panel, n).alias("s")).collect()}
    assert sum(w[0] is None for w in want) > 10
    for k, w in enumerate(want):
        assert got[k] == pytest.approx(w, abs=1e-8) if w[0] is not None else (got[k][:2] == (None, None) and got[k][2:] == pytest.approx(w[2:], abs=1e-8))


def test_baselines_on_separable_data(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, k % 2, k % 2 + 0.3 * rng.random(), rng.random()) for k in range(160)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double")
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    slow = df.withColumn("a", F.udf(counted, "double")("a"))
    got = {r.features: r for r in G.baselines(slow, "label", "id", ["a", "b"], folds=4, trees=10).collect()}
    assert seen.value <= 2 * len(rows)  # once for the splitters of the folds' numbering, once for the table that all 20 models read
    assert set(got) == {"majority", "all", "only a", "only b", "without a", "without b"} and {r.n for r in got.values()} == {160}
    assert got["all"].accuracy == got["only a"].accuracy == got["without b"].accuracy == 100 and got["all"].recall == 100 and got["all"].deviation == 0
    assert got["majority"].accuracy == 50 and got["majority"].recall in (0, 100) and 25 < got["only b"].accuracy < 75
    folds = G.stratified_folds(df, "label", "id", 4).groupBy("label", "fold").count().collect()
    assert len(folds) == 8 and {r["count"] for r in folds} == {20}
    top = {r.feature: r.importance for r in G.importances(df, "label", ["a", "b"]).collect()}
    assert top["a"] > 0.9 and sum(top.values()) == pytest.approx(1)
