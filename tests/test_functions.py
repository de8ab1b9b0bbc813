"""Golden numbers, the corpus of damaged answers, and properties."""

import json
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from figquarry import schemas
from figquarry.functions import parse as P
from figquarry.functions import scalars as S
from figquarry.operators import evaluate as E
from figquarry.operators import fields as G
from figquarry.operators import questions as Q
from figquarry.operators import relate as R
from figquarry.sources import files as IO
from figquarry.streaming import incremental as I


def one(spark, *columns, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(*columns).first()


def test_intervals(spark):
    lo, hi = S.wilson(F.lit(69), F.lit(85))
    a, b = S.wald(F.lit(69), F.lit(85))
    full = S.wilson(F.lit(170), F.lit(170))
    got = one(spark, S.wilson_halfwidth_pp(F.lit(85)), S.wilson_halfwidth_pp(F.lit(170)), S.detectable_difference_pp(F.lit(85)), lo, hi, a, b, *full)
    assert list(got) == pytest.approx([10.3971, 7.4326, 21.4870, 0.715890, 0.880679, 0.728664, 0.894865, 0.977903, 1.0], abs=1e-4)


def test_two_proportions(spark):
    z, p = one(spark, *S.two_proportions(F.lit(69), F.lit(85), F.lit(13), F.lit(85)))
    assert z == pytest.approx(8.595363, abs=1e-6) and p == pytest.approx(8.30e-18, rel=1e-2)


@pytest.mark.parametrize("b,c,chi,p,exact", [(10, 2, 4.083333, 0.0433081, 0.0385743), (3, 12, 4.266667, 0.0388671, 0.0351563), (0, 0, 0.0, 1.0, 1.0)])
def test_mcnemar(spark, b, c, chi, p, exact):
    assert list(one(spark, *S.mcnemar(F.lit(b), F.lit(c)))) == pytest.approx([chi, p, exact], abs=1e-6)


def test_erfc(spark):
    xs = [-2.0, -0.1, 0.0, 0.3, 1.0, 3.0, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.erfc("x").alias("e")).collect()
    assert [r.e for r in got] == pytest.approx([math.erfc(r.x) for r in got], rel=2e-7)


def test_hms(spark):
    got = [r[0] for r in spark.createDataFrame([(281.8333333,), (359.99999999,), (-0.5,), (0.0,)], "d double").select(S.hms("d")).collect()]
    assert got == ["18h47m20.00s", "00h00m00.00s", "23h58m00.00s", "00h00m00.00s"]


def test_numbers(spark):
    texts = ["1,234", "1.2^-5", "3.4**2", "1.2e(-5)", "−7", "abc", "", "inf", "nan", "1_0", "1d", None, ".5", "+3."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.as_float("t")).collect()]
    assert got == [1234.0, 1.2e-5, 340.0, 1.2e-5, -7.0, None, None, None, None, None, None, None, 0.5, 3.0]


def test_angles_and_epochs(spark):
    angles = [("26' x 42'", 2520.0), ("0.85 degrees", 3060.0), ('3"', 3.0), ("0.02", None), ("1.2?? x 1.7??", None)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in angles], "t string").select(S.angle_arcsec("t")).collect()]
    assert got == [b for _, b in angles]
    epochs = ["RA J2000", "(B1950)", "(2000)", "alpha 1950", "no epoch"]
    got = [r[0] for r in spark.createDataFrame([(e,) for e in epochs], "t string").select(S.epoch("t")).collect()]
    assert got == ["J2000", "B1950", "2000", "1950", "none"]


def test_circular(spark):
    df = spark.createDataFrame([("wrap", 359.9), ("wrap", 0.1), ("run", 10.0), ("run", 12.0), ("wide", 0.0), ("wide", 100.0), ("wide", 200.0), ("one", 5.0), ("none", None)], "k string, d double")
    got = {r.k: (r.span, r.start) for r in E.circular_gap(df, "k", "d").collect()}
    assert got["wrap"] == pytest.approx((0.2, 359.9)) and got["run"] == pytest.approx((2.0, 10.0)) and got["wide"] == (None, None) and got["one"] == pytest.approx((0.0, 5.0)) and "none" not in got


def test_boxes(spark):
    rows = [("f", 1, 0.0, 0.0, 4.0, 4.0), ("f", 2, 4.0, 0.0, 8.0, 4.0), ("f", 3, 1.0, 1.0, 2.0, 2.0), ("f", 4, 0.0, 0.0, 4.0, 4.0), ("f", 5, 9.0, 9.0, 10.0, 10.0), ("g", 6, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "fig string, label int, xmin double, ymin double, xmax double, ymax double")
    got = {(r.first, r.second): r.iou for r in R.overlapping(df, "fig", "label").collect()}
    assert set(got) == {(1, 3), (1, 4), (3, 4)} and got[1, 4] == pytest.approx(1, abs=1e-6) and got[1, 3] == pytest.approx(1 / 16, abs=1e-6)


ANSWERS = [
    ('{"plot types": "contour", "explanation": "lines"}', "contour", "lines", None),
    ('{"plot types": ["contour"}', "contour", None, None),
    ('{"plot types": "contour",}', "contour", None, None),
    ("{'plot types': 'contour'}", "contour", None, None),
    ('{"plot types": "a "contour" b"}', 'a "contour" b', None, None),
    ('{"plot types": "con"tour"}', "contour", None, None),
    ("{'plot types': ('a', None)[0:1] and 'x', }", None, None, "not json"),
    ('{"plot types": 7, "Reason": "r", "explanation": null}', "7", None, None),
    (' {"plot types":true , "b":"" } ', "true", None, None),
    ('{"plot types": "a", "plot types": "b"}', "b", None, None),
    ('{"plot types": 1.50}', "1.5", None, None),
    ('{"plot_types": "contour"}', "contour", None, None),
    ('```json\n{"other": "x"}\n```\n```json\n{"Plot-Types": "contour"}\n```', "contour", None, None),
    ('{"explanation": "only"}', None, "only", "no answer"),
    ('{"plot types": null}', None, None, "null"),
    ("", None, None, "empty"),
    (None, None, None, "empty"),
    ("I cannot say.", None, None, "not json"),
    ('{"plot types": {"a": 1}}', '{"a": 1}', None, None),
    ('{"plot types": "cut off', "cut off", None, None),
]


def test_answer_corpus(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, t string").select("i", P.tolerant("t").alias("p"))
    got = [(r.a, r.e, r.f) for r in df.select("i", P.answer_for("p", F.lit("plot types")).alias("a"), F.col("p.explanation").alias("e"), F.col("p.failure").alias("f")).orderBy("i").collect()]
    assert got == [a[1:] for a in ANSWERS]


@given(st.dictionaries(st.text("abc {}[]:,'x", min_size=1, max_size=6), st.one_of(st.text("ab {}[]\"\\,", max_size=8), st.integers(-9, 9), st.none()), min_size=1, max_size=4), st.text("ab .,;", max_size=9))
def test_plain_json_is_found_in_any_prose(value, prose):
    text = prose + json.dumps(value) + prose
    assert [P.read_object(o) for o in P.objects(text)] == [value]


@given(st.text("{}[]\"'ab,:\\ ", max_size=60))
def test_no_text_breaks_the_parser(text):
    assert set(P.parse_answer(text)) == {"answer", "explanation", "failure", "n_objects", "lost"}


def test_flat_objects_read_alike(spark):
    texts = ['{"a": "b"}', '{"a": null}', '{"reason": "x"}', '{"a b": "c", "Rationale": "d", "e": -12}', '{"a": 0}', '{"a": -0}', '{"a": "x", }', '{"a": "\\n"}', '{"": "x"}', '{"a": "é 日"}', "{}", '{"a": {"b": 1}}', '{"a":true}{"a":false}']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.tolerant("t").alias("p"), P._flat_answer(F.col("t")).isNotNull().alias("flat")).orderBy("i").collect()
    assert [r.p.asDict() for r in got] == [P.parse_answer(t) for t in texts]
    assert [r.flat for r in got] == [True] * 5 + [False] * 4 + [True] + [False] * 3


def test_truth_and_decoding(spark):
    texts = ['"x"', '["x"]', '{"a": "x"}', '{"a": {"b": "x"}}', "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.ground_truth("t")).collect()]
    assert got == ["x"] * 5 + [None]
    docs = ['{"a": 1}', json.dumps('{"a": 1}'), "{broken", json.dumps("words"), None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in docs], "t string").select(P.decode_twice("t")).collect()] == ['{"a": 1}', '{"a": 1}', None, None, None]


def test_claims(spark):
    rows = [("0.03", "<0.05", True), ("0.06", "<0.05", False), ("52", "~50", True), ("10.397", "10.4", True), ("10.2", "10.4", False), ("yes", "yes", True), (None, "1", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "computed string, paper string")
    assert [r.ok for r in E.claims(df).collect()] == [r[2] for r in rows]


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f1", 2.5), ('q"\\', None)], "fig_id string, x double").coalesce(1)
    IO.write_documents(df, str(tmp_path / "d"))
    text = spark.read.text(str(tmp_path / "d")).select(P.decode_twice("value").alias("j"))
    assert sorted(json.loads(r.j)["fig_id"] for r in text.collect()) == ["f1", 'q"\\']
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "good.json").write_text(json.dumps('{"fig_id": "f1"}'))
    (tmp_path / "w" / "bad.json").write_text("{")
    good, bad = IO.read_documents(spark, str(tmp_path / "w"), "fig_id string")
    assert [(r.name, r.record.fig_id) for r in good.collect()] == [("good", "f1")] and [r.name for r in bad.collect()] == ["bad"]


def test_shards_answers_and_stream(spark, tmp_path):
    schema = "object string, survey string, pdf string, reason string"
    log = str(tmp_path / "log")
    for k in range(3):
        IO.append_shards(spark.createDataFrame([("o", f"s{k % 2}", "p", "no survey")], schema), log)
    assert IO.read_csv(spark, log, schema).count() == 3
    stream = I.stream_log(spark, log, schema, ["object", "survey", "pdf"]).writeStream.format("memory").queryName("failures").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.sql("SELECT * FROM failures").count() == 2
    df = spark.createDataFrame([("a", "m", "v1"), ("b", "m", "v1")], "run string, model string, vqa_id string")
    IO.write_answers(df, str(tmp_path / "answers"))
    assert IO.read_answers(spark, str(tmp_path / "answers")).where("run = 'a'").count() == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, IO.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_manifest_lines_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "vqa_id string, seed int, preset string")
    IO.write_manifest(df, str(tmp_path / "m"), ["vqa_id"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == ['{"preset":"x","seed":1,"vqa_id":"a"}', '{"seed":2,"vqa_id":"b"}']
    assert sorted(map(tuple, IO.read_manifest(spark, str(tmp_path / "m"), "vqa_id string, seed int, preset string").collect()), key=str) == [("a", 1, "x"), ("b", 2, None)]


def test_a_crashed_version_does_not_count(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    IO.checkpoint(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, ["k"], schema)
    (tmp_path / "t" / "version=000007").mkdir()
    (tmp_path / "t" / "version=000007" / "part-0.csv").write_text("k,v\n9,broken\n")
    again = IO.checkpoint(spark.createDataFrame([(2, "c")], schema), path, ["k"], schema)
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "c")]


def test_names_and_tables(spark):
    rec = IO.file_record(F.lit("/x/image_p.q_OBJ_M 31_SURVEY_DSS2_height0.5.fits"))
    n, block = IO.figure_block(F.lit("Picture_000700"), [("contour", 0, 667), ("gmm", 667, 1334)])
    cells = IO.html_table(F.lit("<table><TR><TH>Regime</TH><TD><b>Radio</b></TD></TR><tr><th>x</th><td>y</td></tr></table>"), ["Regime"])
    got = one(spark, rec["pdf"], rec["object"], rec["survey"], n, block, cells)
    assert list(got) == ["p.q", "M 31", "DSS2", 700, "gmm", {"Regime": "Radio"}]


def test_strings(spark):
    got = one(
        spark, S.panel_words(F.lit(0), F.lit(0)), S.panel_words(F.lit(1), F.lit(2)), S.panel_words(F.lit(0), F.lit(1)), S.panel_words(F.lit(2), F.lit(0)),
        S.header_value(F.lit("BUNIT   = 'K km/s '  / unit"), "BUNIT"), S.expected_key(F.lit('Answer as {"plot types": "<x>"}')), S.expected_key(F.lit("{nothing}")), S.fenced_json(F.lit('say ```json\n{"a": 1}\n```')),
        S.header_number(F.lit("CRVAL1  =  -1.5E+01 / deg"), "CRVAL1"), S.choices(F.lit("please choose [a, 'b']")), S.abridge(F.lit("keep cut this out resume here"), "cut", "resume"),
        S.latex_escape(F.lit("5% of a_b")), S.capitalise(F.lit("two words"), "first"), S.sent_prompt(F.lit(" Is it? "), "Q: "), S.cer(F.lit("kitten"), F.lit("sitting")), S.grouped_number(F.lit(1234567.891), 2), S.unflat_name(S.flat_name(F.lit("M 31/a"))),
    )
    assert list(got)[:4] == ["top-left", "third row and second column", "top row and second from the left", "third row and left-most"]
    assert list(got)[4:9] == ["K km/s", "plot types", None, '{"a": 1}', -15.0]
    assert list(got)[9:14] == [["a", "b"], "keep ...resume here", r"5\% of a\_b", "Two words", "Q: is it?"]
    assert got[14] == pytest.approx(300 / 7) and list(got)[15:] == ["1,234,567.89", "M 31/a"]


def test_error_rate_of_empty_sides(spark):
    assert list(one(spark, *[S.cer(F.lit(h).cast("string"), F.lit(r).cast("string")) for h, r in (("", ""), ("abc", ""), ("", "ab"), (None, "ab"), ("x", "ab"))])) == [0, 3, 2, 2, 100]


def test_tick_units(spark):
    ticks = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cases = [(r"$12^\mathrm{h}30^\mathrm{m}$", "ra", "minutes"), (r"$12^\mathrm{h}$", "ra", "hours"), (r"$5\mathregular{^s}$", "ra", "seconds"), (r"$-3{^\circ}20{}^\prime$", "dec", "arcminutes"), ("3°", "dec", "degrees"), (r"$1^\prime\prime$", "dec", "arcseconds"), ("12h", "ra", None)]
    assert list(one(spark, *[S.finest_tick_unit(ticks(t), axis) for t, axis, _ in cases], S.finest_tick_unit(ticks(), "ra"))) == [u for *_, u in cases] + [None]


def test_escape_repairs(spark):
    backslash = "\\"
    cases = [(r"\alpha \n", r"\\alpha \n"), (r"\u00e9 \u12", r"\u00e9 \\u12"), (r"a\\b \q", r"a\\b \\q"), (backslash, backslash * 2), ("plain", "plain"), (r"\\\d", r"\\\\d")]
    assert list(one(spark, *[S.fix_escapes(F.lit(a)) for a, _ in cases])) == [b for _, b in cases]
    assert all(json.loads(f'"{b}"') is not None for _, b in cases)
    assert list(one(spark, S.fix_raw_strings(F.lit(r'{"a": r"\alpha", "b": r"x"} \o')), S.fix_latex_commands(F.lit(r"\alpha \\beta \1")), S.quote_math(F.lit("is $x^2$ so")))) == [
        r'{"a": "\\alpha", "b": "x"} \o', r"\\alpha \\beta \1", r'is "\$x^2\$" so',
    ]


def slow_grid(nx, ny, w, h):
    """The rule, step by step in plain numbers."""
    nx, ny = max(1, nx), max(1, ny)
    if nx > w or ny > h:
        f = min(w / nx, h / ny)
        nx, ny = (min(m, max(1, round(n * f))) for n, m in ((nx, w), (ny, h)))
    k, rounds = max(1, min(w // nx, h // ny)), 0
    while k % 2 == 0 and rounds < 8:
        a, b = max(1, nx * k // (k + 1)), max(1, ny * k // (k + 1))
        if max(a * (k + 1) - w, b * (k + 1) - h) > 0 or (a, b) == (nx, ny):
            break
        nx, ny, rounds = a, b, rounds + 1
        k = max(1, min(w // a, h // b))
    return nx, ny, k if k % 2 else max(1, k - 1)


def test_pixel_grid(spark):
    rows = [(x, y, w, h) for x in (1, 2, 7, 40, 75, 99, 100, 149, 150, 151, 299, 300, 301, 1200) for y in (1, 3, 50, 149, 150, 300, 900) for w, h in ((300, 300), (300, 200), (64, 300), (5, 4))]
    got = spark.createDataFrame(rows, "x int, y int, w int, h int").select("*", S.pixel_grid("x", "y", "w", "h").alias("g")).collect()
    assert [(r.g.nx, r.g.ny, r.g.k) for r in got] == [slow_grid(*r) for r in rows]
    again = spark.createDataFrame([tuple(r.g) for r in got if (r.w, r.h) == (300, 300)], "x long, y long, k long").select("*", S.pixel_grid("x", "y").alias("g"))
    assert all(tuple(r.g) == (r.x, r.y, r.k) for r in again.collect())


def test_survey_fields(spark):
    pair = lambda *x, **k: [F.round(v, 6) for v in R.survey_range(*map(F.lit, x), **k)]
    null = F.lit(None).cast("double")
    got = one(spark, *pair(500.0, 1000.0), *pair(2.0, 100000.0), *pair(2.0, 1000.0), *pair(500.0, 1000.0, on_conflict="none"), *R.survey_range(F.lit(2.0), null), R.field_size(F.lit(100.0), F.lit(200.0), F.lit(250.0), F.lit(0.5)), R.field_size(F.lit(100.0), null, null, F.lit(0.5)), R.field_size(null, F.lit(10.0), F.lit(1000.0), F.lit(0.5)), R.field_size(null, null, null, F.lit(0.5)), R.survey_resolution(F.lit("1.5 arcmin"), F.lit(9.0)), R.survey_resolution(F.lit("?"), F.lit(2.0)))
    assert list(got) == [750, 750, 100, 18000, 100, 750, None, None, None, None, 250, 300, pytest.approx(100), None, 90, 5]


def test_canvas_and_axes(spark):
    xs = F.array(*map(F.lit, (4.0, 3.0, 1.0)))
    a, b, d, e = *S.contour_limits(xs, F.lit(False)), *S.contour_limits(xs, F.lit(True))
    got = one(spark, a, b, d, e, S.remapped(F.lit(5.0), F.lit(0.0), F.lit(10.0), F.lit(100.0), F.lit(300.0)), S.safe_dpi(F.lit(20.0), F.lit(20.0), F.lit(1000.0)), S.safe_dpi(F.lit(4.0), F.lit(3.0), F.lit(300)), S.tick_capacity(F.lit(200.0), F.lit(10.0), F.lit(72.0)), S.tick_capacity(F.lit(200.0), F.lit(10.0), F.lit(72.0), vertical=False), S.tick_capacity(F.lit(0.0), F.lit(10.0), F.lit(72.0)), *S.decimated_header(F.lit(150.5), F.lit(-0.01), F.lit(300), F.lit(60), F.lit(5)))
    assert list(got) == [0.5, 4.5, 1.0, 4.0, 200.0, 500.0, 300.0, 11, 5, 2, pytest.approx((150.5 - 2 - 1 + 5) / 5), pytest.approx(-0.05)]
    rows, cols = S.panel_grid("d", "l", "f", 1, 10, 6)
    grid = spark.createDataFrame([(7.2, "vertical", False), (7.2, "vertical", True), (3.4, "horizontal", True), (3.4, "vertical", True), (99.0, "squarish", False), (-4.0, "squarish", False)], "d double, l string, f boolean").select(rows, cols).collect()
    assert [tuple(r) for r in grid] == [(2, 4), (4, 2), (1, 3), (3, 1), (3, 3), (1, 1)]


def test_geometry(spark):
    sq = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 3), (0, 0), (4, 0), (0, 3))])
    got = one(spark, S.ordered_corners(sq), S.bounding_box(sq), F.size(S.edge_points(sq, 1.0)), S.interval_overlap(F.lit(0.0), F.lit(4.0), F.lit(1.0), F.lit(9.0)), S.ssmape(F.lit(1.0), F.lit(0.0)), S.ssmape(F.lit(0.0), F.lit(0.0)))
    assert [(p.x, p.y) for p in got[0]] == [(0, 0), (4, 0), (4, 3), (0, 3)] and tuple(got[1]) == (0, 0, 4, 3) and got[2] == 5 + 4 + 5 + 4 and got[3] == 0.75 and got[4] == 2 and got[5] is None
    ra, dec = S.tan_sky(F.lit(0.0), F.lit(1.0), F.lit(10.0), F.lit(89.5))
    assert list(one(spark, ra, dec)) == pytest.approx([190.0, 89.5], abs=1e-3)


def test_ssmape_bounds_and_bands(spark):
    df = spark.range(200).select((F.col("id") - 100).cast("double").alias("a"), (F.col("id") * 7 % 31).cast("double").alias("b"))
    r = df.select(F.min(S.ssmape("a", "b")), F.max(S.ssmape("a", "b"))).first()
    assert -2 <= r[0] and r[1] <= 2
    bands = E.band_counts(spark.createDataFrame([(float("nan"),), (0.0,), (1.0,), (-5.0,), (None,)], "x double"), "x", [0.0, 1.0]).collect()
    assert {r.band: r.n for r in bands} == {0: 1, 1: 1, 2: 1, None: 2}


def test_hashed_draws_ignore_partitions(spark):
    draw = lambda n: sorted(map(tuple, spark.range(500).repartition(n).select("id", S.hash_u01(3, "id"), S.gaussian(4, "id")).collect()))
    a = draw(1)
    assert a == draw(7) and 0.4 < sum(r[1] for r in a) / 500 < 0.6 and abs(sum(r[2] for r in a) / 500) < 0.2
    assert G.mixture_field(spark, 3, 100, 8, 8, 1).agg(F.sum("n")).first()[0] == 300


def test_question_tree(spark):
    tree = {"Level 1": {"Figure": {"rows": {"Q": "how many?"}, "type": {"plot0": {"Q": "a"}, "plot1": {"Q": "b"}}}}}
    got = G.flatten_tree(spark.createDataFrame([("f", json.dumps(tree))], "fig string, tree string"), "tree").collect()
    assert sorted((r.name, r.plot or "", json.loads(r.entry)["Q"]) for r in got) == [("rows", "", "how many?"), ("type", "plot0", "a"), ("type", "plot1", "b")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, a double, b double")
    assert E.log_ratio_summary(empty, ["k"], "a", "b").count() == 0 and E.top_counts(empty, "k").count() == 0 and E.density(empty, "a", 0.0, 1.0, 4).count() == 4


def test_boosted_trees_see_the_whole_embedding(spark, tmp_path):
    import random

    from figquarry.plans import QUERIES

    rng = random.Random(3)
    rows = [(k, k % 2, [rng.random() for _ in range(63)] + [k % 2 + rng.random() / 2]) for k in range(80)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.label, r.predicted): r.n for r in QUERIES["gbt_oof"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 40, (1, 1): 40}  # only the last dimension tells


def test_cer_of_whole_texts(spark, tmp_path):
    from figquarry.plans import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    texts = {1: ("same start " * 8 + "one end", "same start " * 8 + "another"), 2: ("größer als 3 µm", "grosser als 3 um"), 3: ("天の川 😀", "天の河"), 4: ("x", ""), 5: (None, "y"), 6: ("", "reference"), 7: ("kitten", "sitting")}
    rows = [(k, turn, "user", text) for k, pair in texts.items() for turn, text in enumerate((*pair, "a later turn"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.cer for r in QUERIES["cer"](spark, str(tmp_path)).collect()}
    assert got == {k: round(100 * distance(a, b) / len(b), 6) if a and b else max(len(a or ""), len(b)) for k, (a, b) in texts.items()}


def test_assign_pool_keeps_every_item(spark):
    n, items = 100_050, 200_200
    got = R.assign_pool(spark.range(items).withColumnRenamed("id", "item"), spark.range(n).withColumnRenamed("id", "value"), "item", "value").collect()
    order = lambda m: sorted(range(m), key=lambda i: ((i * 7919 + 104729) % 1_000_003, i))
    pool = order(n)
    assert {r.item: r.value for r in got} == {i: pool[k % n] for k, i in enumerate(order(items))} and len(got) == items


def test_usage_cost_keeps_every_priced_key(spark):
    n = 10_050
    calls = spark.range(2 * n).select((F.col("id") % n).alias("model"), F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    prices = spark.range(n).select(F.col("id").alias("model"), F.lit(1e6).alias("in_price"), F.lit(2e6).alias("out_price"))
    got = E.usage_cost(calls, ["model"], prices).collect()
    assert sorted(r.model for r in got) == list(range(n)) and {r.cost for r in got} == {24.0}


@pytest.mark.parametrize("sketch", [10, 10_000])
def test_quantiles_are_exact(spark, sketch):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=701), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "skewed": np.exp(5 * rng.normal(size=900)), None: rng.normal(size=33)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"least": 0.0, "q1": 0.25, "half": 0.5, "q9": 0.9, "most": 1.0}
    got = {r.k: list(r)[1:] for r in E.quantiles(df, ["k"], "v", at, sketch).collect()}
    assert got == {k: pytest.approx(np.quantile(v, list(at.values())).tolist()) for k, v in values.items()}
    assert list(E.quantiles(df, [], "v", at, sketch).first()) == pytest.approx(np.quantile(np.concatenate(list(values.values())), list(at.values())).tolist())
    described = {r.k: (r.n, r.q50) for r in E.describe(df, ["k"], "v").collect()}
    assert described["none"] == (0, None) and described["one"] == (1, 3.0) and described[None][0] == 33


def test_rows_are_numbered_in_order(spark):
    rows = [(i, float(x) if x is not None else None) for i, x in enumerate([5, 1, 1, None, 9.5, 1, 0, None, 700, -3])]
    df = spark.createDataFrame(rows, "i int, x double")
    got = E.round_robin(df, "x", 4).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.i: r.worker for r in got} == {i: n % 4 for n, (i, _) in enumerate(order)}
    same = spark.createDataFrame([(i, 2.0) for i in range(9)], "i int, x double")
    assert sorted(r.worker for r in E.round_robin(same, "x", 3).collect()) == [0] * 3 + [1] * 3 + [2] * 3 and E.round_robin(df.limit(0), "x", 3).count() == 0


def test_nearest_of_blocks(spark):
    rng = np.random.default_rng(2)
    points = [(k, int(rng.integers(0, 3)), float(rng.uniform(0, 360)), float(rng.uniform(-80, 80))) for k in range(60)]
    points += points[:5] + [(99, 7, 1.0, 1.0)]
    targets = [(k, int(rng.integers(0, 3)), float(rng.uniform(0, 360)), float(rng.uniform(-80, 80))) for k in range(300)]
    p, q = spark.createDataFrame(points, "id int, k int, ra double, dec double"), spark.createDataFrame(targets, "target int, k int, ra double, dec double")
    block, R.TARGET_BLOCK = R.TARGET_BLOCK, 16
    try:
        got = sorted((r.id, r.target) for r in R.nearest(p, q, "k").collect())
    finally:
        R.TARGET_BLOCK = block

    def apart(a, b):
        x, y, d = math.radians(a[3]), math.radians(b[3]), math.radians(a[2] - b[2])
        return math.acos(max(-1, min(1, math.sin(x) * math.sin(y) + math.cos(x) * math.cos(y) * math.cos(d))))

    assert got == sorted((a[0], min((apart(a, b), b[0]) for b in targets if b[1] == a[1])[1]) for a in points if a[1] < 3)


def test_no_pool_value_or_price_is_lost(spark):
    n = 100_200
    pool, items = spark.range(n).withColumnRenamed("id", "value"), spark.range(2 * n).withColumnRenamed("id", "item")
    dealt = R.assign_pool(items, pool, "item", "value").groupBy("value").count()
    assert dealt.count() == n and {r["count"] for r in dealt.select("count").distinct().collect()} == {2}
    calls = spark.range(10_050).selectExpr("concat('m', id) AS model", "10L AS input_tokens", "1L AS output_tokens")
    prices = spark.range(10_050).selectExpr("concat('m', id) AS model", "1.0 AS in_price", "2.0 AS out_price")
    assert E.usage_cost(calls, ["model"], prices).count() == 10_050


def test_required_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r.k, r.v) for r in R.required(left, right, "k", optional=[2]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="no row for 2"):
        R.required(left, right, "k").collect()


def test_importances(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(y), int(x > 0)) for x, y in rng.normal(size=(200, 2))], "a double, b double, label int")
    found = {r.feature: r.importance for r in G.importances(df, "label", ["a", "b"], trees=2).collect()}
    assert found["a"] > 0.9 and sum(found.values()) == pytest.approx(1)


def panel_of(k, kind, **more):
    base = {"plot_num": k, "type": kind, "distribution": "gmm", "xs": [1.0, 2.0], "ys": [1.0, 3.0], "colors": [[1.0, 2.0], [3.0, 10.0]], "drawn_keys": ["image"], "x_pixel_limits": None, "y_pixel_limits": None, "wcs_header": None, "fits_header": None, "bunit": None, "xlabel": "x", "ylabel": None, "title": f"t{k}", "xticks": ["1"], "yticks": None}
    return base | more


def figure_of(name, *panels):
    head = {"dpi": 100.0, "base": 4.0, "aspect ratio": 1.0, "nrows": 1, "ncols": len(panels), "plot style": "ggplot", "color map": None, "plot indexes": [[0, i] for i in range(len(panels))], "pixel width": 1, "pixel height": 1}
    return name, head, list(panels)


def test_questions_of_several_panels(spark):
    header = "CRVAL1 = 0.0 CRVAL2 = 0.0 CRPIX1 = 1.5 CRPIX2 = 1.5 CDELT1 = -0.5 CDELT2 = 0.5"
    figures = [
        figure_of("two", panel_of(0, "contour"), panel_of(1, "image of the sky", wcs_header=header, distribution="sky", xlabel="RA (B1950)", xticks=[r"$1^\\mathrm{h}$"], yticks=[r"$1^\\circ$"])),
        figure_of("bare", panel_of(0, "image of the sky")), figure_of("short", panel_of(0, "contour", xs=[1.0])), figure_of("other", panel_of(0, "table")), figure_of("none"),
    ]
    df = spark.createDataFrame(figures, schemas.FIGURES)
    rows = Q.questions(df, count_panels=True, samples=9).collect()
    by = lambda f: {(r.plot, r.name): r for r in rows if r.fig_id == f}
    two = by("two")
    assert len(two) == 11 + 11 + 15 and two[None, "rows/columns"].a == '{"nrows":1,"ncols":2}' and two[None, "titles"].a == '["t0","t1"]' and two[None, "ylabels"].a == '["",""]' and two[None, "ytick values"].a == r'[[],["$1^\\\\circ$"]]'.replace("\\\\", "\\\\")
    style = two["plot0", "image or lines (words) (list)"]
    assert style.a == "image" and style.context == "The following question refers to the plot in the top-left panel." and "for this figure panel," in style.format
    assert two["plot1", "mean color (words)"].q == "You are a helpful assistant that can analyze images. The following question refers to the plot in the top row and second from the left panel. What is the mean value of the data along the color-axis in this figure panel?  " + 'Please format the output as a json as {"mean color":""} for this figure panel, where the "mean color" value should be a float, calculated from the data values used to create the plot.'
    assert two["plot1", "distribution-image (words + list)"].a == "real image of the sky" and two["plot1", "distribution-image (words + list)"].tag == "distribution (words + list)"
    # the field lies across 0h: a quarter of a degree on either side
    assert two["plot1", "minimum right ascension axis limit (words)"].a == "23h59m00.00s" and two["plot1", "maximum right ascension axis limit (words)"].a == "00h01m00.00s"
    assert float(two["plot1", "field height (words)"].a) == pytest.approx(30, rel=1e-4) and float(two["plot1", "field width (words)"].a) == pytest.approx(30, rel=1e-4) and float(two["plot1", "pixel scale (words)"].a) == pytest.approx(1800, rel=1e-4)
    assert two["plot1", "epoch (words)"].a == "B1950" and two["plot0", "median color (words)"].a == "2.5"
    assert {n for _, n in by("bare")} >= {"epoch", "mean color"} and not any("limit" in n or "field" in n or "unit" in n for _, n in by("bare"))
    assert len(by("short")) == 11 + 7 and len(by("other")) == 11 and len(by("none")) == 11 and Q.questions(df.limit(0)).count() == 0
    assert {r.q for r in rows} == {f"{r.persona} {r.context} {r.question} {r.format}" for r in rows} and not any("{" in r.question for r in rows)


def test_quads_that_are_none(spark):
    quad = lambda points: F.from_json(F.lit(json.dumps([{"x": x, "y": y} for x, y in points])), "array<struct<x: double, y: double>>")
    cases = [[(0, 0), (4, 0), (4, 3), (0, 3)], [(0, 0), (4, 0), (4, 0), (0, 3)], [(0, 0), (4, 0), (4, 3)], []]
    got = one(spark, *[S.near_rectangle(quad(p)) for p in cases], *[F.size(S.edge_points(quad(p), 1.0)) for p in cases])
    assert list(got) == [True, False, False, False, 4 + 4 + 4 + 4, 4 + 4 + 5 + 4, 4 + 4 + 5, 0]
    assert one(spark, S.near_rectangle(F.lit(None).cast("array<struct<x: double, y: double>>")))[0] is False
