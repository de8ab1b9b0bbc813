"""

A figure (schemas.FIGURES) becomes an array of questions for each panel and one explode; nothing is shuffled. A question whose answer
can't be worked out isn't asked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contour_limits, epoch, field_extent, finest_tick_unit, header_number, hms, panel_words, pixel_scale

# The wording of prompts. {axis}, {which}, {phrase} and the like are filled in; of a pair, the first is for figures of one panel.
PERSONA = "You are a helpful assistant that can analyze images."
AS_JSON = "Please format the output as a json as "
PANEL_CONTEXT = "The following question refers to the plot in the {words} panel."
PHRASE = ("this figure", "this figure panel")
ROW_MAJOR = "If there is a single plot, this should be one element in this list, and if there are multiple plots the list should be in row-major (C-style) order."
LATEX = r"in a Python LaTeX string (for example 'Light $\\alpha$')."
FIGURE_QUESTIONS = {
    "rows/columns": ("", "How many panels are in this figure?", AS_JSON + '{"nrows":"", "ncols":""} to store the number of rows and columns.'),
    "plot style": (
        'Assume this is a figure made with matplotlib in Python.  Examples of plotting styles are "classic" or "ggplot".', "What is the plot style used in this figure?",
        AS_JSON + '{"plot style":""} to store the matplotlib plotting style used in the figure.',
    ),
    "colormap": (
        'Assume this is a figure made with matplotlib in Python. Examples of matplotlib colormaps are "rainbow" or "Reds".', "What is the colormap that was used in this figure?",
        AS_JSON + '{"colormap":""} to store the matplotlib colormap used in the figure.',
    ),
    "aspect ratio": ("", "What is the aspect ratio of this figure?", AS_JSON + '{"aspect ratio":""} to store the aspect ratio of the plot.'),
}
TITLES = (
    ("What is the title of the plot in this figure?", AS_JSON + '{"titles":[]}, where the list holds the title of the plot as its only element.  If the plot does not have a title, then denote this by an empty string in the list.  Please format any formulas in the title ' + LATEX + " "),
    ("What are the titles for each figure panel?", AS_JSON + '{"titles":[]}, where the list is a list of strings of all of the titles. ' + ROW_MAJOR + " If a plot does not have a title, then denote this by an empty string in the list.  Please format any formulas in the title " + LATEX + " "),
)
LABELS = (
    ("What is the {axis}-axis title of the plot in this figure?", AS_JSON + '{"{axis}labels":[]}, where the list holds the {axis}-axis title of the plot as its only element. If the plot does not have an {axis}-axis title, then denote this by an empty string in the list.  Please format any formulas in the title ' + LATEX + " "),
    ("What are the {axis}-axis titles for each figure panel?", AS_JSON + '{"{axis}labels":[]}, where the list is a list of strings of all of the {axis}-axis titles. ' + ROW_MAJOR + " If a plot does not have an {axis}-axis title, then denote this by an empty string in the list.  Please format any formulas in the title " + LATEX + " "),
)
TICKS = (
    ("What are the values for each of the tick marks on the {axis}-axis?", AS_JSON + '{"{axis}tick values":[[]]}, where the outer list holds one element for the plot, and the inner list is a list of the {axis}-axis tick mark values. If the plot does not have any {axis}-axis tick values, then denote this by an empty string in the inner list.  Please format any formulas in the {axis}-axis tick values ' + LATEX),
    ("What are the values for each of the tick marks on the {axis}-axis?", AS_JSON + '{"{axis}tick values":[[]]}, where each element of the outer list refers to a single panel, and each inner list is a list of the {axis}-axis tick mark values. If there is a single plot, this should be one element in the outer list, and if there are multiple plots the outer list should be in row-major (C-style) order. If a plot does not have any {axis}-axis tick values, then denote this by an empty string in the inner list.  Please format any formulas in the {axis}-axis tick values ' + LATEX),
)
TYPES = (
    ("Please choose the plot type from the following list: [{choices}].", "What is the plot type of the plot in this figure?", AS_JSON + '{"plot types":[]}, where the list holds the plot type of the plot as its only element. '),
    ("Please choose each plot type from the following list: [{choices}].", "What are the plot types for each panel in the figure?", AS_JSON + '{"plot types":[]}, where each element of the list refers to the plot type of a single panel. ' + ROW_MAJOR + " "),
)
STYLE = ("What is the style of the {object}? Please choose the style from the following list: [image, contour lines, both].", AS_JSON + '{"image or lines":""} for {phrase}, where the "image or lines" value should be a string.')
STATISTIC = ("What is the {which} value of the data along the color-axis in {phrase}? ", AS_JSON + '{"{which} color":""} for {phrase}, where the "{which} color" value should be a float, calculated from the data values used to create the plot.')
DISTRIBUTION = ("What is the underlying distribution used to create the data in {phrase}{where}?", AS_JSON + '{"distribution{axis}":""} for {phrase}, where the "distribution{axis}" value should be a string.')
CHOOSE_DISTRIBUTION = " Please choose the distribution from the following list: [{choices}]."
LIMIT = "What is the {which} {axis} value covered by the {axis} axis of this figure -- that is, the {end} limit of the axis range, not of the data?"
LIMIT_FORMAT = AS_JSON + '{"{which} {axis} axis limit":""} for {phrase}, where the "{which} {axis} axis limit" value should be {kind}, read from the {axis} axis'
HMS_UNITS, DEGREE_UNITS = "hours, minutes and seconds (for example 18h47m20.50s)", "degrees"
EPOCH = ('What coordinate epoch is given on the axis labels of {phrase}? Answer "none" if no epoch is stated.', AS_JSON + '{"epoch":""} for {phrase}, where the "epoch" value should be a string such as "J2000", "B1950" or "none".')
CHOOSE_UNIT = " Please choose your answer from the following list: [{choices}]."
UNIT = ("What is the smallest unit of angle shown on the {axis} tick labels of {phrase}?", AS_JSON + '{"finest unit {axis}":""} for {phrase}, where the value should be a string.')
EXTENT = ("What is the angular {which} of the sky region shown in {phrase}, measured along {along}? Give the value in arcminutes.", AS_JSON + '{"field {which}":""} for {phrase}, where the value should be a float, expressed in arcminutes.')
ALONG = {"height": "the declination axis", "width": "the right ascension axis, as a true angle on the sky (i.e. including the cos(declination) factor)"}
SCALE = ("Approximately what angular size does a single pixel of this sky image span? Give the value in arcseconds.", AS_JSON + '{"pixel scale":""} for {phrase}, where the value should be a float, expressed in arcseconds per pixel.')
DISTRIBUTIONS = {"contour": {"gmm": "gaussian mixture model"}, "sky": {"gmm": "gaussian mixture model", "sky": "real image of the sky"}}
CHOICES = {"contour": "random, linear, gaussian mixture model", "sky": "gaussian mixture model, real image of the sky"}
UNITS = {"right ascension": "hours, minutes, seconds", "declination": "degrees, arcminutes, arcseconds"}
PLOT_TYPES = ("contour", "image of the sky")
FIGURE, PLOT = "Figure-level questions", "Plot-level questions"
SAMPLES = 192


def _fill(text: str, **values: str) -> str:
    for key, value in values.items():
        text = text.replace("{" + key + "}", value)
    return text


class _Asking:
    """The questions of one figure with one panel (many=False) or more: texts differ, and names say so.

    What is the same for all figures goes to `texts`; a row only holds its number there, so that prompts are put together
    after the explode, and only if they are asked for.
    """

    def __init__(self, many: bool, texts: list[tuple[str, ...]]) -> None:
        self.many, self.phrase, self.adder, self.texts = many, PHRASE[many], " (words)" if many else "", texts

    def row(self, level: int, kind: str, name: str, tag: str, answer: Column, more: str, question: str, form: str, plot: Column | None = None, context: Column | None = None) -> Column:
        """more: what is said beside the context, which tells the panel."""
        self.texts.append((f"Level {level}", kind, name, tag, more, _fill(question, phrase=self.phrase), _fill(form, phrase=self.phrase)))
        own = F.lit(None).cast("string") if plot is None else plot
        return F.struct(F.lit(len(self.texts) - 1).alias("n"), own.alias("plot"), (F.lit("") if context is None else context).alias("c"), answer.cast("string").alias("a"))

    def figure(self, f: Column, plots: Column, count_panels: bool, plot_types: tuple[str, ...]) -> list[Column]:
        listed = lambda field, missing=F.lit(""): F.to_json(F.transform(plots, lambda p: F.coalesce(p[field], missing)))
        answers = {"rows/columns": F.to_json(F.struct("figure.nrows", "figure.ncols")), "plot style": f["plot style"], "colormap": f["color map"], "aspect ratio": f["aspect ratio"]}
        out = [self.row(1, FIGURE, name, name, answers[name], *texts) for name, texts in FIGURE_QUESTIONS.items() if count_panels or name != "rows/columns"]
        out.append(self.row(1, FIGURE, "titles", "titles", listed("title"), "", *TITLES[self.many]))
        for axis in "xy":
            out.append(self.row(1, FIGURE, f"{axis}labels", f"{axis}labels", listed(f"{axis}label"), "", *(_fill(x, axis=axis) for x in LABELS[self.many])))
        for axis in "xy":
            ticks = listed(f"{axis}ticks", F.array().cast("array<string>"))
            out.append(self.row(1, FIGURE, f"{axis}tick values", f"{axis}tick values", ticks, "", *(_fill(x, axis=axis) for x in TICKS[self.many])))
        context, question, form = TYPES[self.many]
        out.append(self.row(1, FIGURE, "plot types (list)", "plot types", listed("type"), _fill(context, choices=", ".join(plot_types)), question, form))
        out.append(self.row(1, FIGURE, "plot types", "plot types", listed("type"), "", question, form))
        return out

    def panel(self, f: Column, p: Column, sky: bool, colors: Column, s: Column) -> list[Column]:
        """colors: the panel's color values in order; s: its sky_ranges."""
        plot = F.concat(F.lit("plot"), p["plot_num"].cast("string"))
        where = F.get(f["plot indexes"], p["plot_num"])
        head, tail = PANEL_CONTEXT.split("{words}")
        context = F.concat(F.lit(head), panel_words(F.get(where, F.lit(0)), F.get(where, F.lit(1))), F.lit(tail)) if self.many else F.lit("")
        names = "sky" if sky else "contour"

        def ask(level: int, name: str, answer: Column, texts: tuple[str, str], more: str = "", key: str | None = None, tag: str | None = None) -> Column:
            return self.row(level, PLOT, key or name + self.adder, (tag or name) + self.adder, answer, more, *texts, plot=plot, context=context)

        n = F.size(colors)
        at = lambda i: F.get(colors, i.cast("int"))
        statistics = {
            "minimum": at(F.lit(0)), "maximum": at(n - 1), "median": (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2,
            "mean": F.aggregate(colors, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0)),
        }
        color = [ask(2, f"{which} color", value, tuple(_fill(x, which=which) for x in STATISTIC)) for which, value in statistics.items()]
        kind = F.coalesce(*[F.when(p["distribution"] == k, v) for k, v in DISTRIBUTIONS[names].items()], p["distribution"])
        listed = (self.adder.split(")")[0]) + " + list)"

        def distribution(suffix: str, axis: str, along: str) -> Column:
            texts = tuple(_fill(x, where=along, axis=axis) for x in DISTRIBUTION)
            return self.row(3, PLOT, f"distribution-{suffix}{listed}", f"distribution{listed}", kind, _fill(CHOOSE_DISTRIBUTION, choices=CHOICES[names]), *texts, plot=plot, context=context)

        def limits(axis: str, low: Column, high: Column, value: str, units: str) -> list[Column]:
            out = []
            for which, end, x in (("minimum", "lower", low), ("maximum", "upper", high)):
                question = _fill(LIMIT, which=which, axis=axis, end=end) + (f" Give the value in {units}." if units else "")
                form = _fill(LIMIT_FORMAT, which=which, axis=axis, kind=value) + (f", expressed in {units}." if units else ".")
                out.append(ask(1, f"{which} {axis} axis limit", x, (question, form)))
            return out

        if not sky:
            keys = F.array_join(p["drawn_keys"], "")
            image, lines = F.contains(keys, F.lit("image")), F.contains(keys, F.lit("contour"))
            style = F.when(image & lines, "both").when(image, "image").when(lines, "contour lines")
            tag = f"image or lines{self.adder} (list)"
            first = self.row(1, PLOT, tag, tag, style, "", *(_fill(x, object="contour plot") for x in STYLE), plot=plot, context=context)
            only = lines & ~image
            enough = (F.size(p["xs"]) > 1) & (F.size(p["ys"]) > 1)
            ends = {axis: [F.when(enough, x) for x in contour_limits(p[f"{axis}s"], only)] for axis in "xy"}
            bounds = [x for axis in "xy" for x in limits(axis, *ends[axis], "a float", "")]
            return [first, *bounds, *color, distribution("color", " color", " along the color-axis"), distribution("x/y", " x/y", " in the x/y-plane")]
        width, height = field_extent(s["ra_high"] - s["ra_low"], s["dec_low"], s["dec_high"])
        known = s["ra_low"].isNotNull()
        rows = F.abs(shown(p)["y1"] - shown(p)["y0"])
        out = [*color, distribution("image", "", "")]
        out += limits("right ascension", hms(s["ra_low"]), hms(s["ra_high"]), "a string", HMS_UNITS) + limits("declination", s["dec_low"], s["dec_high"], "a float", DEGREE_UNITS)
        out.append(ask(1, "epoch", epoch(F.concat_ws(" ", F.coalesce(p["xlabel"], F.lit("")), F.coalesce(p["ylabel"], F.lit("")))), EPOCH))
        for axis, ticks, which in (("right ascension", p["xticks"], "ra"), ("declination", p["yticks"], "dec")):
            out.append(ask(1, f"finest unit {axis}", finest_tick_unit(ticks, which), tuple(_fill(x, axis=axis) for x in UNIT), _fill(CHOOSE_UNIT, choices=UNITS[axis])))
        for which, value in (("height", height), ("width", width)):
            out.append(ask(2, f"field {which}", F.when(known, value), tuple(_fill(x, which=which, along=ALONG[which]) for x in EXTENT)))
        out.append(ask(3, "pixel scale", F.when(known, pixel_scale(height * 60, rows)), SCALE))
        return out


def shown(p: Column) -> Column:
    """The pixel range of a sky panel that is drawn: its recorded limits, else the whole array."""
    ny, nx = F.size(p["colors"]), F.size(F.get(p["colors"], F.lit(0)))
    end = lambda limits, i, whole: F.coalesce(F.when(p["x_pixel_limits"].isNotNull() & p["y_pixel_limits"].isNotNull(), F.get(p[limits], F.lit(i))), whole.cast("double"))
    return F.struct(end("x_pixel_limits", 0, F.lit(0)).alias("x0"), end("x_pixel_limits", 1, nx - 1).alias("x1"), end("y_pixel_limits", 0, F.lit(0)).alias("y0"), end("y_pixel_limits", 1, ny - 1).alias("y1"))


def sky_ranges(p: Column, samples: int = SAMPLES) -> Column:
    """struct<ra_low, ra_high, dec_low, dec_high> of a panel's displayed box, as a grid of `samples` points a side has them.
    The header's projection is the tangent plane. Right ascension runs on past 360 across 0h; it is NULL where it covers
    more than half the circle, and all is NULL without a header.

    Of the grid only some twenty points are worked through. Within a box neither coordinate has an extreme but at a pole, so
    extremes lie on the border. Its sides are great circles: right ascension runs one way along each, so corners hold its
    extremes; declination turns at one place, whose neighbours in the grid are taken. If the pole lies in the box, the four
    grid points around it hold the extreme declination, and the corners stand all round it in right ascension.
    """
    h, box = p["wcs_header"], shown(p)
    number = lambda key, default: F.coalesce(header_number(h, key), default if isinstance(default, Column) else F.lit(default))
    cd = [F.radians(number(f"CD{i}_{j}", number(f"CDELT{i}", 1.0) if i == j else 0.0)) for i in (1, 2) for j in (1, 2)]
    run = F.pandas_udf(lambda *columns: _ranges(samples, *columns), "ra_low double, ra_high double, dec_low double, dec_high double")
    found = run(*[header_number(h, key) for key in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")], *cd, *[box[x] for x in ("x0", "x1", "y0", "y1")])
    return F.when(header_number(h, "CRVAL1").isNotNull() & header_number(h, "CRVAL2").isNotNull(), found)


def _ranges(samples: int, *columns: pd.Series) -> pd.DataFrame:
    """sky_ranges of a batch: reference point, reference pixel, matrix in radians, box. What isn't known is NaN."""
    ra0, dec0, p1, p2, c11, c12, c21, c22, x0, x1, y0, y1 = (x.to_numpy(float, na_value=np.nan) for x in columns)
    last = float(samples - 1)
    sin, cos = np.sin(np.radians(dec0)), np.cos(np.radians(dec0))
    nonzero = lambda x: np.where(x == 0, np.nan, x)
    with np.errstate(all="ignore"):
        sx, sy = (x1 - x0) / max(last, 1.0), (y1 - y0) / max(last, 1.0)
        # the pole stands cos/sin above the reference point in the plane: so far from the reference pixel
        up, det = cos / nonzero(sin), nonzero(c11 * c22 - c12 * c21)
        px, py = (p1 - 1 - c12 * up / det - x0) / nonzero(sx), (p2 - 1 + c11 * up / det - y0) / nonzero(sy)
        plane = lambda dx, dy: (c11 * dx + c12 * dy, c21 * dx + c22 * dy)

        def turn(x: np.ndarray, y: np.ndarray, dx: np.ndarray | float, dy: np.ndarray | float) -> np.ndarray:
            """Where declination turns on the side that begins at pixel (x, y) and goes by (dx, dy), in steps of the grid: its
            sine is linear over the root of a quadratic, so its derivative has one zero."""
            (xi, eta), (xi1, eta1) = plane(x + 1 - p1, y + 1 - p2), plane(dx, dy)
            n0, n1, across = sin + eta * cos, eta1 * cos, xi * xi1 + eta * eta1
            return (n1 * (1 + xi * xi + eta * eta) - n0 * across) / nonzero(n0 * (xi1 * xi1 + eta1 * eta1) - n1 * across)

        # places in the grid: corners, both neighbours of each turn, and those of a pole within (else a corner again)
        near = lambda i: [np.clip(np.nan_to_num(end(i), posinf=last, neginf=0.0), 0.0, last) for end in (np.floor, np.ceil)]
        places = [(i, j) for i in (0.0, last) for j in (0.0, last)]
        for k in (0.0, last):
            places += [(i, k) for i in near(turn(x0, y0 + k * sy, sx, 0.0))] + [(k, j) for j in near(turn(x0 + k * sx, y0, 0.0, sy))]
        inside = (px >= 0) & (px <= last) & (py >= 0) & (py <= last)
        places += [(np.where(inside, i, 0.0), np.where(inside, j, 0.0)) for i in near(px) for j in near(py)]

        ra, dec = np.empty((len(ra0), len(places))), np.empty((len(ra0), len(places)))
        for k, (i, j) in enumerate(places):
            xi, eta = plane(x0 + i * sx + 1 - p1, y0 + j * sy + 1 - p2)
            d = cos - eta * sin
            turned = np.fmod(ra0 + np.degrees(np.arctan2(xi, d)), 360.0)
            ra[:, k] = np.where(turned < 0, np.fmod(turned + 360.0, 360.0), turned)
            dec[:, k] = np.degrees(np.arctan2(sin + eta * cos, np.sqrt(xi * xi + d * d)))
        # the range begins behind the widest gap
        ra.sort(axis=1)
        gaps = np.column_stack([ra[:, 1:], ra[:, :1] + 360]) - ra
        widest = gaps.argmax(axis=1)
        rows = np.arange(len(ra))
        arc, start = 360 - gaps[rows, widest], ra[rows, (widest + 1) % len(places)]
        half = arc <= 180
        return pd.DataFrame({"ra_low": np.where(half, start, np.nan), "ra_high": np.where(half, start + arc, np.nan), "dec_low": dec.min(axis=1), "dec_high": dec.max(axis=1)})


def questions(figures: DataFrame, count_panels: bool = False, plot_types: tuple[str, ...] = PLOT_TYPES, samples: int = SAMPLES) -> DataFrame:
    """The questions of figures (schemas.FIGURES): fig_id, level, kind, name, plot, q, tag, a, persona, context, question, format.

    Figures get the figure-level questions; contour panels get style, axis limits, color statistics and distributions;
    panels of the sky get color statistics, provenance, axis limits, epoch, tick units, extent and pixel scale: 21 for a
    figure with one contour panel, 25 for one of the sky. Panels of other types get none. count_panels asks for rows and
    columns as well. Lists are answered as JSON.
    """
    # a row for each panel; what several of its questions rest on is computed once, and the figure's own questions go with the first
    panels = figures.select("fig_id", "figure", "plots", F.posexplode_outer("plots").alias("_i", "_p"))
    sky = F.col("_p")["type"] == "image of the sky"
    panels = panels.select("*", F.sort_array(F.array_compact(F.flatten(F.col("_p")["colors"]))).alias("_colors"), F.when(sky, sky_ranges(F.col("_p"), samples)).alias("_s"))
    f, p, plots = F.col("figure"), F.col("_p"), F.col("plots")

    texts: list[tuple[str, ...]] = []

    def all_of(many: bool) -> Column:
        asking = _Asking(many, texts)
        own = F.when(F.coalesce("_i", F.lit(0)) == 0, F.array(*asking.figure(f, plots, count_panels, plot_types)))
        of_panel = F.when(p["type"] == "contour", F.array(*asking.panel(f, p, False, F.col("_colors"), F.col("_s")))).when(sky, F.array(*asking.panel(f, p, True, F.col("_colors"), F.col("_s"))))
        return F.concat(F.coalesce(own, F.array()), F.coalesce(of_panel, F.array()))

    # the questions are a column first, as a generator runs its expressions uncompiled; outer, as of a plain explode Spark infers
    # a filter, and that makes all questions of a panel another two times
    asked = panels.select("fig_id", F.when(F.size("plots") > 1, all_of(True)).otherwise(all_of(False)).alias("asked"))
    every = asked.select("fig_id", F.explode_outer("asked").alias("q")).select("fig_id", "q.*")
    always = [i for i, text in enumerate(texts) if text[2] in FIGURE_QUESTIONS]
    found = every.where(F.col("a").isNotNull() | F.col("n").isin(*always))
    level, kind, name, tag, more, question, form = (F.get(F.array(*map(F.lit, column)), F.col("n")) for column in zip(*texts))
    context = F.concat("c", more)
    whole = F.concat(F.lit(PERSONA + " "), context, F.lit(" "), question, F.lit(" "), form)
    return found.select(
        "fig_id", level.alias("level"), kind.alias("kind"), name.alias("name"), "plot", whole.alias("q"), tag.alias("tag"), "a", F.lit(PERSONA).alias("persona"), context.alias("context"), question.alias("question"), form.alias("format")
    )
