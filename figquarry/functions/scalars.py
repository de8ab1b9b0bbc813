"""

All are built from Spark's own functions, so they stay inside generated code. Where the inputs are out of range the
result is NULL, never an error or NaN.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- strings ---------------------------------------------------------------------------------------------------


def normalise_answer(x) -> Column:
    """F1: lower case without spaces and underscores. A missing answer stays missing."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[ _]", ""))


def normalise_key(x) -> Column:
    """F2: lower case without white space, underscores and hyphens."""
    return F.lower(F.regexp_replace(c(x), r"[\s_\-]+", ""))


def normalise_name(x) -> Column:
    """lower case; runs of white space, underscores and hyphens become one space."""
    return F.lower(F.trim(F.regexp_replace(c(x), r"[\s_\-]+", " ")))


def expected_key(fmt) -> Column:
    """the key a format text asks for: between its first { and }, before the first colon, without quotes."""
    inner = F.regexp_extract(c(fmt), r"\{([^{}:]*):[^}]*\}", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, "[\"'`]", "")), F.lit(""))


#: Edits up to which a distance is looked for along diagonals, before the whole table is worked through.
DIAGONALS = 400


def _alike(a: str, i: int, b: str, j: int) -> int:
    """How many characters a from i and b from j have in common, by slices of growing and then shrinking length."""
    n, step = 0, 16
    while step and a[i + n : i + n + step] == b[j + n : j + n + step] and i + n + step <= len(a) and j + n + step <= len(b):
        n, step = n + step, 2 * step
    while step:
        if i + n + step <= len(a) and j + n + step <= len(b) and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step //= 2
    return n


def diagonal_distance(a: str, b: str, most: int = DIAGONALS) -> int | None:
    """Levenshtein distance if it is `most` or less: how far each diagonal reaches with 0, 1, 2, ... edits. In time near the texts' length."""
    reach = {0: _alike(a, 0, b, 0)}
    for edits in range(most + 1):
        if reach.get(len(a) - len(b), -1) >= len(a):
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            i = min(max(reach.get(k - 1, -2) + 1, reach.get(k, -2) + 1, reach.get(k + 1, -2)), len(a), len(b) + k)
            if i >= max(0, k):
                further[k] = i + _alike(a, i, b, i - k)
        reach = further
    return None


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns: each row of the table is one integer of len(b) bits."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, distance = full, 0, len(b)
    for x in a:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        across_up, across_down = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(across_up & last) - bool(across_down & last)
        across_up, across_down = (across_up << 1 | 1) & full, across_down << 1 & full
        up, down = across_down | (full & ~(diagonal | across_up)), across_up & diagonal
    return distance


def _distance(a: str, b: str) -> int:
    near = diagonal_distance(a, b)
    return bit_distance(a, b) if near is None else near


def edit_distance(a, b) -> Column:
    """the Levenshtein distance of two texts in code points. Short texts are compared by Spark's own function. Of long
    ones those that differ little are followed along diagonals, in time near their length; others take bit-parallel columns,
    a 64th of the table's steps."""
    import pandas as pd

    a, b = c(a), c(b)
    small = F.length(a).cast("long") * F.length(b) <= 1 << 20
    run = F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else _distance(p, q) for p, q in zip(x, y)], dtype="Int64"), "long")
    return F.coalesce(F.when(small, F.levenshtein(a, b)).cast("long"), run(F.when(~small, a), F.when(~small, b)))


def cer(hypothesis, reference) -> Column:
    """character error rate in percent of the reference's length; where either side is empty or missing, the other's length (not percent)."""
    h, r = F.coalesce(c(hypothesis), F.lit("")), F.coalesce(c(reference), F.lit(""))
    return F.when((F.length(h) > 0) & (F.length(r) > 0), edit_distance(h, r) * 100.0 / F.length(r)).otherwise(F.greatest(F.length(h), F.length(r)).cast("double"))


def epoch(label) -> Column:
    """J2000 / B1950 / 2000 / none from an axis label; tagged epochs before bracketed before bare years."""
    x = c(label)
    found = [F.regexp_replace(F.regexp_extract(x, r"([JB]\s?\d{4})", 1), r"\s", ""), F.regexp_extract(x, r"\((\d{4})\)", 1), F.regexp_extract(x, r"(?<![\d.])((?:18|19|20)\d{2})(?![\d.])", 1)]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("none"))


# Units of tick labels from the finest on, with the marks that show them in LaTeX and plain labels.
TICK_UNITS = {
    "ra": [("seconds", ["mathrm{s}", "mathregular{^s}"]), ("minutes", ["mathrm{m}", "mathregular{^m}"]), ("hours", ["mathrm{h}", "mathregular{^h}"])],
    "dec": [("arcseconds", ["\\prime\\prime", "''"]), ("arcminutes", ["\\prime", "'"]), ("degrees", ["circ", "°"])],
}


def finest_tick_unit(ticks, axis: str) -> Column:
    """the finest unit that any tick label of an axis (ra or dec) shows; NULL if none is shown or there are no ticks."""
    text = F.array_join(c(ticks), " ")
    shown = [F.when(reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks]), unit) for unit, marks in TICK_UNITS[axis]]
    return F.coalesce(*shown)


def header_value(header, key: str) -> Column:
    """F8: the quoted value of a key in FITS header text."""
    return F.nullif(F.trim(F.regexp_extract(c(header), key + r"\s*=\s*'([^']*)'", 1)), F.lit(""))


def header_number(header, key: str) -> Column:
    """The number of a key in FITS header text."""
    return F.nullif(F.regexp_extract(c(header), key + r"\s*=\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def choices(prompt) -> Column:
    """the options a prompt lists in square brackets."""
    inner = F.regexp_extract(c(prompt), r"\[([^\]]*)\]", 1)
    return F.when(inner != "", F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))))


def abridge(text, cut: str, resume: str) -> Column:
    """the text without what stands from `cut` up to `resume`."""
    x = c(text)
    a, b = F.locate(cut, x), F.locate(resume, x)
    return F.when((a > 0) & (b > a), F.concat(F.substring(x, F.lit(1), a - 1), F.lit("..."), F.substring(x, b, F.length(x)))).otherwise(x)


def latex_escape(text) -> Column:
    """& % # _ $ escaped."""
    return F.regexp_replace(c(text), r"([&%#_$])", r"\\$1")


def grouped_number(x, decimals: int = 0) -> Column:
    """a number with thousands separators and a fixed number of decimals."""
    return F.format_number(c(x), decimals)


# The HTML entities that pages use.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain_text(html) -> Column:
    """tags dropped, entities resolved, white space collapsed."""
    x = F.regexp_replace(c(html), "<[^>]*>", " ")
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


# Ordinals of panels.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def panel_words(row, col) -> Column:
    """which panel, in words, from its row and column (from 0). Inside the grid the two words are swapped, as published data have it."""
    r, k = c(row), c(col)
    word = lambda i: F.get(F.array(*map(F.lit, ORDINALS)), i)
    return (
        F.when((r == 0) & (k == 0), "top-left")
        .when(r == 0, F.concat(F.lit("top row and "), word(k), F.lit(" from the left")))
        .when(k == 0, F.concat(word(r), F.lit(" row and left-most")))
        .otherwise(F.concat(word(k), F.lit(" row and "), word(r), F.lit(" column")))
    )


def prompt(*parts) -> Column:
    """the parts, joined by one space; double spaces collapse."""
    return F.regexp_replace(F.concat_ws(" ", *map(c, parts)), " {2,}", " ")


def sent_prompt(text, prefix: str) -> Column:
    """trimmed, first letter in lower case, behind a prefix."""
    x = F.trim(c(text))
    return F.concat(F.lit(prefix), F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000_000))


def flat_name(x) -> Column:
    """F16: for file names: spaces to underscores, slashes to hyphens."""
    return F.translate(c(x), " /", "_-")


def unflat_name(x) -> Column:
    """F16: back again; hyphens and underscores that stood in the name can't be told apart."""
    return F.translate(c(x), "_-", " /")


def capitalise(x, how: str) -> Column:
    """none, first or all words."""
    return {"none": c(x), "first": F.concat(F.upper(F.substring(c(x), 1, 1)), F.substring(c(x), 2, 1_000_000_000)), "all": F.initcap(c(x))}[how]


def fenced_json(text) -> Column:
    """what stands in a ```json fence, line comments dropped; the whole text if there is none."""
    x = F.regexp_replace(c(text), r"//[^\n]*(?=\n)", "")
    return F.btrim(F.coalesce(F.nullif(F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), x), F.lit(" \t\r\n"))


# The JSON grammar's escapes; raw strings r"..." and formulas $...$ below.
_RAW_STRING, _FORMULA = 'r("[^"]*")', r"\$([^$]+)\$"
_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'


def fix_escapes(text) -> Column:
    """backslashes that start no JSON escape are doubled. Read from the left: each match takes whole escapes and
    other characters up to the next such backslash, and starts where the one before ended."""
    return F.regexp_replace(c(text), r"\G((?:[^\\]|" + _ESCAPE + r")*+)\\", r"$1\\\\")


def fix_raw_strings(text) -> Column:
    """r"..." as a JSON string: without the r, its backslashes doubled. Marked from the left, as an r may end what stands in quotes."""
    pieces = F.split(F.regexp_replace(c(text), _RAW_STRING, "\x01$1\x02"), "\x01")
    ended = lambda x: F.locate("\x02", x)
    repaired = F.transform(pieces, lambda x: F.when(ended(x) == 0, x).otherwise(F.concat(F.replace(F.substring_index(x, "\x02", 1), F.lit("\\"), F.lit("\\\\")), F.substring_index(x, "\x02", -1))))
    return F.array_join(repaired, "")


def fix_latex_commands(text) -> Column:
    """single backslashes before letters are doubled, JSON escapes among them."""
    return F.regexp_replace(c(text), r"\G((?:[^\\]|\\[^a-zA-Z])*+)\\(?=[a-zA-Z])", r"$1\\\\")


def quote_math(text) -> Column:
    """$...$ in quotes, its dollars escaped."""
    return F.regexp_replace(c(text), _FORMULA, r'"\\\$$1\\\$"')


def padded_id(prefix: str, n, width: int = 6) -> Column:
    """F21"""
    return F.concat(F.lit(prefix), F.lpad(c(n).cast("string"), width, "0"))


def hash_u01(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) from a seed and keys: the same on every partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(c, keys)), 11).cast("double") / float(1 << 53)


def digest(content) -> Column:
    """a checksum of content."""
    return F.sha2(c(content).cast("binary"), 256)


# --- numbers ---------------------------------------------------------------------------------------------------


def normalise_numeric(x) -> Column:
    """M2: ^ and ** as exponents, 1e(-5) without brackets, the minus sign as hyphen; thousands separators dropped."""
    s = F.replace(F.replace(F.trim(c(x)), F.lit("−"), F.lit("-")), F.lit(","), F.lit(""))
    s = F.replace(F.replace(s, F.lit("**"), F.lit("e")), F.lit("^"), F.lit("e"))
    return F.regexp_replace(s, r"e\(([-+]?\d+)\)", "e$1")


def as_float(x) -> Column:
    """M1: the number in a string, NULL if it isn't one. A strict pattern stands before the cast: engines differ on 1_0 and 1d."""
    s = normalise_numeric(x)
    return F.when(s.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), s.try_cast("double"))


def aspect_ratio(x) -> Column:
    """M3: 4:3, 4/3, 'about 1.5', '1.2 to 1.4' (the last counts) as a ratio; NULL if none is found."""
    s = F.regexp_replace(F.lower(c(x)), r"\(.*", "")
    last = F.element_at(F.split(s, r"\b(?:or|to)\b"), -1)
    a, b = F.regexp_extract(last, r"(\d+\.?\d*)\s*[:/]\s*(\d+\.?\d*)", 1), F.regexp_extract(last, r"(\d+\.?\d*)\s*[:/]\s*(\d+\.?\d*)", 2)
    single = F.nullif(F.regexp_extract(last, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when((a != "") & (b.try_cast("double") > 0), a.try_cast("double") / b.try_cast("double")).otherwise(single)


def finite(x) -> Column:
    """Neither NULL, NaN nor infinite."""
    return c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))


def ssmape(answer, truth) -> Column:
    """M4: difference over the mean of absolute values, in [-2, 2]; NULL where both are 0."""
    a, b = c(answer).cast("double"), c(truth).cast("double")
    mean = (F.abs(a) + F.abs(b)) / 2
    return F.when(mean > 0, (a - b) / mean)


def log_ratio(answer, truth) -> Column:
    """M5: log10(answer / truth) where both are finite and positive."""
    a, b = c(answer).cast("double"), c(truth).cast("double")
    return F.when((a > 0) & (b > 0) & finite(a) & finite(b), F.log10(a / b))


def percent_difference(a, b) -> Column:
    """M6"""
    return F.when(c(b) != 0, 100 * F.abs(c(a) / c(b) - 1))


def in_band(x, low: float | None, high: float | None) -> Column:
    """Low <= x < high; open ends as None. NaN is in no band."""
    x = c(x)
    cond = x.isNotNull() & ~F.isnan(x)
    if low is not None:
        cond = cond & (x >= low)
    if high is not None:
        cond = cond & (x < high)
    return cond


def rescale(x, low, high, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """M7: affine from [low, high]; a degenerate range gives to_low."""
    x, low, high = c(x), c(low), c(high)
    return F.when(high > low, to_low + (x - low) / (high - low) * (to_high - to_low)).otherwise(F.lit(to_low))


def gaussian(seed: int, *keys) -> Column:
    """M8: a standard normal number from a seed and keys (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - hash_u01(seed, *keys))) * F.cos(2 * math.pi * hash_u01(seed + 1, *keys))


def noisy(value, seed: int, *keys, scale: float, additive: bool = False) -> Column:
    """M8: value with gaussian noise, as a share of it or added."""
    g = scale * gaussian(seed, *keys)
    return c(value) + g if additive else c(value) * (1 + g)


def log_axis(u_exponent, u_exponential, u_low, u_high, exponents: tuple[float, float] = (0.01, 5.0), factors: tuple[float, float] = (0.1, 10.0)) -> tuple[Column, Column]:
    """Limits of a logarithmic axis about 10 ** e, e exponential with a uniform mean; each limit is away by a uniform
    multiple of it. Takes four uniform numbers, so that the draw can be keyed."""
    between = lambda u, pair: pair[0] + c(u) * (pair[1] - pair[0])
    centre = F.pow(F.lit(10.0), -between(u_exponent, exponents) * F.log(1 - c(u_exponential)))
    return centre * (1 - between(u_low, factors)), centre * (1 + between(u_high, factors))


def log_uniform(u, low: float, high: float) -> Column:
    """M9"""
    return F.exp(math.log(low) + c(u) * (math.log(high) - math.log(low)))


# Arc seconds in each unit, with the marks that show it; case doesn't matter.
ARC_UNITS = [(r"(?:°|\bdeg\b|\bdegrees?\b)", 3600.0), (r"(?:'(?!')|′|\barcmin\b|\barcminutes\b)", 60.0), (r"(?:\"|''|″|\barcsec\b|\barcseconds\b)", 1.0)]


def angle_arcsec(text) -> Column:
    """The largest angle in a free text, in arc seconds; NULL without a number that has a unit. ?? is a lost degree sign and says nothing."""
    x = F.replace(c(text), F.lit("??"), F.lit(" "))

    def found(unit: str, arcsec: float) -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(r"(?i)(\d+(?:\.\d+)?)\s*" + unit), F.lit(1)), lambda v: v.cast("double") * arcsec)

    return F.array_max(F.concat(*[found(*u) for u in ARC_UNITS]))


def hms(degrees) -> Column:
    """HHhMMmSS.SSs with carry, hours modulo 24."""
    hundredths = F.pmod(F.round(c(degrees) / 15.0 * 360000.0), F.lit(24 * 360000.0)).cast("long")
    s = F.pmod(hundredths, F.lit(6000))
    text = F.format_string("%02dh%02dm%02d.%02ds", F.floor(hundredths / 360000), F.floor(F.pmod(hundredths, F.lit(360000)) / 6000), F.floor(s / 100), F.pmod(s, F.lit(100)))
    return F.when(hundredths.isNotNull(), text)


def parse_hms(text) -> Column:
    """Degrees of HHhMMmSS.SSs."""
    part = lambda k: F.regexp_extract(c(text), r"^\s*(\d+)h(\d+)m(\d+\.?\d*)s", k).try_cast("double")
    return (part(1) + part(2) / 60 + part(3) / 3600) * 15


def field_extent(ra_span, dec_low, dec_high) -> tuple[Column, Column]:
    """Width and height of a field in arc minutes."""
    mid = (c(dec_low) + c(dec_high)) / 2
    return F.abs(c(ra_span)) * F.cos(F.radians(mid)) * 60, F.abs(c(dec_high) - c(dec_low)) * 60


def pixel_scale(height_arcsec, rows) -> Column:
    """Arc seconds a pixel."""
    return F.when(c(rows) > 0, c(height_arcsec) / c(rows))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation in degrees (haversine)."""
    a, b = F.radians(c(dec1)), F.radians(c(dec2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(c(ra2) - c(ra1)) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def tan_sky(xi, eta, ra0, dec0) -> tuple[Column, Column]:
    """Sky position of tangent-plane offsets (degrees) from a reference point: the inverse gnomonic projection."""
    x, y, d0 = F.radians(c(xi)), F.radians(c(eta)), F.radians(c(dec0))
    d = F.cos(d0) - y * F.sin(d0)
    ra = c(ra0) + F.degrees(F.atan2(x, d))
    dec = F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + d * d)))
    return F.pmod(ra, F.lit(360.0)), dec


def spherical_offset(ra, dec, d_east, d_north) -> tuple[Column, Column]:
    """The point at small offsets (degrees) east and north."""
    return F.pmod(c(ra) + c(d_east) / F.cos(F.radians(c(dec))), F.lit(360.0)), c(dec) + c(d_north)


def is_round_sexagesimal(x) -> Column:
    """M23"""
    return F.abs(c(x) * 2 - F.round(c(x) * 2)) < 1e-4


def pixel_grid(nx, ny, width=300, height=300) -> Column:
    """struct<nx, ny, k>: the grid a panel is drawn on, and the step of the source that makes it.

    A request beyond the source is scaled down by one factor. The step k is the largest that fits the source on both
    axes; it has to be odd, for then the samples lie on the centre of the crop. An even one is raised by one and the
    grid shrunk to keep the crop, again and again as the smaller grid may allow a larger step; where that can't be
    done, it is lowered by one.
    """
    w, h = (c(x) if isinstance(x, (str, Column)) else F.lit(x) for x in (width, height))
    w, h, x, y = w.cast("long"), h.cast("long"), F.greatest(c(nx).cast("long"), F.lit(1)), F.greatest(c(ny).cast("long"), F.lit(1))
    scale = F.least(F.lit(1.0), w / x, h / y)
    fitted = lambda n, most: F.least(most, F.greatest(F.lit(1), F.bround(n * scale).cast("long")))
    state = lambda a, b, k: F.struct(a.alias("nx"), b.alias("ny"), k.cast("long").alias("k"))
    fit = lambda a, b: F.greatest(F.lit(1), F.least(F.floor(w / a), F.floor(h / b)))
    lowered = lambda s: state(s["nx"], s["ny"], F.greatest(F.lit(1), s["k"] - 1))

    def settle(s: Column, _: Column) -> Column:
        odd = s["k"] + 1
        shrunk = lambda n: F.greatest(F.lit(1), F.floor(n * s["k"] / odd))
        a, b = shrunk(s["nx"]), shrunk(s["ny"])
        stuck = (a * odd > w) | (b * odd > h) | ((a == s["nx"]) & (b == s["ny"]))
        return F.when(s["k"] % 2 == 1, s).when(stuck, lowered(s)).otherwise(state(a, b, fit(a, b)))

    x, y = fitted(x, w), fitted(y, h)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), state(x, y, fit(x, y)), settle, lambda s: F.when(s["k"] % 2 == 0, lowered(s)).otherwise(s))


def decimated_header(crpix, cdelt, size, n, k) -> tuple[Column, Column]:
    """Reference pixel and pixel scale of an axis after its centred crop to n * k of `size` pixels and taking every k-th."""
    first = F.floor((c(size) - c(n) * c(k)) / 2) + F.floor((c(k) - 1) / 2)
    return (c(crpix) - first - 1 + c(k)) / c(k).cast("double"), c(cdelt) * c(k)


def crop_indexes(n, size: int, step) -> Column:
    """Source indexes of a centred crop to `size` samples at `step`."""
    first = F.floor((c(n) - (size - 1) * c(step) - 1) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (first + j * c(step)).cast("int"))


def clean(x) -> Column:
    """NaN, infinities and NULL to 0."""
    return F.when(finite(x), c(x)).otherwise(0.0)


def halved(iy, ix, ny, nx, most: int = 4000) -> Column:
    """Whether a cell is kept: every second one of each axis if either has more than `most`."""
    return ((c(ny) <= most) & (c(nx) <= most)) | ((c(iy) % 2 == 0) & (c(ix) % 2 == 0))


def contour_limits(xs, lines_only) -> tuple[Column, Column]:
    """Axis limits of a contour panel: those of the values where only lines are drawn, else half a cell (of the first
    two values) beyond either end, in ascending order. NULL for fewer than two values."""
    x = c(xs)
    half = (F.get(x, F.lit(1)) - F.get(x, F.lit(0))) / 2
    a, b = F.get(x, F.lit(0)) - half, F.element_at(x, -1) + half
    limit = lambda of_lines, of_image: F.when(F.size(x) > 1, F.when(c(lines_only), of_lines).otherwise(of_image))
    return limit(F.array_min(x), F.least(a, b)), limit(F.array_max(x), F.greatest(a, b))


def flip_box(ymin, ymax, height) -> tuple[Column, Column]:
    """Bottom-left to top-left origin."""
    return c(height) - c(ymax), c(height) - c(ymin)


def remapped(value, old_low, old_high, new_low, new_high) -> Column:
    """A coordinate carried from one canvas to another; NULL for an empty canvas."""
    return c(new_low) + (c(value) - c(old_low)) / F.nullif(c(old_high) - c(old_low), F.lit(0.0)) * (c(new_high) - c(new_low))


# Of a label, the height of a line and the width of a character in points of its font, and the room it needs.
LINE_HEIGHT, CHARACTER_WIDTH, LABEL_ROOM = 1.25, 0.62, 1.15


def tick_capacity(span_px, font_pt, dpi, longest=5, vertical=True, least: int = 2, most: int = 11) -> Column:
    """How many tick labels fit along a bar: by line height where they stack, else by the longest label's characters."""
    size = F.when(c(vertical) if isinstance(vertical, (str, Column)) else F.lit(vertical), F.lit(LINE_HEIGHT)).otherwise(CHARACTER_WIDTH * (c(longest) if isinstance(longest, (str, Column)) else F.lit(longest)))
    label = c(font_pt) * size * c(dpi) / 72.0 * LABEL_ROOM
    return F.when((label > 0) & (c(span_px) > 0), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(c(span_px) / label).cast("int")))).otherwise(least)


def safe_dpi(width, height, dpi, most: float = 100e6) -> Column:
    """Dpi, lowered where the figure (in inches) would have more than `most` pixels."""
    area = c(width) * c(height)
    return F.when(area * c(dpi) * c(dpi) > most, F.sqrt(most / area)).otherwise(c(dpi).cast("double"))


def pixel_size(width, height, dpi) -> tuple[Column, Column]:
    """Width and height in pixels, cut to whole ones."""
    return F.floor(c(width) * c(dpi)).cast("int"), F.floor(c(height) * c(dpi)).cast("int")


def panel_grid(drawn, layout, flip, least: int, most: int, even_above: int) -> tuple[Column, Column]:
    """Rows and columns of a figure from a (normal) draw of the number of panels, a layout and a fair coin: the number
    is rounded and clamped, above even_above the layout is squarish, and that may change the number."""
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(c(drawn)))).cast("int")
    side = F.floor(F.sqrt(n)).cast("int")
    other = F.bround(n / side).cast("int")
    squarish = (c(layout) == "squarish") | (n > even_above)
    rows = F.when(squarish, F.when(c(flip), other).otherwise(side)).when(c(layout) == "horizontal", 1).otherwise(n)
    columns = F.when(squarish, F.when(c(flip), side).otherwise(other)).when(c(layout) == "horizontal", n).otherwise(1)
    return rows, columns


# --- boxes -----------------------------------------------------------------------------------------------------


def boxes_overlap(a: str, b: str) -> Column:
    """B1: rectangles with prefixes a and b share area; touching edges don't count."""

    def shared(axis: str) -> Column:
        start = F.greatest(F.col(f"{a}.{axis}min"), F.col(f"{b}.{axis}min"))
        return start < F.least(F.col(f"{a}.{axis}max"), F.col(f"{b}.{axis}max"))

    return shared("x") & shared("y")


def iou(a: str, b: str) -> Column:
    """B2: intersection over union; negative overlaps count as none."""
    p = lambda t, k: F.col(f"{t}.{k}")
    w = F.greatest(F.lit(0.0), F.least(p(a, "xmax"), p(b, "xmax")) - F.greatest(p(a, "xmin"), p(b, "xmin")))
    h = F.greatest(F.lit(0.0), F.least(p(a, "ymax"), p(b, "ymax")) - F.greatest(p(a, "ymin"), p(b, "ymin")))
    area = lambda t: (p(t, "xmax") - p(t, "xmin")) * (p(t, "ymax") - p(t, "ymin"))
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def _angle(ux, uy, vx, vy) -> Column:
    """The angle between two vectors in degrees; NULL if one has no length."""
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm)))))


def corner_angle(ax, ay, bx, by, cx, cy) -> Column:
    """The interior angle at b in degrees."""
    return _angle(c(ax) - c(bx), c(ay) - c(by), c(cx) - c(bx), c(cy) - c(by))


def near_rectangle(points, tolerance: float = 12.0) -> Column:
    """Whether all four interior angles of a quad (array of struct<x, y>) are within `tolerance` degrees of a right one."""
    p = c(points)

    def sides(b: Column, i: Column) -> Column:  # from a corner to those beside it: worked out once for all that rests on them
        u, v = F.get(p, F.pmod(i + 3, F.lit(4))), F.get(p, F.pmod(i + 1, F.lit(4)))
        return F.struct((u["x"] - b["x"]).alias("ux"), (u["y"] - b["y"]).alias("uy"), (v["x"] - b["x"]).alias("vx"), (v["y"] - b["y"]).alias("vy"))

    right = F.forall(F.transform(p, sides), lambda s: F.coalesce(F.abs(_angle(s["ux"], s["uy"], s["vx"], s["vy"]) - 90) <= tolerance, F.lit(False)))
    return (F.size(p) == 4) & F.coalesce(right, F.lit(False))


def point_in_polygon(x, y, polygon) -> Column:
    """Ray casting over an array of struct<x, y>."""
    p, n = c(polygon), F.size(c(polygon))

    def crosses(i: Column) -> Column:
        a, b = F.get(p, i), F.get(p, F.pmod(i + 1, n))
        return F.when(((a["y"] > c(y)) != (b["y"] > c(y))) & (c(x) < (b["x"] - a["x"]) * (c(y) - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)), F.lit(2)) == 1


def interval_overlap(a0, a1, b0, b1) -> Column:
    """Shared length over the shorter interval's."""
    shared = F.greatest(F.lit(0.0), F.least(c(a1), c(b1)) - F.greatest(c(a0), c(b0)))
    shorter = F.least(c(a1) - c(a0), c(b1) - c(b0))
    return F.when(shorter > 0, shared / shorter)


def ordered_corners(points) -> Column:
    """Corners as top-left, top-right, bottom-right, bottom-left (y down) of an array of struct<x, y>."""
    by = lambda key: F.transform(c(points), lambda p: F.struct(key(p).alias("k"), p.alias("p")))
    total, diff = by(lambda p: p["x"] + p["y"]), by(lambda p: p["x"] - p["y"])
    return F.array(F.array_min(total)["p"], F.array_max(diff)["p"], F.array_max(total)["p"], F.array_min(diff)["p"])


def bounding_box(points) -> Column:
    """N19"""
    x, y = c(points)["x"], c(points)["y"]  # of an array of structs, the array of a field
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def linspace(low, high, n) -> Column:
    """N evenly spaced values, ends included."""
    steps = F.greatest(c(n) - 1, F.lit(1)).cast("double")
    return F.transform(F.sequence(F.lit(0), c(n) - 1), lambda i: c(low) + i * (c(high) - c(low)) / steps)


def edge_points(points, spacing: float, least: int = 4, most: int = 300) -> Column:
    """Points along each side of a polygon, as many as its length asks for."""
    p, n = c(points), F.size(c(points))

    def side(a: Column, i: Column) -> Column:
        b = F.get(p, F.pmod(i + 1, n))
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def counted(s: Column) -> Column:
        k = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.hypot(s["dx"], s["dy"]) / spacing))).cast("int")
        return F.struct(s.alias("s"), k.alias("k"))

    def along(t: Column) -> Column:
        s, k = t["s"], t["k"]
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((s["x"] + s["dx"] * j / k).alias("x"), (s["y"] + s["dy"] * j / k).alias("y")))

    # each step works out once what the next one reads for every point
    return F.flatten(F.transform(F.transform(F.transform(p, side), counted), along))


# --- statistics ------------------------------------------------------------------------------------------------

Z95 = 1.959963984540054

# Coefficients of the Chebyshev fit of erfc to 1.2e-7 relative (Numerical Recipes), constant term first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x) -> Column:
    """The complementary error function, which Spark lacks."""
    z = F.abs(c(x))
    t = 1 / (1 + 0.5 * z)
    tail = t * F.exp(-z * z + reduce(lambda acc, k: acc * t + k, ERFC[-2::-1], F.lit(ERFC[-1])))
    return F.when(c(x) >= 0, tail).otherwise(2 - tail)


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * abs({x})))"
    poly = reduce(lambda acc, k: f"({acc}) * {t} + ({k})", ERFC[-2::-1], str(ERFC[-1]))
    return f"(CASE WHEN {x} >= 0 THEN {t} * exp(-({x}) * ({x}) + {poly}) ELSE 2 - {t} * exp(-({x}) * ({x}) + {poly}) END)"


def wilson(successes, n, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    k, n = c(successes).cast("double"), c(n).cast("double")
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def wilson_halfwidth_pp(n, p: float = 0.5, z: float = Z95) -> Column:
    """Half the Wilson interval's width, in percentage points."""
    n = c(n).cast("double")
    return F.when(n > 0, 100 * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n))


def wald(successes, n, z: float = Z95) -> tuple[Column, Column]:
    """The normal-approximation interval, not clipped."""
    k, n = c(successes).cast("double"), c(n).cast("double")
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n)
    return F.when(n > 0, p - half), F.when(n > 0, p + half)


def two_proportions(k1, n1, k2, n2) -> tuple[Column, Column]:
    """Pooled z and its two-sided p."""
    k1, n1, k2, n2 = (c(x).cast("double") for x in (k1, n1, k2, n2))
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = F.when((n1 > 0) & (n2 > 0), F.when(se > 0, (k1 / n1 - k2 / n2) / se).otherwise(0.0))
    return z, erfc(F.abs(z) / math.sqrt(2))


def detectable_difference_pp(n, p: float = 0.5, z_alpha: float = Z95, z_power: float = 0.8416) -> Column:
    """T4: the least difference of two shares of n each that is found with 80 % power, in percentage points."""
    return F.when(c(n) > 0, 100 * (z_alpha + z_power) * F.sqrt(2 * p * (1 - p) / c(n).cast("double")))


def mcnemar(b, k) -> tuple[Column, Column, Column]:
    """Chi-squared with continuity correction, its p, and the exact two-sided binomial p of discordant counts b and k."""
    b, k = c(b).cast("double"), c(k).cast("double")
    n = b + k
    chi = F.when(n > 0, F.pow(F.greatest(F.lit(0.0), F.abs(b - k) - 1), 2) / n).otherwise(0.0)
    low = F.least(b, k)
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["sum"])
    return chi, F.when(n > 0, erfc(F.sqrt(chi / 2))).otherwise(1.0), F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def bonferroni(p, family, alpha: float = 0.05) -> Column:
    """Significant after correction for the size of the family."""
    return c(p) < alpha / c(family)


def claim_holds(computed, claim) -> Column:
    """T8: '<x' and '>x' as bounds, '~x' within 5, numbers as rounded to the decimals they state, else equal strings."""
    claim, text = F.trim(c(claim)), c(computed).cast("string")
    value = text.try_cast("double")
    number = F.regexp_extract(claim, r"^[<>~]?\s*([-+]?\d+\.?\d*)$", 1).try_cast("double")
    decimals = F.length(F.regexp_extract(claim, r"\.(\d+)$", 1))
    as_stated = F.abs(value - number) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9
    return F.coalesce(
        F.when(number.isNull() | value.isNull(), text == claim)
        .when(claim.startswith("<"), value < number)
        .when(claim.startswith(">"), value > number)
        .when(claim.startswith("~"), F.abs(value - number) <= 5)
        .otherwise(as_stated),
        F.lit(False),
    )
