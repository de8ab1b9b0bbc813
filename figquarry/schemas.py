
from __future__ import annotations

FIGURES = """fig_id STRING, figure STRUCT<dpi: DOUBLE, base: DOUBLE, `aspect ratio`: DOUBLE, nrows: INT, ncols: INT, `plot style`: STRING,
`color map`: STRING, `plot indexes`: ARRAY<ARRAY<INT>>, `pixel width`: INT, `pixel height`: INT>,
plots ARRAY<STRUCT<plot_num: INT, type: STRING, distribution: STRING, xs: ARRAY<DOUBLE>, ys: ARRAY<DOUBLE>, colors: ARRAY<ARRAY<DOUBLE>>,
drawn_keys: ARRAY<STRING>, x_pixel_limits: ARRAY<DOUBLE>, y_pixel_limits: ARRAY<DOUBLE>, wcs_header: STRING, fits_header: STRING, bunit: STRING,
xlabel: STRING, ylabel: STRING, title: STRING, xticks: ARRAY<STRING>, yticks: ARRAY<STRING>>>"""
BOXES = "fig_id STRING, plot_num INT, label STRING, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
QUESTIONS = "vqa_id STRING, level STRING, kind STRING, name STRING, plot STRING, q STRING, a STRING, persona STRING, context STRING, question STRING, format STRING"
ANSWERS = """run STRING, model STRING, vqa_id STRING, category STRING, level STRING, question STRING, context STRING, format STRING, truth STRING,
raw STRING, response STRING, prompt STRING, error STRING, input_tokens BIGINT, output_tokens BIGINT"""
FIELDS = "fig_id STRING, iy INT, ix INT, x DOUBLE, y DOUBLE, value DOUBLE"
ID_MAP = "vqa_id STRING, source STRING, category STRING"
MANIFEST = "vqa_id STRING, preset STRING, seed BIGINT, base_seed BIGINT, gray_prob DOUBLE, grayscale BOOLEAN, effects ARRAY<STRING>, effects_by_phase MAP<STRING, ARRAY<STRING>>"
MISSING_LOG = "object STRING, survey STRING, pdf STRING, reason STRING"
SURVEYS = "survey STRING, Regime STRING, Resolution STRING, PixelScale STRING, PixelUnits STRING, Frequency STRING, Bandpass STRING, Coverage STRING, CoordinateSystem STRING, Projection STRING, Epoch STRING, Provenance STRING"
OBJECTS = "object STRING, otype STRING, majaxis_arcmin DOUBLE, minaxis_arcmin DOUBLE"
OBJECT_POOL = "object STRING, wavelength STRING, pdf STRING, itable INT"
CHECKS = "section STRING, claim STRING, computed STRING, paper STRING, ok BOOLEAN"
