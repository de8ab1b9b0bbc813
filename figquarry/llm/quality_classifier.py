"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on bootstrap samples of labelled rows; every path from a root becomes a conjunctive rule.
A lasso logistic regression weighs the rules, most of them with 0. What is left is compiled into one Spark column
expression: scoring a document is arithmetic over its statistics, on the JVM.

Training reads the statistics (no texts) of at most `sample` labelled rows, those with the least hashes of doc_id.

Defined results: null and empty texts have all statistics 0 and are scored like any other; repeated rows are scored
each for itself; labels that contradict each other count as 1; with one class only, or none, every score is that class
(0 without labels); no documents give no rows. Statistics are taken from whole texts of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_labels, id_and_text, remainder, with_label
from .quality_rules import SPACE, words_of

SAMPLE = 20_000
TREES = 24
DEPTH = 3
CUT = 0.7
PENALTY = 0.002
STATISTICS = ["words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "marks", "bars", "bangs", "digits", "stops", "wide"]


def statistics(docs: DataFrame) -> DataFrame:
    """docs with one column for each of STATISTICS added: counts as logarithms, all else as shares."""
    t = F.coalesce("text", F.lit(""))
    # one pass that maps each kind of character to one of its own; what is left of a kind is then counted
    kinds = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&*<>0123456789", "A" * 26 + "#" * 7 + "0" * 10)
    base = docs.select(*docs.columns, F.explode(F.array(F.struct(words_of(F.col("text")).alias("w"), kinds.alias("k"), F.split(F.btrim(t, F.lit(SPACE)), "\n").alias("l")))).alias("_s"))
    words, k, lines = F.col("_s.w"), F.col("_s.k"), F.col("_s.l")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(k), F.lit(1)).cast("double")
    count = lambda c: F.length(k) - F.length(F.replace(k, F.lit(c), F.lit("")))
    return base.select(
        *docs.columns,
        F.log1p(F.size(words).cast("double")).alias("words"),
        (F.length(F.array_join(words, "")) / n).alias("word_length"),
        (F.size(F.array_distinct(words)) / n).alias("distinct_words"),
        (F.size(F.array_distinct(lines)) / F.size(lines).cast("double")).alias("distinct_lines"),
        F.log1p(n / F.size(lines)).alias("line_words"),
        (count("A") / chars).alias("upper"),
        (count("#") / n).alias("marks"),
        (count("|") / n).alias("bars"),
        (count("!") / n).alias("bangs"),
        (count("0") / chars).alias("digits"),
        ((count(".") + count(",")) / n).alias("stops"),
        ((F.octet_length(k) - F.length(k)) / chars).alias("wide"),
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, limit), all of which must hold


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The rules of a tree: the path to each of its nodes but the root."""
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return []
    best = (0.0, 0, 0.0)
    impurity = lambda s, n: s * (n - s) / np.maximum(n, 1)  # noqa: E731  n times Gini, halved
    for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]:
        for limit in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))):
            up = x[:, f] > limit
            n, s = up.sum(), y[up].sum()
            if 3 <= n <= len(y) - 3:
                gain = impurity(y.sum(), len(y)) - impurity(s, n) - impurity(y.sum() - s, len(y) - n)
                best = max(best, (float(gain), int(f), float(limit)))
    gain, f, limit = best
    if gain <= 1e-9:
        return []
    up, out = x[:, f] > limit, []
    for above in (True, False):
        part = up == above
        rule = (*path, (f, above, limit))
        out += [rule, *_grow(x[part], y[part], depth - 1, rng, rule)]
    return out


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > limit) == above for f, above, limit in rule])


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the intercept isn't penalised."""
    n = len(y)
    z1 = np.hstack([z, np.ones((n, 1))])
    v = np.ones(z1.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (z1.T @ (z1 @ v)))
    w = np.zeros(z1.shape[1])
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w, 1.0
    for _ in range(rounds):
        step = ahead - rate * (z1.T @ (1 / (1 + np.exp(-(z1 @ ahead))) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[-1] = step[-1]
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The score as a column expression over the columns of statistics()."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, limit in rule:
                holds = holds & ((F.col(STATISTICS[f]) > limit) if above else (F.col(STATISTICS[f]) <= limit))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * _holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def train(x: np.ndarray, y: np.ndarray, cut: float = CUT, penalty: float = PENALTY) -> Model:
    """Rules and weights. The intercept is moved so that `cut` is where training errors, each class weighed alike, are least."""
    if not len(y) or y.min() == y.max():
        return Model([], 40.0 if len(y) and y[0] else -40.0)
    rng, rules = np.random.default_rng(10), {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        rules |= dict.fromkeys(_grow(x[rows], y[rows], DEPTH, rng))
    kept, columns, seen = [], [], set()
    for rule in rules:
        z = _holds(rule, x)
        if 0 < z.sum() < len(z) and z.tobytes() not in seen:
            seen.add(z.tobytes())
            kept.append(rule)
            columns.append(z)
    weights, intercept = _lasso(np.array(columns, float).T, y, penalty) if kept else (np.zeros(0), 0.0)
    model = Model([(r, float(w)) for r, w in zip(kept, weights) if abs(w) > 1e-3], intercept)
    raw = model.predict(x)
    logit = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1))
    levels = np.unique(np.round(logit, 6))
    middles = (levels[1:] + levels[:-1]) / 2
    if len(middles):
        errors = [np.mean(logit[y == 1] < m) + np.mean(logit[y == 0] >= m) for m in middles]
        model.intercept += math.log(cut / (1 - cut)) - float(middles[int(np.argmin(errors))])
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, sample: int = SAMPLE) -> Model:
    """Trains on labelled documents whose remainder isn't held_fold; the statistics of at most `sample` documents come to
    the driver, one row each: of rows that share a doc_id the one with the least statistics counts."""
    usable = clean_labels(labels, "quality").where(remainder("doc_id", folds) != held_fold)
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("label", "quality")
    found = statistics(with_label(id_and_text(docs), chosen, "quality")).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "label")).alias("r"))
    rows = found.select("r.*").toPandas().sort_values(["label", *STATISTICS])
    return train(rows[STATISTICS].to_numpy(float), rows["label"].to_numpy(float))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: a row for each document."""
    return statistics(id_and_text(docs)).select("doc_id", model.column().alias("score"))
