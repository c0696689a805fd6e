"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees propose rules, the conjunctions along their paths; a lasso
logistic fit keeps a few of them with weights; these are compiled into one
Spark column expression, so scoring is a projection.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labels import held_out, lasso_logistic, sigmoid, training_sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, PENALTY, RATE = 40, 3, 32, 0.002, 0.3
LEAST_LEAF = 8
THRESHOLD = 0.3
GAP = "[\\x20\\x09-\\x0D]+"
SPACE = " \t\n\u000b\f\r"

#: Statistic: SQL-free column builders over the columns ``t``, ``words``, ``lines``.
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "shouts", "upper", "digits", "points",
    "distinct_words", "distinct_lines", "line_words", "adjacent", "other_chars",
)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``FEATURES`` in a struct ``f``; a null text is empty."""
    t, words, lines = F.col("__t"), F.col("__words"), F.col("__lines")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    d = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("__words", F.array_remove(F.split(t, GAP), "")).withColumn("__lines", F.split(t, "\n"))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.translate(t, SPACE, "")), F.lit(1)).cast("double")
    same = F.size(F.filter(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False))))
    values = {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": chars / n,
        "symbols": count("#*$%&<>{}~^\\") / chars,
        "pipes": count("|") / chars,
        "shouts": count("!") / chars,
        "upper": count(string.ascii_uppercase) / chars,
        "digits": count(string.digits) / chars,
        "points": count(".,;:?") / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_words": F.log1p(n / F.size(lines)),
        "adjacent": same / n,
        "other_chars": F.length(F.translate(t, string.ascii_letters + string.digits + SPACE + ".,;:?!'\"()-", "")) / chars,
    }
    f = F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])
    return d.withColumn("f", f).drop("__t", "__words", "__lines")


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` hold: (feature, is above, threshold); the rule's weight adds to the log-odds."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, f: Column) -> Column:
        parts = [(f[FEATURES[i]] > t) if above else (f[FEATURES[i]] <= t) for i, above, t in self.tests]
        return reduce(lambda a, b: a & b, parts)

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, t in self.tests:
            out &= (x[:, i] > t) == above
        return out


def _tree(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: set, out: np.ndarray) -> None:
    value = grad[rows].sum() / (hess[rows].sum() + 1.0)
    if path:
        rules.add(path)
    best = (1e-6, None)
    if depth:
        base = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        for i, at in enumerate(cuts):
            if not len(at):
                continue
            bins = np.searchsorted(at, x[rows, i], side="left")
            g = np.bincount(bins, grad[rows], len(at) + 1).cumsum()[:-1]
            h = np.bincount(bins, hess[rows], len(at) + 1).cumsum()[:-1]
            k = np.bincount(bins, minlength=len(at) + 1).cumsum()[:-1]
            gain = g**2 / (h + 1) + (grad[rows].sum() - g) ** 2 / (hess[rows].sum() - h + 1) - base
            gain[(k < LEAST_LEAF) | (len(rows) - k < LEAST_LEAF)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (i, float(at[j])))
    if best[1] is None:
        out[rows] += RATE * value
        return
    i, t = best[1]
    above = x[rows, i] > t
    for side, part in ((False, rows[~above]), (True, rows[above])):
        _tree(x, cuts, grad, hess, part, (*path, (i, side, t)), depth - 1, rules, out)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Rule]]:
    """Intercept and rules from statistics and labels; the rows' share alone without both labels or without any split."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    alone = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return alone, []
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    out, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        p = sigmoid(out)
        _tree(x, cuts, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, paths, out)
    if not paths:
        return alone, []
    rules = [Rule(p) for p in sorted(paths)]
    hits = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(hits, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules = [rules[i] for i in sorted(first)]
    hits = hits[:, sorted(first)].astype(float)
    intercept, w = lasso_logistic(hits, y, PENALTY)
    return intercept, [Rule(r.tests, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4]


def compiled(intercept: float, rules: list[Rule], f: Column) -> Column:
    """The ensemble's score as one expression."""
    total = F.lit(float(intercept))
    for r in rules:
        total = total + F.when(r.column(f), F.lit(r.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[Rule]]:
    """The rules for ``labels.quality``, from at most ``sample`` rows' statistics on the driver. Eager."""
    rows = statistics(training_sample(docs, labels, "quality", sample)).select("doc_id", "y", "f.*").orderBy("doc_id").toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of empty statistics; a null doc_id counts
    as an empty one in the fold; without usable labels every row has one score;
    repeated rows get equal scores; an empty table gives an empty result; other
    columns are ignored. Eager in the fit.
    """
    intercept, rules = learn(docs, labels, sample)
    scored = statistics(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(intercept, rules, F.col("f")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
