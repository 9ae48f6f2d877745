"""Quality classifier: a sparse rule ensemble.

Every text is described by statistics, all built-in column expressions. Small boosted trees on labelled rows are cut
into rules, each the conjunction of comparisons on one path from the root; a logistic model with a lasso penalty keeps
few of them, and those are compiled into one column expression. Scoring therefore runs no Python.

Fitting uses at most `max_rows` labelled rows, chosen by hashes of id and text: only their statistics, a few numbers each,
come to the driver. Scoring reads every text whole. Trees are cut into at most MAX_RULES rules, those of earlier trees
first; it bounds the model, not the data.

Defined cases: null text counts as empty, and empty texts get a score from the same rules (their shares are 0, those of
distinct words and lines 1); null labels are not used; with one class only, or no labels, the score is the smoothed share
of good rows; repeated rows count each; extra columns pass through untouched, one with the output's name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm.columns import Plain
from lemmaforge.llm.labelled import labelled

MAX_ROWS = 12_000
TREES = 40
DEPTH = 3
BINS = 32
MAX_RULES = 400
STATS = ("log_words", "mean_word", "punct", "symbols", "pipes", "shouts", "upper", "digits", "distinct", "repeats", "line_words", "line_distinct")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """A struct `row` of the columns of `docs`, and a struct `stats` of the columns STATS; null shares do not occur."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        F.struct(*docs.columns).alias("row"),
        t.alias("_t"),
        F.split(F.trim(t), r"[ \t\r\n]+").alias("_w"),
        F.split(F.trim(t), "\n").alias("_l"),
        F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "").alias("_p"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("_u"),
        F.length(F.regexp_replace(t, r"[^0-9]+", "")).alias("_d"),
    )
    n, words, lines = F.greatest(F.length("_t"), F.lit(1)), F.size("_w"), F.size("_l")
    p = F.col("_p")
    same = F.size(F.filter("_w", lambda x, i: x == F.get(F.col("_w"), i + 1)))
    values = {
        "log_words": F.log1p(words),
        "mean_word": F.length("_t") / words,
        "punct": F.length(p) / n,
        "symbols": F.length(F.regexp_replace(p, r"[.,;:!?|'\"()\-]+", "")) / n,
        "pipes": (F.length(p) - F.length(F.replace(p, F.lit("|"), F.lit("")))) / words,
        "shouts": (F.length(p) - F.length(F.replace(p, F.lit("!"), F.lit("")))) / words,
        "upper": F.col("_u") / n,
        "digits": F.col("_d") / n,
        "distinct": F.size(F.array_distinct("_w")) / words,
        "repeats": same / words,
        "line_words": F.log1p(words / lines),
        "line_distinct": F.size(F.array_distinct("_l")) / lines,
    }
    return parts.select("row", F.struct(*[values[s].cast("double").alias(s) for s in STATS]).alias("stats"))


@dataclass(frozen=True)
class Test:
    """stat <= cut, or stat > cut."""

    stat: int
    cut: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.stat] > self.cut if self.above else x[:, self.stat] <= self.cut

    def column(self, stats: str) -> Column:
        c = F.col(f"{stats}.{STATS[self.stat]}")
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: str = "stats") -> Column:
        """The score as one expression."""
        terms = [F.when(reduce(lambda a, b: a & b, (t.column(stats) for t in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        z = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * applies(rule, x)
        return 1 / (1 + np.exp(-z))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule])


def simplified(path: list[Test]) -> Rule:
    """One test for each statistic and direction: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for t in path:
        key = (t.stat, t.above)
        best[key] = t.cut if key not in best else (max if t.above else min)(best[key], t.cut)
    return tuple(Test(s, c, above) for (s, above), c in sorted(best.items()))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, path: list[Test], value: np.ndarray, rules: list[Rule], least: int) -> None:
    """Split by the largest gain in squared error, note both children's paths, write leaf means into value."""
    value[rows] = g[rows].mean()
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, -1, -1)
    total, count = g[rows].sum(), len(rows)
    for s, edges in enumerate(cuts):
        if not len(edges):
            continue
        sums = np.cumsum(np.bincount(codes[rows, s], g[rows], len(edges) + 1))[:-1]
        n = np.cumsum(np.bincount(codes[rows, s], minlength=len(edges) + 1))[:-1]
        ok = (n >= least) & (count - n >= least)
        gain = np.where(ok, sums**2 / np.maximum(n, 1) + (total - sums) ** 2 / np.maximum(count - n, 1) - total**2 / count, 0)
        k = int(gain.argmax())
        best = max(best, (float(gain[k]), s, k))
    _, s, k = best
    if s < 0:
        return
    low = codes[rows, s] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        own = [*path, Test(s, float(cuts[s][k]), above)]
        rules.append(simplified(own))
        _grow(codes, cuts, g, part, depth - 1, own, value, rules, least)


def candidate_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    cuts = [c[c < x[:, s].max()] for s, c in enumerate(cuts)]
    codes = np.column_stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)])
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        if not len(rows):
            continue
        value, found = np.zeros(len(y)), []
        _grow(codes, cuts, g, rows, depth, [], value, found, max(3, len(y) // 500))
        rules += found
        z = z + 2.0 * sum_of_leaves(found, x, g, rows)
    return list(dict.fromkeys(rules))[:MAX_RULES]


def sum_of_leaves(rules: list[Rule], x: np.ndarray, g: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row's mean residual in the deepest rule that applies to it, by rows of the subsample."""
    out = np.zeros(len(x))
    for rule in sorted(rules, key=len):
        hit = applies(rule, x)
        inside = hit[rows]
        if inside.any():
            out[hit] = g[rows][inside].mean()
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient with an unpenalised intercept, on centred columns."""
    mean = a.mean(0)
    scale = np.maximum(a.std(0), 0.02)
    b = (a - mean) / scale
    step = 4 / (np.linalg.norm(b, 2) ** 2 / len(y) + 1)
    w, c, v, d, t = np.zeros(b.shape[1]), 0.0, np.zeros(b.shape[1]), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(b @ v + d))) - y
        new = v - step * (b.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_c = d - step * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, d = new + (t - 1) / t2 * (new - w), new_c + (t - 1) / t2 * (new_c - c)
        w, c, t = new, new_c, t2
    w = w / scale
    return float(c - mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    if not len(y) or y.min() == y.max():
        return RuleModel(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), ())
    rules = candidate_rules(x, y)
    if not rules:
        return RuleModel(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), ())
    a = np.column_stack([applies(r, x) for r in rules]).astype(np.float64)
    intercept, w = lasso_logistic(a, y, penalty)
    kept = tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4)
    return RuleModel(intercept, kept)


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> RuleModel:
    """A model from labelled rows for which `train` holds."""
    got = statistics(labelled(docs, labels, "quality", train, max_rows)).select("row.y", "stats").collect()
    table = np.array(sorted((r["y"], *r["stats"]) for r in got), float).reshape(-1, 1 + len(STATS))  # in one order on every run
    return fit_rules(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the quality of every whole text."""
    plain = Plain(docs, [out], [text])
    return plain.back(statistics(plain.docs, plain(text)).select("row.*", model.column().alias(out)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fold 1 of 3 is held out; all texts are scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"), 3, 1))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
