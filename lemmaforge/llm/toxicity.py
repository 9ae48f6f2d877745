"""Toxicity by a weighted lexicon, matched in one pass by an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs (Cyrillic, Greek, full width) to Latin letters, digits that stand for
letters to those letters, zero-width marks dropped, punctuation to spaces. A term matches at a word's start; a term
that ends in a space is a whole word, another one a stem. Matches inside an exception phrase do not count: phrases are a
matched word with its neighbour or both of them, learned where they stand in at least LEAST_CLEAN clean training documents
and in no toxic one, or given. A document's
features are the summed weights, the same normalised by its length in words, and the number of different terms; a
logistic curve over them gives the score.

Fitting: terms are words and word beginnings of toxic training documents, kept when they are far more frequent there
than in clean ones; the weight is the log odds ratio. At most `max_rows` labelled documents are used, chosen by a hash
of their id (the only sample; scoring reads every text whole), at most `max_terms` terms and MAX_EXCEPTIONS phrases are kept, so
the lexicon that executors receive has a fixed bound. Stems have 4 to 8 letters (STEMS); a longer word than 24 letters is a stem of its
first 24; the MAX_CANDIDATES most frequent toxic candidates are weighed. These bound the model that is learned, not the
documents that are scored.

Defined cases: null and empty texts match nothing and get the score of a document without matches; without a toxic
training row the lexicon is empty and the score is the share of toxic rows, 0.5 of a row added to each side; null
labels are not used; of repeated labels every row counts; extra columns pass through untouched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.llm.columns import Plain
from lemmaforge.llm.labelled import labelled
from lemmaforge.session import workers_see_package

MAX_ROWS = 20_000
MAX_TERMS = 5_000
MAX_CANDIDATES = 200_000
STEMS = range(4, 9)
LEAST_ODDS = math.log(20)
CONTEXT = 64  # characters on either side in which a neighbour is looked for
LEAST_CLEAN = 2
MAX_EXCEPTIONS = 5_000

# Letters that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "д": "d",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
INNER = {"@": "a", "$": "s", "!": "i"}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for c in [*range(0x250), *range(0x2000, 0x2100), *range(0x3000, 0x3040), *range(0xFF00, 0xFFF0)]:
        kind = unicodedata.category(chr(c))
        if kind == "Cf":
            out[c] = None
        elif kind[0] in "PSZC":
            out[c] = " "
    out |= {c: chr(c - 0xFEE0).lower() for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}
    return out | {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}


_FOLD = _table()
_INNER = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def fold(text: str | None) -> str:
    """Folded text between spaces."""
    text = text or ""
    if "@" in text or "$" in text or "!" in text:
        text = _INNER.sub(lambda m: INNER[m[0]], text)
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """Terms with weights (a whole word ends in a space), exceptions and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(" " + term, (len(term), weight, term))
            for phrase in self.exceptions:
                p = fold(phrase).strip() + " "
                a.add_word(" " + p, (len(p), None, p))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, text: str | None) -> tuple[list[tuple[str, float]], int]:
        """Terms that count, with their weights, and the number of words."""
        folded = fold(text)
        n_words = len(folded.split())
        if not self.weights:
            return [], n_words
        found, safe = [], []
        for end, (size, weight, term) in self.automaton().iter(folded):
            (safe if weight is None else found).append((end - size, end, term, weight))
        if safe:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _, _ in safe)]
        return [(x[2], x[3]) for x in found], n_words

    def features(self, text: str | None) -> tuple[float, float, float]:
        found, n_words = self.matches(text)
        total = sum(w for _, w in found)
        return math.log1p(max(0.0, total)), math.log1p(100.0 * max(0.0, total) / (n_words + 20)), math.log1p(len({t for t, _ in found}))

    def score(self, features: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


    def contexts(self, text: str | None) -> set[str]:
        """Each word in which a term matches with the word before it, the one behind it, and both."""
        folded, out = fold(text), set()
        for end, (size, weight, _) in self.automaton().iter(folded) if self.weights else ():
            if weight is None:
                continue
            start, stop = end - size + 1, folded.find(" ", end - size + 1)
            before, after = folded[max(0, start - CONTEXT) : start].split(), folded[stop : stop + CONTEXT].split()
            word = folded[start:stop]
            left, right = before[-1:], after[:1]
            out.update(" ".join(p) for p in ([*left, word], [word, *right], [*left, word, *right]) if len(p) > 1)
        return out


def terms_of(text: str | None) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) > 2:
            out.add(w[:24] + " " if len(w) <= 24 else w[:24])
            out.update(w[:n] for n in STEMS if n < len(w))
    return out


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """Documents by term, summed within each partition first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for whole in batches:
            for x in whole.column("text"):
                got = terms_of(x.as_py())
                seen.update(got if wanted is None else got & wanted)
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose_terms(positive: dict[str, int], negative: dict[str, int], n_pos: int, n_neg: int, least: int, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """Terms far likelier in toxic documents. Of a chain of beginnings found in the same documents the longest stays;
    what a kept shorter one already matches goes."""
    odds = {t: math.log((n + 0.5) / (n_pos + 1)) - math.log((negative.get(t, 0) + 1) / (n_neg + 2)) for t, n in positive.items() if n >= least}
    good = {t: w for t, w in odds.items() if w >= LEAST_ODDS}
    longest: dict[str, int] = {}
    for t in good:
        for k in range(1, len(t)):
            longest[t[:k]] = max(longest.get(t[:k], 0), positive[t])
    kept: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (len(t), t)):
        if longest.get(t, 0) >= 0.97 * positive[t] or any(t[:k] in kept for k in range(1, len(t))):
            continue
        kept[t] = good[t]
    return dict(sorted(kept.items(), key=lambda x: (-positive[x[0]], x[0]))[:max_terms])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a ridge on all but the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(key: F.Column, folds: int, fold_no: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold_no, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, max_rows: int = MAX_ROWS, exceptions: tuple[str, ...] | None = None) -> Lexicon:
    """Lexicon and curve from labelled rows for which `train` holds. Exception phrases are learned where none are given."""
    workers_see_package(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", train, max_rows).cache()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    least = max(4, math.ceil(0.005 * n_pos))
    positive = {r["term"]: r["n"] for r in _counted(rows.filter("y = 1"), None).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES).collect()}
    wanted = set(positive)
    negative = {r["term"]: r["n"] for r in _counted(rows.filter("y = 0"), wanted).collect()} if wanted else {}  # at most MAX_CANDIDATES terms
    lexicon = Lexicon(choose_terms(positive, negative, n_pos, n_neg, least))
    lexicon = Lexicon(lexicon.weights, learned_exceptions(rows, lexicon) if exceptions is None else exceptions)
    found = _features(rows, lexicon).select("y", "features").collect()  # three numbers for each of max_rows documents
    rows.unpersist()
    x, y = np.array([r["features"] for r in found]).reshape(-1, 3), np.array([r["y"] for r in found], float)
    lexicon.curve = fit_curve(x, y) if n_pos and n_neg and lexicon.weights else (math.log((n_pos + 0.5) / (n_neg + 0.5)), 0.0, 0.0, 0.0)
    return lexicon


def learned_exceptions(rows: DataFrame, lexicon: Lexicon, least: int = LEAST_CLEAN, most: int = MAX_EXCEPTIONS) -> tuple[str, ...]:
    """Phrases around matches in (y, text) that only clean documents have, the most frequent first."""
    if not lexicon.weights:
        return ()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, y) for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True) for p in sorted(lexicon.contexts(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["phrase", "y"])

    sums = rows.select("y", "text").mapInArrow(scan, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    return tuple(r["phrase"] for r in sums.filter((F.col("toxic") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "phrase").limit(most).collect())


def _features(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "features") -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = [lexicon.features(x.as_py()) for x in batch.column(text)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the toxicity of every whole text."""
    c = lexicon.curve
    plain = Plain(docs, [out], [text])
    z = F.lit(c[0]) + F.lit(c[1]) * F.col("tox_features")[0] + F.lit(c[2]) * F.col("tox_features")[1] + F.lit(c[3]) * F.col("tox_features")[2]
    return plain.back(_features(plain.docs, lexicon, plain(text), "tox_features").select(*plain.docs.columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias(out)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fold 0 of 5 is held out; all texts are scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return score(docs, lexicon).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
