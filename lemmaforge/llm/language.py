"""Language identification by rank-order profiles.

A text's words, runs of letters and their marks in lower case, are padded by a boundary at both ends; its n-grams are all runs of
1 to 3 of these characters that do not cross a boundary. A profile lists the most frequent ones by rank, ties by code
points. A language's profile comes from all its training texts; a document is compared to each by its out-of-place distance: for
every n-gram of its own profile how far its rank lies from its rank there, or the profile's full length where the
language lacks it. The nearest language wins, of equally near ones the least.

Every n-gram is one number, its three code points in 63 bits, so counting is exact and runs on arrays. Learning counts every
training text, in partial sums by (language, n-gram); profiles are cut from the sums by a ranking in Spark. Scoring is one scan of
the texts with the profiles of up to LANGS_AT_ONCE languages in a task; more languages take more scans, each against the best
of those before.

The score is the margin (d2 - d1) / d2 of the best over the second best distance, and 1 where only one language is known.

Defined cases: null text, and text without a letter, is `und` with score 0; so is every text where nothing was learned; a
language without n-grams in its training texts is not learned; null languages are not learned from; null ids are; repeated rows
count each; extra columns pass through untouched, those with an output's name are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lemmaforge.llm.columns import Plain
from lemmaforge.llm.quality import held_out
from lemmaforge.operators.ordinals import numbered
from lemmaforge.session import cut, workers_see_package

LENGTH = 400  # n-grams of a profile
LANGS_AT_ONCE = 200
HELD = 1_000_000  # sums that a task holds
SLICE = 1 << 20  # characters whose n-grams are held at once
EDGE = 0x5F
UNKNOWN = "und"


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark, 0 for all else."""
    of = {"L": 2, "M": 1}
    return np.array([of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def characters(text: str | None) -> tuple[np.ndarray, bool]:
    """The padded words of a text in one array, with single boundaries between them, and whether it has a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    inside = kinds > 0
    if not (kinds == 2).any():
        return np.zeros(0, np.uint32), False
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # a word's first boundary behind it
    body = np.where(inside, codes, np.uint32(EDGE))[kept]
    ends = [] if body[-1] == EDGE else [EDGE]
    return np.concatenate(([EDGE], body, ends)).astype(np.uint32), True


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def gram_counts(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of padded words as sorted numbers, and how often each occurs."""
    parts = []
    for at in range(0, len(row), SLICE):
        c = row[at : at + SLICE + 2].astype(np.int64)
        own = min(SLICE, len(row) - at)  # n-grams that begin in this slice
        one = c[:own]
        two = (c[:-1] << 21 | c[1:])[:own]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:own]
        keys = np.concatenate((one[one != EDGE], two, three[c[1:-1][:own] != EDGE]))
        parts.append(np.unique(keys, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _summed(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]))


def profile(row: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams of padded words, in order of rank."""
    keys, n = gram_counts(row)
    return keys[np.argsort(-n, kind="stable")[:length]]


def language_counts(texts: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, gram, n) of (lang, text): partial sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, parts = whole.slice(at, 256), {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    parts.setdefault(lang, []).append(gram_counts(characters(text.as_py())[0]))
                for lang, found in parts.items():
                    found += [sums[lang]] if lang in sums else []
                    sums[lang] = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                if sum(len(k) for k, _ in sums.values()) > held:
                    yield from passed(sums)
                    sums = {}
        yield from passed(sums)

    def passed(sums: dict) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return texts.select("lang", "text").mapInArrow(scan, "lang string, gram long, n long")


def fit(docs: DataFrame, train: F.Column, lang: str = "lang", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(lang, gram, rank), stored: the profiles of all languages, from rows for which `train` holds; ranks from 0."""
    workers_see_package(docs.sparkSession)
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = language_counts(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return cut(sums.withColumn("rank", rank).filter(F.col("rank") < length).select("lang", "gram", "rank"), "profiles")


class Profiles:
    """Ranks of n-grams in several languages, -1 where one lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int) -> None:
        self.length, self.langs = length, sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        place = np.searchsorted(self.grams, np.array([r[1] for r in rows], np.int64))
        self.ranks[place, [at[r[0]] for r in rows]] = [r[2] for r in rows]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to each language."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        met = self.grams[at] == own
        ranks = self.ranks[at[met]]
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.flatnonzero(met)[:, None]))
        return apart.sum(0, dtype=np.int64) + self.length * int((~met).sum())


def _compared(rows: DataFrame, text: str, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Columns `keep` of `rows`, and id_lang, id_first and id_second: the nearest language so far, its distance and the next one's."""
    shared = rows.sparkSession.sparkContext.broadcast(profiles)
    state = [("id_lang", pa.string()), ("id_first", pa.int64()), ("id_second", pa.int64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                before = zip(*(batch.column(c).to_pylist() for c, _ in state), strict=True) if "id_lang" in batch.schema.names else [(None, None, None)] * batch.num_rows
                now = []
                for value, (lang, first, second) in zip(batch.column(text), before, strict=True):
                    row, has = characters(value.as_py())
                    if has:
                        own = profile(row, known.length)
                        d = known.distances(own)
                        best = int(d.argmin())  # the first of equals
                        others = [x for x in (int(np.delete(d, best).min()) if len(d) > 1 else None, first, second) if x is not None]
                        mine = (known.langs[best], int(d[best]))
                        if first is not None and (first, lang) <= (mine[1], mine[0]):
                            others = sorted([*d.tolist(), *([second] if second is not None else [])])
                            mine = (lang, first)
                        lang, first, second = *mine, min(others, default=None)
                    now.append((lang, first, second))
                arrays = [pa.array([x[i] for x in now], kind) for i, (_, kind) in enumerate(state)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, *(c for c, _ in state)])

    fields = [rows.schema[c] for c in keep] + [T.StructField("id_lang", T.StringType()), T.StructField("id_first", T.LongType()), T.StructField("id_second", T.LongType())]
    return rows.mapInArrow(scan, T.StructType(fields))


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", length: int = LENGTH, langs_at_once: int = LANGS_AT_ONCE, keep_text: bool = True) -> DataFrame:
    """`docs` with lang_pred and score; without the text if it isn't to be kept, so that texts don't come back from the workers."""
    plain = Plain(docs, ["lang_pred", "score"], [text])
    t, columns = plain(text), plain.docs.columns
    kept = [c for c in columns if keep_text or c != t]
    blocks = cut(numbered(profiles.select("lang").distinct(), [F.col("lang")], "place", "languages").withColumn("block", F.expr(f"place div {langs_at_once}")), "language-blocks")
    n = (blocks.agg(F.max("block").alias("b")).first()["b"] or 0) + 1
    rows = plain.docs
    for b in range(n):
        own = profiles.join(F.broadcast(blocks.filter(F.col("block") == b).select("lang")), "lang").collect()  # langs_at_once profiles at most
        if not own:
            rows = rows.select(*kept, *[F.lit(None).cast(k).alias(c) for c, k in (("id_lang", "string"), ("id_first", "long"), ("id_second", "long"))])
            break
        carried = kept if b == n - 1 else columns
        rows = _compared(rows, t, Profiles([(r["lang"], r["gram"], r["rank"]) for r in own], length), carried)
    first, second = F.col("id_first"), F.col("id_second")
    score = F.when(first.isNull(), 0.0).when(second.isNull(), 1.0).when(second > 0, (second - first) / second).otherwise(0.0)
    done = rows.select(*kept, F.coalesce("id_lang", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
    if not keep_text:
        plain.names.remove(text)
    return plain.back(done)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fold 2 of 4 is held out; all texts are identified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    found = identify(docs.select("doc_id", "text"), profiles, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
