"""Importance resampling towards a target distribution, on hashed n-grams.

A text's features are its runs of 1 to n consecutive words. One scan keeps a ring of running zlib states, one for each of the
last n starts; a new word extends every state by a space and itself and opens a state of its own, so no n-gram is ever
built, and each state's bucket is emitted as it passes. The buckets are stored once, as bits of a few bytes a feature; both the
corpus counts and the weights read them, not the texts again.

A bucket's gain is the log ratio of its smoothed shares in target and corpus; a document's weight is its mean gain. Gumbel
noise drawn from a hash of the id is added, so the highest scores are a sample without replacement, the same one on
every run. The cut is found in a histogram: scores are whole numbers between about -47,000 and 67,000 (gains are logs of ratios
of 64-bit counts), so it has at most some 115,000 rows. Only documents above the cut are put in order, by ranges.

Words are runs of digits, a-z and everything beyond ASCII, after A-Z is lower-cased.

Defined cases: null and empty texts have no features, weight 0 and a score of noise alone; a null id counts as an empty
one and stands behind others of the same score; repeated rows count each and draw the same noise; an empty target
or corpus has counts of 0; with no document of `min_words` words nothing is drawn; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm.decontaminate import _FOLD
from lemmaforge.operators.ordinals import numbered
from lemmaforge.session import cut, release, workers_see_package

N = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE = 1 << 20  # bytes of a text whose words are held at once


def words_in_slices(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, about SLICE bytes of it at a time."""
    folded, at = (raw or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Ring:
    """zlib states of the last n starts."""

    def __init__(self, n: int, buckets: int) -> None:
        self.n, self.buckets, self.states = n, buckets, []

    def extended(self, words: list[bytes]) -> np.ndarray:
        """The buckets of all runs that end in these words."""
        if self.n == 1:
            return np.fromiter(map(crc32, words), np.uint32, len(words)) % self.buckets
        found: list[int] = []
        for w in words:
            spaced = b" " + w
            self.states = [crc32(spaced, s) for s in self.states[max(0, len(self.states) - self.n + 1) :]]
            self.states.append(crc32(w))
            found += self.states
        return np.array(found, np.uint32) % self.buckets


def bucketed(texts: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """`texts` without the text, with n_words and the array of its features' buckets."""
    workers_see_package(texts.sparkSession)
    kept = [c for c in texts.columns if c != text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n_words, sizes, parts = [], [0], [np.zeros(0, np.uint32)]
                for raw in batch.column(text):
                    ring, words, size = Ring(n, buckets), 0, 0
                    for piece in words_in_slices(raw.as_py()):
                        parts.append(ring.extended(piece))
                        words, size = words + len(piece), size + len(parts[-1])
                    n_words.append(words)
                    sizes.append(size)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n_words, pa.int64()), lists], names=[*kept, "n_words", "buckets"])

    schema = ", ".join([f"`{c}` {kind}" for c, kind in texts.dtypes if c != text] + ["n_words long", "buckets array<int>"])
    return texts.withColumn(text, F.col(text).cast("binary")).mapInArrow(scan, schema)


def bucket_counts(rows: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket: at most `buckets` rows come to the driver."""
    found = [0] * buckets
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        found[r["b"]] = r["count"]
    return found


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, bucket by bucket."""
    k, s, t = len(corpus), sum(corpus), sum(target)
    top, low = float(s + k), float(t + k)
    return np.array([math.floor(1000 * math.log((y + 1) * top / ((x + 1) * low))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of bucketed rows: the floored mean gain of their features."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            at = np.asarray(lists.offsets).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(gain[np.asarray(lists.values)[at[0] : at[-1]]])))
            size, at = np.diff(at), at - at[0]
            weight = np.where(size > 0, (upto[at[1:]] - upto[at[:-1]]) // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(size), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "buckets").mapInArrow(mean, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel variable g that the hash of seed and id gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N,
    buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    Drawn are floor(percent N / 100) of the N documents with at least `min_words` words.
    """
    own = cut(bucketed(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", n, buckets), "buckets")
    aim = bucketed(target.select(F.col(target_text).alias("text")), "text", n, buckets)
    gain = gains(bucket_counts(own, buckets), bucket_counts(aim, buckets))
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = cut(weighted(own, gain).select("doc_id", "n_features", "weight", score, (F.col("n_words") >= min_words).alias("able")), "scored")
    release(own)
    by_score = sorted(((r["score"], r["count"]) for r in scored.filter("able").groupBy("score").count().collect()), reverse=True)  # see above
    drawn = percent * sum(c for _, c in by_score) // 100
    lowest, seen = None, 0
    for value, c in by_score:
        if seen >= drawn:
            break
        lowest, seen = value, seen + c
    columns = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = F.col("able") & (F.col("score") >= lowest)
    placed = numbered(scored.filter(above).select(*columns).withColumn("row", F.monotonically_increasing_id()), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], "place", "drawn")
    ranked = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(~above).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: `documents` towards `benchmark`."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH tb AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(CAST(range(8) AS BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
df AS (SELECT row, unnest(w) AS f FROM d),
bf AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
f AS (SELECT f, hex(f) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
h AS (SELECT f, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM f, tb),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM df) + 10000 AS DOUBLE) / ((s + 1) * CAST((SELECT count(*) FROM bf) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY row),
e AS (SELECT row, d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS words,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (row)
"""
