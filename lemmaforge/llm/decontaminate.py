"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of digits, a-z and everything beyond ASCII, after A-Z is lower-cased. A window is `n` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. Executors hold the windows as a
hash set over benchmark-word numbers, slide over the training words, look up only windows all of whose words occur
in the benchmark, and compare the exact word numbers, so a hit is never a hash collision. Nothing is shuffled.

The set is broadcast only while the benchmark's texts hold at most `max_broadcast_words` words and 16 bytes for each of these,
both counted by Spark: 250,000 words take some 110 MB in each Python worker. A larger one goes another way: training windows
are keyed by two 64-bit hashes and joined to the benchmark windows by a shuffle.

Defined cases: null or empty text has no words and no hits; an item without words has no window; repeated items
count each by its id; a null item id is shown as an empty string; extra columns pass through untouched, one with the
output's name is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.llm.columns import Plain
from lemmaforge.session import workers_see_package

N_WORDS = 13
MAX_BROADCAST_WORDS = 250_000
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPARK_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def words_of(raw: bytes | None) -> list[bytes]:
    """Normalised words of UTF-8 text."""
    return (raw or b"").translate(_FOLD).split()


class NgramSet:
    """Benchmark windows over word numbers; 0 stands for every word the benchmark lacks."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        grams: dict[int, dict[bytes, set[str]]] = {}
        for item, words in items:
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                grams.setdefault(size, {}).setdefault(ids[i : i + size].tobytes(), set()).add(item)
        self.grams = {size: {k: tuple(v) for k, v in found.items()} for size, found in grams.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        edges, items = np.zeros(len(words) + 1, np.int32), set()
        for size, grams in self.grams.items():
            if len(words) < size:
                continue
            for i in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                found = grams.get(ids[i : i + size].tobytes())
                if found:
                    edges[i] += 1
                    edges[i + size] -= 1
                    items.update(found)
        return np.cumsum(edges[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code-point spans of runs of hit words, from the first word's start to the last one's end."""
    places = [m.span() for m in _WORD.finditer(text)]
    starts = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8)))) == 1)
    ends = np.flatnonzero(np.diff(np.concatenate((hit.astype(np.int8), [0]))) == -1)
    return [{"start": places[a][0], "end": places[b][1]} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _with_struct(batch: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, name])


_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Benchmark rows as (item string, text)."""
    return benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N_WORDS, out: str = "hits",
    max_broadcast_words: int = MAX_BROADCAST_WORDS,
) -> DataFrame:
    """`docs` with a struct `out`: n_words, n_hit, items (sorted) and the code-point spans of hit words."""
    workers_see_package(docs.sparkSession)
    plain = Plain(docs, [out], [text])
    return plain.back(_contamination(plain.docs, benchmark, plain(text), n, out, max_broadcast_words))


def _contamination(docs: DataFrame, benchmark: DataFrame, text: str, n: int, out: str, max_broadcast_words: int) -> DataFrame:
    items = benchmark_items(benchmark)
    size = items.agg(F.sum(F.regexp_count("body", F.lit(SPARK_WORD))).alias("words"), F.sum(F.octet_length("body")).alias("bytes")).first()
    if (size["words"] or 0) > max_broadcast_words or (size["bytes"] or 0) > 16 * max_broadcast_words:
        return _by_join(docs, items, text, n, out)
    grams = NgramSet([(r["item"], words_of(r["body"].encode())) for r in items.toLocalIterator()], n)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = []
                for raw in batch.column(text).cast(pa.binary()).to_pylist():
                    words = words_of(raw)
                    hit, got = known.scan(words)
                    n_hit = int(hit.sum())
                    found.append({"n_words": len(words), "n_hit": n_hit, "items": sorted(got), "spans": _spans(raw.decode(), hit) if n_hit else []})
                yield _with_struct(batch, out, found, _ARROW)

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, HITS)]))


def _keys(words: list[bytes], size: int) -> list[tuple[int, int]]:
    return [((d := xxhash.xxh3_128_intdigest(b" ".join(words[i : i + size]))) >> 65, d & (1 << 63) - 1) for i in range(len(words) - size + 1)]


def _by_join(docs: DataFrame, items: DataFrame, text: str, n: int, out: str) -> DataFrame:
    """The same result by a shuffle of windows, for a benchmark too large to broadcast."""
    key = "size long, a long, b long"

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = words_of(body.encode())
                size = min(n, len(words))
                rows += [(item, size, *k) for k in set(_keys(words, size))] if words else []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), *[pa.int64()] * 3), strict=True)], names=["item", "size", "a", "b"])

    grams = items.mapInArrow(item_grams, f"item string, {key}")
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most n values
    keyed = docs.select(F.col(text).alias("body")).withColumn("dc_doc", F.sha2(F.coalesce("body", F.lit("")), 256)).dropDuplicates(["dc_doc"])

    def doc_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = []
                for doc, raw in zip(batch.column("dc_doc").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist(), strict=True):
                    words = words_of(raw)
                    rows += [(doc, i, s, *k) for s in sizes for i, k in enumerate(_keys(words, s))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["dc_doc", "pos", "size", "a", "b"])

    found = keyed.mapInArrow(doc_grams, f"dc_doc string, pos long, {key}").join(grams, ["size", "a", "b"])
    by_doc = found.groupBy("dc_doc").agg(F.collect_set(F.struct("pos", "size")).alias("dc_at"), F.array_sort(F.collect_set("item")).alias("dc_got"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = []
                for raw, at, got in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("dc_at").to_pylist(), batch.column("dc_got").to_pylist(), strict=True):
                    words = words_of(raw)
                    edges = np.zeros(len(words) + 1, np.int32)
                    for x in at or []:
                        edges[x["pos"]] += 1
                        edges[x["pos"] + x["size"]] -= 1
                    hit = np.cumsum(edges[:-1]) > 0
                    n_hit = int(hit.sum())
                    found.append({"n_words": len(words), "n_hit": n_hit, "items": got or [], "spans": _spans(raw.decode(), hit) if n_hit else []})
                keep = batch.select([c for c in batch.schema.names if c not in ("dc_at", "dc_got")])
                yield _with_struct(keep, out, found, _ARROW)

    joined = docs.withColumn("dc_doc", F.sha2(F.coalesce(text, F.lit("")), 256)).join(by_doc, "dc_doc", "left").select(*docs.columns, "dc_at", "dc_got")
    return joined.mapInArrow(fold, T.StructType([*docs.schema.fields, T.StructField(out, HITS)]))


def is_contaminated(hits: str = "hits", share: int = 20) -> F.Column:
    """At least one word in `share` is hit."""
    h = F.col(hits)
    return (h["n_hit"] > 0) & (h["n_hit"] * share >= h["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N_WORDS, remove: str = "documents", share: int = 20) -> DataFrame:
    """`docs` without contamination: remove "documents" that are contaminated, or cut all hit "spans" out of the texts."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    plain = Plain(docs, [], [text])
    docs, text = plain.docs, plain(text)
    scored = contamination(docs, benchmark, text, n, "dc_hits")
    if remove == "documents":
        return plain.back(scored.filter(~is_contaminated("dc_hits", share)).select(*docs.columns))
    t = F.col(text)
    kept = F.aggregate(
        F.col("dc_hits.spans"),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["s"], t.substr(acc["at"] + 1, x["start"] - acc["at"])).alias("s"), x["end"].alias("at")),
        lambda acc: F.concat(acc["s"], t.substr(acc["at"] + 1, F.length(t) - acc["at"])),
    )
    cut = F.when(F.size("dc_hits.spans") > 0, kept).otherwise(t)
    return plain.back(scored.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns]))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scored.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN g USING (k, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(l), ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
