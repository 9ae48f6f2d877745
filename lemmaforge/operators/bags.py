"""Sparse token bags: (item, term, tf) rows, their statistics, and scores as joins on terms.

A bag is never made dense. Scores come from joins on the term, summed by pair, so only pairs that share a term exist.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions.text import word_tokens
from lemmaforge.operators import index
from lemmaforge.session import cut, workers_see_package

EPS = 1e-12
K1, B = 1.2, 0.75
ENCODER_LENGTH = 100.0
PRIME = 30011
CHUNK = 256
WIDTH = 2048  # of signatures and projections
COLUMNS = 128  # of tables by term number, which a task holds at once
PROJECTED_BITS = 15  # more than PRIME has


def bags_by_item(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, dl (tokens of the item), terms and tfs: a row an item, counted where the item is read, without a shuffle."""
    workers_see_package(items.sparkSession)
    words = items.select(F.col(item).alias("item"), word_tokens(F.col(text)).alias("w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                lists = batch.column("w")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(size)), size)
                keys, tf = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                own, code = np.divmod(keys, max(1, len(coded.dictionary)))
                offsets = pa.array(np.searchsorted(own, np.arange(len(size) + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(code)))
                yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(size), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=["item", "dl", "terms", "tfs"])

    return words.mapInArrow(count, f"item {dict(words.dtypes)['item']}, dl long, terms array<string>, tfs array<bigint>")


def bag(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, dl, term, tf: a row a term of each item. Rows that share an id are items of their own."""
    both = bags_by_item(items, item, text).select("item", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return both.select("item", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def corpus_stats(items: DataFrame, text: str) -> DataFrame:
    """One row: n documents (empty ones count), avgdl and vocabulary size."""
    words = items.select(F.size(word_tokens(F.col(text))).alias("dl"))
    vocabulary = items.select(F.explode(word_tokens(F.col(text))).alias("w")).agg(F.count_distinct("w").alias("vocabulary"))
    return words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(vocabulary)  # one row each


def document_frequencies(bags: DataFrame) -> DataFrame:
    return bags.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n.cast("double") - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, docs: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, item, score) for pairs that share a term. A query's terms count once. stats: one row with n and avgdl.

    Documents' rows are cut down to query terms first; frequencies are counted on what is left.
    """
    terms = queries.select(F.col("item").alias("q"), "term").distinct()
    met = docs.join(terms.select("term").distinct(), "term", "left_semi")
    weighted = met.join(document_frequencies(met), "term").crossJoin(F.broadcast(stats.select("n", "avgdl")))  # one row
    tf = F.col("tf").cast("double")
    part = idf(F.col("n"), F.col("df")) * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return terms.join(weighted.select("term", "item", part.alias("part")), "term").groupBy("q", "item").agg(F.sum("part").alias("score"))


def cosine(queries: DataFrame, docs: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(q, item, score): cosine of count bags, eps added to each norm."""
    length = lambda x, name: x.groupBy("item").agg((F.sqrt(F.sum(F.col("tf") * F.col("tf"))) + eps).alias(name))
    a = queries.select(F.col("item").alias("q"), "term", F.col("tf").alias("qf"))
    dots = a.join(docs.select("item", "term", "tf"), "term").groupBy("q", "item").agg(F.sum(F.col("qf") * F.col("tf")).alias("dot"))
    return dots.join(length(queries, "qn").withColumnRenamed("item", "q"), "q").join(length(docs, "dn"), "item").select("q", "item", (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("score"))


def overlaps(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, item, both, qs, ds): shared terms and the sizes of the two sets."""
    size = lambda x, name: x.groupBy("item").agg(F.count("*").alias(name))
    a = queries.select(F.col("item").alias("q"), "term")
    both = a.join(docs.select("item", "term"), "term").groupBy("q", "item").agg(F.count("*").alias("both"))
    return both.join(size(queries, "qs").withColumnRenamed("item", "q"), "q").join(size(docs, "ds"), "item")


def jaccard(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, item, score): shared over all terms of the two sets."""
    o = overlaps(queries, docs)
    return o.select("q", "item", (F.col("both") / (F.col("qs") + F.col("ds") - F.col("both") + EPS)).alias("score"))


def binary_cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, item, score): shared terms over the geometric mean of the sizes, the Jaccard encoder without projection."""
    o = overlaps(queries, docs)
    return o.select("q", "item", (F.col("both") / F.sqrt(F.col("qs").cast("double") * F.col("ds"))).alias("score"))


def binary_weights(bags: DataFrame) -> DataFrame:
    """(item, term, w): every term of an item once, scaled to unit length."""
    size = bags.groupBy("item").agg((1.0 / F.sqrt(F.count("*").cast("double"))).alias("w"))
    return bags.join(size, "item").select("item", "term", "w")


def encoder_weights(bags: DataFrame, k1: float = K1, b: float = B, avgdl: float = ENCODER_LENGTH) -> DataFrame:
    """(item, term, w): BM25 encoder without idf, the norm at least 0.5, shifted by 1e-10 and scaled to unit length."""
    tf = F.col("tf").cast("double")
    norm = F.greatest(F.lit(0.5), 1.0 - b + b * F.col("dl") / avgdl)
    raw = bags.select("item", "term", (tf * (k1 + 1.0) / (tf + k1 * norm) + 1e-10).alias("w"))
    size = raw.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "item").select("item", "term", (F.col("w") / F.col("size")).alias("w"))


def encoder_cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    a = encoder_weights(queries).select(F.col("item").alias("q"), "term", F.col("w").alias("qw"))
    return a.join(encoder_weights(docs), "term").groupBy("q", "item").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def _weighted(bags: DataFrame, raw: Callable[[Column, Column], Column], unit: float | None) -> DataFrame:
    """(item, bag): structs of term and weight; raw weights from tf and dl, over their length plus `unit` where that is given."""
    rows = bags.select("item", "dl", "terms", F.transform("tfs", lambda tf: raw(tf.cast("double"), F.col("dl"))).alias("ws"))
    if unit is not None:  # the length as an element, so that it is computed once a bag
        size = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda s, w: s + w * w)) + unit
        rows = rows.withColumn("ws", F.transform(F.array(size), lambda n: F.transform("ws", lambda w: w / n))[0])
    return rows.select("item", F.transform(F.arrays_zip("terms", "ws"), lambda x: F.struct(x["terms"].alias("term"), x["ws"].alias("w"))).alias("bag"))


def count_bags(bags: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Bags for the cosine of counts."""
    return _weighted(bags, lambda tf, dl: tf, eps)


def binary_bags(bags: DataFrame) -> DataFrame:
    """Bags for the cosine of sets."""
    return _weighted(bags, lambda tf, dl: F.lit(1.0), 0.0)


def encoder_bags(bags: DataFrame, k1: float = K1, b: float = B, avgdl: float = ENCODER_LENGTH) -> DataFrame:
    """Bags for the BM25 encoder: no idf, the norm at least 0.5, shifted by 1e-10 and scaled to unit length."""
    return _weighted(bags, lambda tf, dl: tf * (k1 + 1.0) / (tf + k1 * F.greatest(F.lit(0.5), 1.0 - b + b * dl / avgdl)) + 1e-10, 0.0)


def bm25_bags(bags: DataFrame, avgdl: float, k1: float = K1, b: float = B) -> DataFrame:
    """Bags for BM25, without idf."""
    return _weighted(bags, lambda tf, dl: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl)), None)


def query_terms(weighted: DataFrame) -> DataFrame:
    return weighted.select(F.col("item").alias("q"), F.explode("bag").alias("x")).select("q", F.col("x.term").alias("term"), F.col("x.w").alias("qw"))


def jaccard_of_cosine(dot: Column, a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets from the cosine of their binary bags, which is never smaller, and their sizes."""
    both = F.round(dot * F.sqrt(a.cast("double") * b.cast("double")))
    return both / (a + b - both + EPS)


def best_documents(queries: DataFrame, weighted: DataFrame, k: int, as_jaccard: bool = False, max_terms: int = index.MAX_BROADCAST_TERMS) -> DataFrame:
    """(q, item, score, rk): of documents (item, bag) that share a term with a query (q, term, qw) the k best, by score rounded to six
    digits and then by id. `as_jaccard` takes cosines of binary bags for likenesses of sets.

    Up to `max_terms` terms of queries are given to the tasks, which sum scores where a document lies and pass on their own k
    best of each query; so nothing is keyed by a term, and no pairs are shuffled. More terms go through an index.
    """
    sized = queries.withColumn("query_size", F.count("*").over(Window.partitionBy("q")))
    if sized.limit(max_terms + 1).count() > max_terms:
        return index.best(index.build(weighted, weighted.count()), queries, k, jaccard_of_cosine if as_jaccard else lambda dot, a, b: dot)
    workers_see_package(queries.sparkSession)
    found = sorted(map(tuple, sized.select("q", "query_size", "term", "qw").collect()))  # max_terms at most
    names = sorted({r[0] for r in found})
    place, by_term = {q: i for i, q in enumerate(names)}, {}
    for q, _, term, qw in found:
        by_term.setdefault(term, ([], []))[0].append(place[q])
        by_term[term][1].append(qw)
    own_size = np.array([n for _, n in sorted({r[0]: r[1] for r in found}.items())], np.int64)
    known = queries.sparkSession.sparkContext.broadcast({t: (np.array(q), np.array(w)) for t, (q, w) in by_term.items()})
    kind = dict(weighted.dtypes)["item"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, object]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                lists = batch.column("terms")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded, ws = lists.flatten().dictionary_encode(), batch.column("ws").flatten().to_numpy(zero_copy_only=False)
                met = [known.value.get(t) for t in coded.dictionary.to_pylist()]
                count = np.array([len(m[0]) if m else 0 for m in met], np.int64)
                code, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
                use = np.flatnonzero(count[code]) if len(code) else np.zeros(0, np.int64)
                if not len(use):
                    continue
                q = np.concatenate([met[c][0] for c in code[use]])
                part = np.concatenate([met[c][1] for c in code[use]]) * np.repeat(ws[use], count[code[use]])
                keys, inverse = np.unique(q * len(size) + np.repeat(row[use], count[code[use]]), return_inverse=True)
                dots, (own, doc) = np.bincount(inverse, part), np.divmod(keys, len(size))
                ids = batch.column("item").to_pylist()
                if as_jaccard:
                    both = np.round(dots * np.sqrt(own_size[own].astype(float) * size[doc]))
                    values = both / (own_size[own] + size[doc] - both + EPS)
                else:
                    values = dots
                values = np.round(values, 6)
                first = np.searchsorted(own, np.arange(len(names) + 1))
                for i in np.flatnonzero(np.diff(first)).tolist():
                    a, b = first[i], first[i + 1]
                    rows = best.get(i, []) + [(-v, ids[d]) for v, d in zip(values[a:b].tolist(), doc[a:b].tolist(), strict=True)]
                    best[i] = heapq.nsmallest(k, rows)
        rows = [(names[i], x[1], -x[0]) for i, held in best.items() for x in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], q_type), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.float64())], names=["q", "item", "score"])

    q_kind = dict(queries.dtypes)["q"]
    q_type, item_type = (pa.int64() if x == "bigint" else pa.int32() if x == "int" else pa.string() for x in (q_kind, kind))
    flat = weighted.select("item", F.col("bag.term").alias("terms"), F.col("bag.w").alias("ws"))
    tops = flat.mapInArrow(scan, f"q {q_kind}, item {kind}, score double")
    rk = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item"))
    return tops.withColumn("rk", rk.cast("long")).filter(F.col("rk") <= k)


def best_by_cosine(queries: DataFrame, docs: DataFrame, k: int, weigh: Callable[[DataFrame], DataFrame] = count_bags) -> DataFrame:
    """(q, item, score, rk): the k documents with the greatest cosine for each query; both sides are bags by item."""
    return best_documents(query_terms(weigh(queries)), weigh(docs), k)


def best_by_jaccard(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return best_documents(query_terms(binary_bags(queries)), binary_bags(docs), k, True)


def bm25_terms(queries: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """(q, term, qw): a query's terms, each once, with their idf."""
    once = query_terms(_weighted(queries, lambda tf, dl: F.lit(1.0), None))
    return once.join(frequencies, "term").select("q", "term", idf(F.lit(documents), F.col("df")).alias("qw"))


def best_by_bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The same by BM25, from stored bags. Frequencies are counted for the queries' terms only."""
    size = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    small = terms.limit(index.MAX_BROADCAST_TERMS + 1).count() <= index.MAX_BROADCAST_TERMS
    df = docs.select(F.explode("terms").alias("term")).join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = cut(bm25_terms(queries, df, size["n"]), "query-terms")  # documents are counted once
    return best_documents(weighted, bm25_bags(docs, size["avgdl"] or 1.0), k)


def next_prime(n: int) -> int:
    """Least prime that is not less than n."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def hash_functions(count: int, prime: int = PRIME) -> list[tuple[int, int]]:
    """Multipliers and offsets of `count` hash functions, by rule."""
    return [(1 + 7919 * (i + 1) % (prime - 1), 104729 * (i + 1) % prime) for i in range(count)]


def term_number(term: Column, prime: int = PRIME) -> Column:
    """A term's number, alike in every engine: the first 24 bits of its MD5, modulo the prime."""
    return F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("long") % prime


def number_of(term: str, prime: int = PRIME) -> int:
    """The same number, in a task."""
    return int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % prime


def _by_number(bags: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray], table: Callable[[np.ndarray, slice], np.ndarray], width: int, field: str, kind: str, weights: bool) -> DataFrame:
    """(item, `field`) of bags with terms: values(rows of `table` by the item's term numbers, weights). `table` has a row for
    each number and `width` columns; COLUMNS of them are made at once for the different terms of some CHUNK items."""
    stored = {"int": pa.int32(), "double": pa.float64()}[kind]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                coded = batch.column("terms").flatten().dictionary_encode()
                numbers = np.array([number_of(t) for t in coded.dictionary.to_pylist()], np.int64)
                different, row = np.unique(numbers, return_inverse=True)
                code = row[coded.indices.to_numpy(zero_copy_only=False)]
                ws = batch.column("ws").flatten().to_numpy(zero_copy_only=False) if weights else np.zeros(len(code))
                ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
                begins = np.concatenate(([0], ends[:-1]))
                found = np.empty((len(ends), width), stored.to_pandas_dtype())
                for first in range(0, width, COLUMNS):
                    part = slice(first, first + COLUMNS)
                    rows = table(different, part)
                    for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                        found[i, part] = values(rows[code[begin:end]], ws[begin:end])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel(), stored))
                yield pa.RecordBatch.from_arrays([batch.column("item"), lists], names=["item", field])

    return bags.filter(F.size("terms") > 0).mapInArrow(scan, f"item {dict(bags.dtypes)['item']}, {field} array<{kind}>")


def minhash(bags: DataFrame, count: int = WIDTH, prime: int = PRIME) -> DataFrame:
    """(item, sig) of bags by item: the least hash under each of `count` functions. Items without terms have no row, so no signature.

    The functions' values of a term are computed once for some CHUNK items, and an item takes their minima.
    """
    a, b = (np.array(x, np.int32) for x in zip(*hash_functions(count, prime), strict=True))  # products stay under 2 ** 31
    return _by_number(bags.select("item", "terms"), lambda rows, _: rows.min(0), lambda x, part: ((x.astype(np.int32)[:, None] * a[part] + b[part]) % np.int32(prime)).astype(np.int16), count, "sig", "int", False)


def mixed_rows(dimensions: int, bits: int = PROJECTED_BITS) -> np.ndarray:
    """`dimensions` different rows of the Hadamard matrix, by a bijection of `bits`-bit numbers."""
    d = np.arange(dimensions, dtype=np.int64)
    d = (d ^ (d >> 7)) * 11291 % (1 << bits)
    return d ^ (d >> 9)


def signs(number: np.ndarray) -> np.ndarray:
    return np.array([1 - 2 * (int(hashlib.md5(str(x).encode()).hexdigest()[0], 16) & 1) for x in number.tolist()], np.int8)


def projected(weighted: DataFrame, dimensions: int = WIDTH) -> DataFrame:
    """(item, vec) of weighted bags (item, bag): a random sign for each term number, the Hadamard transform, and `dimensions` of its
    rows, scaled so that inner products are kept on average; two unit vectors' differs by about sqrt(1 / dimensions).

    An entry of the transform is a parity of bits, so no matrix is stored: a bag's few terms are summed.
    """
    rows = mixed_rows(dimensions)

    def table(x: np.ndarray, part: slice) -> np.ndarray:
        parity = np.bitwise_count(x[:, None] & rows[None, part]) & 1
        return (1 - 2 * parity.astype(np.int8)) * signs(x)[:, None]

    flat = weighted.select("item", F.col("bag.term").alias("terms"), F.col("bag.w").alias("ws"))
    return _by_number(flat, lambda t, w: w @ t / math.sqrt(dimensions), table, dimensions, "vec", "double", True)
