"""Document fingerprints from closed syncmers, with built-in functions only.

A text is a sequence of words, lower-cased: runs without white space of at most 16 characters, and every character of
a longer run but its last 16, so that text without white space has anchors over characters. Of every
K consecutive words the S-word substrings are hashed; the K-mer is chosen when its smallest inner hash is the first or
the last one. The choice looks at the K words alone, so the same passage gives the same anchors in any document, and
an edit changes only anchors that overlap it. The fingerprint is every anchor's hash in the order of the text; likeness is
the Jaccard likeness of the whole anchor sets, and `best_offset` compares positions: of the anchors that both texts hold
exactly once, the distance in words on which most agree. `sketch` keeps the SKETCH smallest hashes, for estimates elsewhere.

Defined cases: null text counts as empty, with an empty fingerprint; a text of fewer than
2 K words, which may hold no syncmer, has every word as an anchor; two empty fingerprints are alike to degree 1, an empty and another one to degree 0; rows of one id
follow each other by the 64-bit hash of their text, then by text; null ids come first; an empty table gives no rows.

Finding each document's successor needs no global sort: ids, and the texts of ids that very many rows share, are cut into
ranges, every range also gets the first row of the next one, and a window within a range does the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.operators.ordinals import sampled

K = 5
S = 2
SKETCH = 128
COARSE = 256
RANGES = 4
SAMPLED = 96  # ids for each quantile


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S{1,16}+(?!\S)|\S"), F.lit(0))


def _inner(w: Column) -> Column:
    """Hashes of all S-word substrings; the last S - 1 entries are of fewer words and unused."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, S)]))


def _chosen(s: Column, i: Column) -> Column:
    """The K-mer at word i is a closed syncmer: no inner hash between its edges is smaller than both of them."""
    last = K - S
    middle = F.least(*[F.get(s, i + j) for j in range(1, last)]) if last > 2 else F.get(s, i + 1)
    return F.least(F.get(s, i), F.get(s, i + last)) <= middle


def _hash(s: Column, i: Column) -> Column:
    """32 bits of a K-mer's hash; inner hashes S apart cover all its words."""
    at = sorted({*range(0, K - S + 1, S), K - S})
    return F.xxhash64(*[F.get(s, i + j) for j in at]).bitwiseAND(F.lit(0xFFFFFFFF))


def _one(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(0xFFFFFFFF))


def _starts(w: Column) -> Column:
    return F.sequence(F.lit(0), F.size(w) - K)


def anchors(text: Column) -> Column:
    """All chosen K-mers as an array of structs (hash, position in words)."""

    def of(w: Column) -> Column:
        kmers = _let(_inner(w), lambda s: F.filter(F.transform(_starts(w), lambda i: F.when(_chosen(s, i), F.struct(_hash(s, i).alias("hash"), i.alias("at")))), lambda x: x.isNotNull()))
        return F.when(F.size(w) >= 2 * K, kmers).otherwise(F.transform(w, lambda x, i: F.struct(_one(x).alias("hash"), i.alias("at"))))

    return _let(words(text), of)


def sketch(text: Column) -> Column:
    """The smallest anchor hashes, in order."""

    def of(w: Column) -> Column:
        kmers = _let(_inner(w), lambda s: F.transform(_starts(w), lambda i: F.when(_chosen(s, i), _hash(s, i))))
        chosen = F.when(F.size(w) >= 2 * K, F.array_compact(kmers)).otherwise(F.transform(w, _one))
        return F.slice(F.sort_array(F.array_distinct(chosen)), 1, SKETCH)

    return _let(words(text), of)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches: the shared part of the smallest hashes of their union."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = _let(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared)


def set_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two whole arrays of hashes."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def best_offset(a: Column, b: Column) -> Column:
    """(n, offset): how far apart most of the anchors stand that each text holds once; of equal counts the least offset.

    Both texts' anchors are sorted together as one number each, so equal hashes are neighbours: no pairs are made.
    """

    def packed(x: Column, side: int) -> Column:
        return F.transform(x, lambda y: F.shiftleft(y["hash"], 31) + F.lit(side * 2**30) + y["at"])

    def offsets(u: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            h = F.shiftrightunsigned(x, 31)
            other = lambda k: F.coalesce(F.shiftrightunsigned(F.get(u, i + k), 31) != h, F.lit(True))
            once = other(-1) & ~other(1) & other(2)
            gap = F.get(u, i + 1) - x - F.lit(2**30)
            crossed = (x.bitwiseAND(F.lit(2**30)) == 0) & (F.get(u, i + 1).bitwiseAND(F.lit(2**30)) != 0)
            return F.when(once & crossed, gap)

        return F.sort_array(F.array_compact(F.transform(u, pair)))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["at"] == x, s["run"] + 1).otherwise(F.lit(1).cast("long"))
        more = run > s["n"]
        return F.struct(F.when(more, run).otherwise(s["n"]).alias("n"), F.when(more, x).otherwise(s["offset"]).alias("offset"), run.alias("run"), x.alias("at"))

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("offset"), F.lit(0).cast("long").alias("run"), none.alias("at"))
    both = F.sort_array(F.concat(packed(a, 0), packed(b, 1)))
    return F.aggregate(_let(both, offsets), start, step, lambda s: F.struct(s["n"].alias("n"), s["offset"].alias("offset")))


def matched_offsets(a: Column, b: Column) -> Column:
    """Positional matching: how far apart, in words, equal anchors of two texts stand, most frequent offset first."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: y["at"] - x["at"])))
    counted = F.transform(F.array_distinct(pairs), lambda o: F.struct(F.size(F.filter(pairs, lambda p: p == o)).alias("n"), o.alias("offset")))
    return F.sort_array(counted, asc=False)


def _dealt(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame | None:
    """`docs` with `place`, the hash of the text, and `part`: ranges of (key, place) in order; None for an empty table.

    Keys are cut at quantiles of a sample, whole numbers at any size, which are refined evenly. A key that several quantiles fall on, such as null or a much
    repeated id, is cut by place into as many ranges as its share asks for.
    """
    coarse = min(COARSE, parts)
    fine = math.ceil(parts / coarse)
    sample = sampled(docs, key, SAMPLED * coarse)
    if not sample:
        return None
    quantiles = [sample[min(len(sample) - 1, len(sample) * i // coarse)] for i in range(coarse + 1)]
    cuts = sorted(set(quantiles))
    times = [quantiles.count(c) for c in cuts]
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[1:]]), lambda c: c <= F.col(key))) if len(cuts) > 1 else F.lit(0)
    low = of(cuts, at)
    begin, width = of([float(c) for c in cuts], at), of([max(1.0, float(b) - float(a)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1], strict=True)], at)
    share = F.floor((F.col(key).cast("double") - begin) / width * fine)  # in doubles: null ids are far from others
    part = at.cast("long") * fine + F.greatest(F.lit(0), F.least(share, F.lit(fine - 1)))
    slices = of([n * fine if n > 1 else 0 for n in times], at)
    piece = F.least(slices - 1, F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * slices))
    inside = F.when((slices == 0) | (F.col(key) < low), F.lit(0)).when(F.col(key) == low, piece + 1).otherwise(slices + 1)
    return docs.withColumn("place", F.xxhash64(text)).withColumn("part", part * ((coarse + 1) * fine + 2) + inside)


def with_next(docs: DataFrame, carry: list[str], key: str = "k", text: str = "body") -> DataFrame:
    """`docs` with next_<column> of the row that follows by key, the text's hash and text, the first row after the last one.

    Rows are dealt to ranges of about equal counts, RANGES for each shuffle partition, so that those that meet in one task
    even out; only rows equal in key and text can't be parted.
    """
    spark = docs.sparkSession
    dealt = _dealt(docs, key, text, RANGES * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = dealt.groupBy("part").agg(F.min(F.struct(key, "place")).alias("first")).collect() if dealt else []  # one row a range
    heads = sorted((r["part"], r["first"][0], r["first"][1]) for r in found)
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    before = [(k, p, heads[i - 1][0]) for i, (_, k, p) in enumerate(heads)]
    places = spark.createDataFrame(before, "head long, place long, to long")
    whole = [text, *[c for c in dict.fromkeys(carry) if c != text]]
    of_heads = dealt.filter(F.col(key).isin([k for k, _, _ in before])).join(F.broadcast(places), (F.col(key) == F.col("head")) & (dealt["place"] == places["place"])).drop(places["place"])
    first = of_heads.groupBy(key, "place", "to").agg(F.min(F.struct(*whole)).alias("r"))
    kept = [c for c in docs.columns if c not in (key, *whole)]
    ghosts = first.select(
        F.lit(1).alias("ghost"), F.col("to").alias("part"), F.col(key), "place", *[F.col("r")[c].alias(c) for c in whole], *[F.lit(None).cast(dict(docs.dtypes)[c]).alias(c) for c in kept],
    )
    rows = dealt.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    order = Window.partitionBy("part").orderBy("ghost", key, "place", text)
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).filter("ghost = 0").drop("ghost", "part", "place")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text, its edited text and its successor."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), body.alias("body"))
    paired = with_next(rows, ["body"])
    half = F.floor(F.length("body") / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), F.length("body") - half), F.substring(F.col("next_body"), F.lit(1), half))

    def compared(x: Column) -> Column:
        f, g, h = x["f"], x["g"], x["h"]
        e, n = best_offset(f, g), best_offset(f, h)
        return F.struct(
            as_string(f["hash"]).alias("fingerprint"), as_string(g["hash"]).alias("edited_fingerprint"),
            set_likeness(f["hash"], g["hash"]).alias("near_edited"), set_likeness(f["hash"], h["hash"]).alias("near_next"),
            e.alias("edited_match"), n.alias("next_match"),
        )

    found = _let(F.struct(anchors(F.col("body")).alias("f"), anchors(edited).alias("g"), anchors(F.col("next_body")).alias("h")), compared)
    done = paired.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), found.alias("r"))
    return done.select("doc_id", "n_chars", "edited_sha256", "r.*")
