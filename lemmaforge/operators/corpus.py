"""Papers with ordered statements: flattening, filters, splits, pairs, batches and length statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions.text import md5_key
from lemmaforge.operators.ordinals import numbered, range_cuts

ID = re.compile(r"^(\d+)-(lemma|theorem)-(\d+)$")


def usable(items: Column) -> Column:
    """Strings of an array that are not blank."""
    return F.filter(items, lambda x: x.isNotNull() & x.rlike(r"\S"))


def statements(lemmas: Column, theorems: Column, given: Column | None = None, theorems_first: bool = False) -> Column:
    """One array of structs (type, text): the given one, or lemmas and theorems put together."""
    typed = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("type"), t.alias("text")))
    parts = [typed(lemmas, "lemma"), typed(theorems, "theorem")]
    both = F.concat(*reversed(parts)) if theorems_first else F.concat(*parts)
    return both if given is None else F.coalesce(given, both)


def count_of(items: Column, kind: str) -> Column:
    return F.size(F.filter(items, lambda s: s["type"] == kind))


def items(papers: DataFrame, paper: str = "index") -> DataFrame:
    """(paper, kind, idx, id, text) with ids like 12-lemma-0."""

    def one(kind: str) -> DataFrame:
        return papers.select(F.col(paper).alias("paper"), F.lit(kind).alias("kind"), F.posexplode(f"{kind}s").alias("idx", "text"))

    both = one("lemma").unionByName(one("theorem"))
    return both.withColumn("id", F.format_string("%d-%s-%d", "paper", "kind", "idx"))


def paper_of(item_id: Column) -> Column:
    """The paper in an item's id; another form raises."""
    number = F.regexp_extract(item_id, ID.pattern, 1)
    return F.when(number != "", number.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an item id: "), item_id)).cast("long"))


def split_papers(papers: DataFrame, paper: str, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """`papers` with split train or eval: the first floor(n * ratio) papers by a hash order. Keyed by paper, so the same
    paper is never in both, whatever filter came before.

    The rank at the cut is found from counts of key prefixes, so no task holds all papers.
    """
    keyed = papers.withColumn("skey", md5_key(seed, F.col(paper)))
    ids = keyed.select(paper, "skey").distinct()
    buckets = sorted((r["b"], r["n"]) for r in ids.groupBy(F.substring("skey", 1, 3).alias("b")).agg(F.count("*").alias("n")).collect())  # 4096 at most
    left, cut_bucket = int(sum(n for _, n in buckets) * ratio), ""
    for bucket, n in buckets:
        cut_bucket = bucket
        if left < n:
            break
        left -= n
    bucket = F.substring("skey", 1, 3)
    edge = ids.filter(bucket == cut_bucket).withColumn("rn", F.row_number().over(Window.partitionBy(bucket).orderBy("skey", paper))).filter(F.col("rn") <= left).select(paper, F.lit(True).alias("edge"))
    joined = keyed.join(edge, paper, "left")
    train = (bucket < cut_bucket) | F.coalesce("edge", F.lit(False))
    return joined.withColumn("split", F.when(train, "train").otherwise("eval")).drop("skey", "edge")


def positions(rows: DataFrame, order: str, by: str, out: str) -> DataFrame:
    """`rows` with their place, from 0, in the order of a numeric column within each value of `by`, which are few.

    Ranges of the order are numbered each by itself and start behind the rows of the ranges before.
    """
    spark = rows.sparkSession
    parts = max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = range_cuts(rows, order, parts)
    level = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col(order))) if cuts else F.lit(0)
    ranked = rows.withColumn("ps_part", level).withColumn("ps_rank", F.row_number().over(Window.partitionBy("ps_part", by).orderBy(order)))
    counts = sorted((r[by], r["ps_part"], r["n"]) for r in ranked.groupBy(by, "ps_part").agg(F.count("*").alias("n")).collect())  # a row a range and value
    before, last, base = [], None, 0
    for value, part, n in counts:
        base = base if value == last else 0
        before.append((value, part, base))
        last, base = value, base + n
    offsets = spark.createDataFrame(before, f"{by} {dict(rows.dtypes)[by]}, ps_part int, ps_before long")
    joined = ranked.join(F.broadcast(offsets), [by, "ps_part"])
    return joined.select(*rows.columns, (F.col("ps_before") + F.col("ps_rank") - 1).alias(out))


def pair_up(rows: DataFrame, paper: str, stmt: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(paper, pair, x, y): statements of a paper in a hash order, taken two by two. An odd one out meets the first one
    again, so n statements give ceil(n / 2) pairs; papers with one statement give none."""
    key = md5_key(seed + epoch, F.col(paper), F.col(stmt))
    w = Window.partitionBy(paper).orderBy("pkey", stmt)
    ranked = rows.select(paper, stmt).withColumn("pkey", key).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(paper))).filter("n > 1")
    again = ranked.filter("rn = 1 and n % 2 = 1").withColumn("rn", F.col("n") + 1)
    both = ranked.select(paper, stmt, "rn").unionByName(again.select(paper, stmt, F.col("rn").cast("int").alias("rn")))
    return both.groupBy(paper, F.expr("(rn - 1) div 2").alias("pair")).agg(F.min_by(stmt, "rn").alias("x"), F.max_by(stmt, "rn").alias("y"))


def shuffled(rows: DataFrame, key: list[str], seed: int = 42, epoch: int = 0) -> DataFrame:
    """`rows` with their place, from 0 without gaps, in one order over all of them that each epoch draws anew; `key` tells rows apart."""
    keyed = rows.withColumn("sh_key", md5_key(seed + epoch, "pair", *map(F.col, key)))
    return numbered(keyed, [F.col("sh_key"), *map(F.col, key)], "place", "shuffled").drop("sh_key")


def full_batches(rows: DataFrame, place: str, size: int) -> DataFrame:
    """`rows` (places from 0 without gaps) with their batch, without the last one if it is not full."""
    n = rows.agg((F.max(place) + 1).alias("n")).first()["n"] or 0
    return rows.withColumn("batch", F.expr(f"{place} div {size}")).filter(F.col("batch") < n // size)


def sample_of(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows by a hash order: the same ones on every run."""
    return rows.orderBy(md5_key(seed, F.col(key)), key).limit(most)


def length_stats(values: DataFrame, column: str, percents: tuple[int, ...] = (50, 75, 90, 95, 99), limits: tuple[int, ...] = (128, 256, 512)) -> DataFrame:
    """One row: n, least, most, mean, the value at rank floor(n p / 100) of the sorted ones, and how many fit a limit.

    Ranks come from counts by value, which are few, not from sorted rows.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    # one window over distinct values: bounded by the longest text, not by the rows
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.sum("c").alias("n"))
    joined = upto.crossJoin(F.broadcast(total))  # one row
    ranks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("v"))).alias(f"p{p}") for p in percents]
    fits = [F.coalesce(F.sum(F.when(F.col("v") <= k, F.col("c"))), F.lit(0)).alias(f"fit{k}") for k in limits]
    return joined.agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), *ranks, *fits)


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal-width bins between the least and the greatest value; empty bins have no row."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    v = F.col(column)
    place = F.least(F.floor((v - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    return values.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends: one row


def search_text(rows: DataFrame, query: str, order: list[str], text: str = "text", most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Statements that contain a string in any case: all of them counted, the first ones in corpus order."""
    hits = rows.filter(F.contains(F.lower(text), F.lit(query.lower())))
    return hits.agg(F.count("*").alias("n")), hits.orderBy(*order).limit(most)
