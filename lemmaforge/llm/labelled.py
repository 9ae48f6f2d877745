"""Labelled rows for a fit, within a bound.

Labels are chosen by a hash of their id; as an id may stand in many documents or labels, the rows that they meet are counted, and
where these are more than the bound, rows that are equal in label, id and text count once and whole buckets of
a hash of id and text are taken while they fit. Either way at most `most` rows are left, the same ones on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """(y, text): at most `most` documents with a label that is not null and for which `train` holds."""
    known = labels.filter(F.col(label).isNotNull() & train).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most))  # at most `most` ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    if docs.select("doc_id").join(chosen, "doc_id").limit(most + 1).count() <= most:
        return rows.select("y", "text")
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    once = hashed.groupBy("y", "doc_id", "h").agg(F.first("text").alias("text")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    counts = sorted((r["b"], r["n"]) for r in hashed.select("y", "doc_id", "h").distinct().groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n")).collect())
    taken, total = [], 0
    for b, n in counts:
        if total + n <= most:
            taken.append(b)
            total += n
    return once.filter(F.col("b").isin(taken)).select("y", "text")
