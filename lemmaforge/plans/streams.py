"""Streaming queries, run over all files that are there, and side inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaforge.functions import latex
from lemmaforge.session import fresh_path
from lemmaforge.streaming import totals


def _run(spark, records, totals_of, keys=()):
    path = fresh_path(spark, "totals")
    totals.start(records, totals_of, path, fresh_path(spark, "stream"), once=True).awaitTermination()
    return totals.stored(spark, path, keys)


def a5_streamed_totals(spark, d):
    """Statement totals over a stream of records, one for each turn."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    tex = F.concat(F.when(F.col("turn") % 2 == 0, "\\begin{foo}").otherwise("\\begin{theorem*}"), "text", F.when(F.col("turn") % 2 == 0, "\\end{foo}").otherwise("\\end{theorem*}"))
    folder = fresh_path(spark, "arriving")
    t.select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.array(F.lit("\\newtheorem{foo}{Lemma}"), tex).alias("latex")).repartition(4).write.json(folder)
    return _run(spark, totals.arriving(spark, folder, files_a_trigger=2), totals.statement_totals, ("kind",))


def a6_streamed_summary(spark, d):
    """Graph totals over a stream of graph records."""
    t = spark.read.parquet(f"{d}/conversations.parquet")
    folder = fresh_path(spark, "arriving")
    node = F.struct(F.col("turn").cast("string").alias("id"), "text", F.col("role").alias("env"))
    edge = F.struct((F.col("turn") - 1).cast("string").alias("from"), F.col("turn").cast("string").alias("to"))
    rows = t.groupBy(F.col("conv_id").alias("index")).agg(F.collect_list(node).alias("nodes"), F.collect_list(F.when(F.col("turn") > 0, edge)).alias("edges"))
    rows.withColumn("error", F.when(F.col("index") % 10 == 3, "bad")).repartition(4).write.json(folder)
    schema = "index bigint, nodes array<struct<id:string>>, edges array<struct<from:string>>, error string"
    return _run(spark, totals.arriving(spark, folder, schema, 2), totals.graph_totals)


def s12_label_map(spark, d):
    """A side input of aliases as a table."""
    folder = fresh_path(spark, "labels")
    n = spark.read.parquet(f"{d}/nation.parquet")
    n.select(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("old:"), "n_nationkey"), F.concat(F.lit("New:"), "n_name")))))).coalesce(1).write.text(folder)
    table = label_map(spark, folder)
    return table.select("alias", latex.folded_label(F.col("label")).alias("label"))


def label_map(spark, path: str):
    """(alias, label) of a JSON object; anything else raises."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,string>")
    checked = F.when(F.ltrim("value").startswith("{") & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("the label map is no JSON object")).cast("map<string,string>"))
    return whole.select(F.explode(checked).alias("alias", "label"))


QUERIES = {f.__name__: f for f in (a5_streamed_totals, a6_streamed_summary, s12_label_map)}
SQL = {
    "a5_streamed_totals": "SELECT CASE WHEN turn % 2 = 0 THEN 'lemma' ELSE 'theorem' END AS kind, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS n FROM conversations GROUP BY 1",  # a theorem is found by both scans
    "a6_streamed_summary": "SELECT count(DISTINCT conv_id) FILTER (conv_id % 10 <> 3) AS records, count(DISTINCT conv_id) FILTER (conv_id % 10 = 3) AS error_records, count(*) AS nodes, count(*) FILTER (turn > 0) AS edges FROM conversations",
    "s12_label_map": "SELECT 'old:' || n_nationkey AS alias, lower('New:' || n_name) AS label FROM nation",
}
