"""Line-delimited JSON: scans that differ in what a bad line does, and sinks."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, line) of every line, blank ones included in the count, through the files in order of their names.

    A scan reads splits in any order, so places are counted within a split; one count a split comes to the driver, and
    splits are ordered by file and begin. Lines stay where they are.
    """
    found = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    splits = sorted((r["file"], r["begin"], r["n"], r["first"]) for r in found.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect())
    before = accumulate([0, *[n for *_, n, _ in splits]])
    offsets = spark.createDataFrame([(f, b, x - first) for (f, b, _, first), x in zip(splits, before, strict=False)], "file string, begin long, shift long")
    return found.join(F.broadcast(offsets), ["file", "begin"]).select((F.col("row") + F.col("shift")).alias("index"), "line")  # a row a split


def _is_object(line: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the scan."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every non-blank line with its index; a line that is no JSON object has an error and null fields."""
    lines = raw_lines(spark, path).filter(F.trim("line") != "")
    good = _is_object(F.col("line"))
    return lines.select("index", F.when(good, F.from_json("line", schema)).alias("r"), F.when(~good, F.concat(F.lit("bad line: "), F.substring("line", 1, 80))).alias("error")).select("index", "r.*", "error")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every non-blank line with its index; a bad line counts as an object without fields. bad marks it."""
    lines = raw_lines(spark, path).filter(F.trim("line") != "")
    good = _is_object(F.col("line"))
    return lines.select("index", F.from_json(F.when(good, F.col("line")).otherwise(F.lit("{}")), schema).alias("r"), (~good).alias("bad")).select("index", "r.*", "bad")


def write_lines(rows: DataFrame, path: str, ordered_by: str | None = None, overwrite: bool = False) -> None:
    """JSON lines through the commit protocol: readers see all of them or none. An existing path is refused unless
    overwrite is set. ordered_by sorts by range, so files in name order are in that order."""
    rows = rows.orderBy(ordered_by) if ordered_by else rows
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_non_empty(rows: DataFrame, path: str, arrays: list[str], overwrite: bool = False) -> None:
    """Only rows in which some array has an element."""
    filled = sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(0))
    write_lines(rows.filter(filled > 0), path, overwrite=overwrite)


def edge_array(edges: DataFrame, wrap: bool = False, records: DataFrame | None = None) -> DataFrame:
    """(index, line): a record's edges in order of place, as a JSON array of [from, from text, to, to text], or as
    {index, edges}, in which a missing index is null. Records (index) without edges have an empty array."""
    quad = F.array("from", "from_text", "to", "to_text")
    rows = edges.select("index", F.struct("place", quad.alias("q")).alias("e"))
    if records is not None:
        rows = rows.unionByName(records.select("index", F.lit(None).cast(rows.schema["e"].dataType).alias("e")))
    per = rows.groupBy("index").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["q"]).alias("edges"))
    value = F.struct("index", "edges") if wrap else F.col("edges")
    return per.select("index", F.to_json(value, {"ignoreNullFields": "false"}).alias("line"))


def write_edges(edges: DataFrame, path: str, wrap: bool = False, records: DataFrame | None = None, overwrite: bool = False) -> None:
    """One line a record, in order of index."""
    lines = edge_array(edges, wrap, records).orderBy("index").select("line")
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)
