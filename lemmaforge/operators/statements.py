"""Typed statements out of LaTeX records: scanned in Python, then deduplicated, numbered and counted by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions.latex import KINDS, PLURALS
from lemmaforge.functions.scanner import definitions, latex_of
from lemmaforge.functions.scanner import statements as scan_text
from lemmaforge.session import workers_see_package

FOUND = "index bigint, file int, at int, kind string, text string"
_SCHEMA = pa.schema([("index", pa.int64()), ("file", pa.int32()), ("at", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


def _rows(index: int, texts: list[str]) -> list[dict]:
    displays = definitions(texts)
    return [{"index": index, "file": i, "at": at, "kind": kind, "text": body} for i, t in enumerate(texts) for kind, body, at in scan_text(t, displays)]


def scan(records: DataFrame) -> DataFrame:
    """Every statement of records (index, latex), of both scans, with file and place."""
    workers_see_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([x for r in part for x in _rows(r["index"], [t for t in r["latex"] or [] if t])], _SCHEMA)

    return records.select("index", "latex").mapInArrow(run, FOUND)


def scan_lines(lines: DataFrame, preferred: str = "latex") -> DataFrame:
    """The same for raw JSON lines (index, line), whose LaTeX field is found by its content. A bad line has no statements."""
    workers_see_package(lines.sparkSession)

    def texts(line: str) -> list[str]:
        try:
            record = json.loads(line)
        except ValueError:
            return []
        return latex_of(record, preferred) if isinstance(record, dict) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([x for r in part for x in _rows(r["index"], texts(r["line"] or ""))], _SCHEMA)

    return lines.select("index", "line").mapInArrow(run, FOUND)


def numbered(found: DataFrame) -> DataFrame:
    """(index, place, kind, text): each kind and text once, at its first place, numbered through the record."""
    first = found.groupBy("index", "kind", "text").agg(F.min(F.struct("file", "at")).alias("where"))
    w = Window.partitionBy("index").orderBy("where", "kind", "text")
    return first.select("index", (F.row_number().over(w) - 1).alias("place"), "kind", "text")


def wide(statements: DataFrame, records: DataFrame) -> DataFrame:
    """One row a record with nine arrays of structs (index, text)."""
    entry = F.struct(F.col("place").alias("index"), "text")
    arrays = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(PLURALS[k]) for k in KINDS]
    none = F.expr("cast(array() as array<struct<index:int,text:string>>)")
    got = statements.groupBy(F.col("index").alias("rec")).agg(*arrays)
    return records.select("index").join(got, F.col("index") == F.col("rec"), "left").select("index", *[F.coalesce(PLURALS[k], none).alias(PLURALS[k]) for k in KINDS])


def totals(statements: DataFrame, n_records: int | None = None) -> DataFrame:
    """(kind, n, records, per_record): statements, records with any, and the mean over all records or those with any."""
    by = statements.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("index").alias("records"))
    return by.withColumn("per_record", F.round(F.col("n") / (F.lit(n_records) if n_records else F.col("records")), 6))
