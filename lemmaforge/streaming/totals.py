"""Running totals over records that keep arriving as JSON lines in a folder.

Scans and counts are the batch operators' own. Each micro-batch stores its own totals in a folder named by its number, which a
batch that is run again overwrites; the totals are the sum over all folders. So they outlive the driver, and every record
counts once, wherever a query was stopped. `compact` folds batches that are done into one. Bundling by consecutive runs depends on the order of all pieces and stays a batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lemmaforge.operators import statements

RECORD = "index bigint, latex array<string>"


def arriving(spark: SparkSession, folder: str, schema: str = RECORD, files_a_trigger: int = 100) -> DataFrame:
    """Records of JSON-lines files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def statement_totals(records: DataFrame) -> DataFrame:
    """(kind, n): statements scanned so far, every find counted."""
    return statements.scan(records).groupBy("kind").agg(F.count("*").alias("n"))


def graph_totals(dags: DataFrame) -> DataFrame:
    """One row: records, failed records, nodes and edges of arriving graph records."""
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    return dags.agg(F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error").isNotNull()).alias("error_records"), n("nodes").alias("nodes"), n("edges").alias("edges"))


def start(records: DataFrame, totals_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the totals of arriving records below `path`, a shared folder; progress is kept in the checkpoint folder. once: stop
    when all files that are there have been read."""

    def keep(batch: DataFrame, number: int) -> None:
        totals_of(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = records.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The totals so far: every other column than `keys` is summed over the batches."""
    rows = spark.read.parquet(path).drop("batch")
    sums = [F.sum(c).cast("long").alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def compact(spark: SparkSession, path: str, to: str, keys: tuple[str, ...] = ()) -> None:
    """Write the totals as batch -1 of another folder, where a query with a checkpoint of its own goes on."""
    stored(spark, path, keys).coalesce(1).write.mode("overwrite").parquet(f"{to}/batch=-1")
