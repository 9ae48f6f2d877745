"""Pieces of papers in file order to one bundle for each run of a paper's pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions import latex
from lemmaforge.functions.merger import merged
from lemmaforge.operators.ordinals import range_cuts
from lemmaforge.session import workers_see_package


def is_mathematics(categories: Column) -> Column:
    return F.exists(F.split(categories, " +"), lambda x: F.lower(x).startswith("math."))


def runs(rows: DataFrame, key: str, order: str, out: str = "run") -> DataFrame:
    """`rows` with the number of their run: rows that follow each other by `order` with one key. A key that comes back
    starts another run.

    Order is cut into ranges of equal counts; each range finds its own breaks, and the breaks before it, with the key
    that its first row follows, come from one summary row a range, so no task holds all rows.
    """
    spark = rows.sparkSession
    parts = max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = range_cuts(rows, order, parts)
    level = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("part", level)
    w = Window.partitionBy("part").orderBy(order)
    local = dealt.withColumn("new", F.when(F.lag(order).over(w).isNotNull(), (~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("int")).otherwise(F.lit(0)))
    local = local.withColumn("in_part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = sorted((r["part"], r["f"], r["l"], r["n"]) for r in local.groupBy("part").agg(F.min_by(F.struct(key), order)[key].alias("f"), F.max_by(F.struct(key), order)[key].alias("l"), F.sum("new").alias("n")).collect())  # one row a range
    before, base, last = {}, 0, None
    for i, (part, first, final, n) in enumerate(ends):
        base += int(i > 0 and first != last)
        before[part], base, last = base, base + n, final
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    numbered = local.join(F.broadcast(offsets), "part")  # one row a range
    return numbered.select(*rows.columns, (F.col("before") + F.col("in_part")).cast("long").alias(out))


def with_metadata(pieces: DataFrame, metadata: DataFrame | None, key: str = "arxiv_id", line: str | None = None) -> DataFrame:
    """Pieces of papers in a mathematics category with their metadata; without metadata all pieces, and null.

    Of several such rows with one id the last by `line` counts, or the greatest as JSON where there is no such column.
    """
    if metadata is None:
        return pieces.withColumn("metadata", F.lit(None).cast("string"))
    json = F.to_json(F.struct(*[c for c in metadata.columns if c != line]))
    rows = metadata.filter(is_mathematics(F.col("categories"))).select(F.col("id").alias(key), json.alias("json"), (F.col(line) if line else json).alias("line"))
    return pieces.join(rows.groupBy(key).agg(F.max_by("json", F.struct("line", "json")).alias("metadata")), key)


def located(pieces: DataFrame) -> DataFrame:
    """Pieces with arxiv_id and file from their path, .tex only; paths of one part are dropped."""
    parts = F.split("path", "/")
    named = pieces.filter(F.size(parts) >= 2).withColumns({"arxiv_id": F.element_at(parts, -2), "file": F.element_at(parts, -1)})
    return named.filter(F.col("file").endswith(".tex"))


def bundled(pieces: DataFrame, order: str = "index") -> DataFrame:
    """One row a run: arxiv_id, metadata, files as an ordered array of structs, and what the filter looks for."""
    numbered = runs(pieces, "arxiv_id", order)
    own = latex.without_comments(F.coalesce("text", F.lit("")))
    file = F.struct(F.col(order).alias("place"), F.col("file").alias("name"), F.col("text").alias("latex"), F.col("kenlm_perplexity").alias("ppl"), F.col("kenlm_sp_perplexity").alias("sp_ppl"))
    return numbered.groupBy("run").agg(
        F.first("arxiv_id").alias("arxiv_id"), F.first("metadata").alias("metadata"), F.array_sort(F.collect_list(file)).alias("files"),
        F.bool_or(own.rlike(latex.BEGIN_DOCUMENT)).alias("has_document"), F.bool_or(own.rlike(latex.THEOREM_ENV)).alias("has_theorem"),
    )


def kept(bundles: DataFrame) -> DataFrame:
    return bundles.filter("has_document and has_theorem")


def skip_counts(bundles: DataFrame) -> DataFrame:
    """One row: written, and skipped by the first reason that holds."""
    return bundles.agg(F.count_if(F.expr("has_document and has_theorem")).alias("written"), F.count_if(F.expr("not has_document")).alias("no_document"), F.count_if(F.expr("has_document and not has_theorem")).alias("no_theorem"))


def geometric_mean(weight: Column, value: Column) -> Column:
    """Weighted geometric mean over a group; null values don't count, null without any."""
    w = F.when(value.isNotNull(), F.greatest(F.lit(1.0), weight.cast("double")))
    return F.exp(F.sum(w * F.log(F.greatest(value, F.lit(1e-12)))) / F.sum(w))


def mean_perplexity(files: Column, used: Column, name: str) -> Column:
    """The same over an array of file structs with their lengths as chars, for the used names; the first value of a name counts."""
    def one(acc: Column, f: Column) -> Column:
        fresh = f[name].isNotNull() & F.array_contains(used, f["name"]) & ~F.array_contains(acc["seen"], f["name"])
        w = F.greatest(F.lit(1.0), f["chars"].cast("double"))
        more = F.struct((acc["w"] + w).alias("w"), (acc["s"] + w * F.log(F.greatest(f[name], F.lit(1e-12)))).alias("s"), F.array_append(acc["seen"], f["name"]).alias("seen"))
        return F.when(fresh, more).otherwise(acc)

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.expr("cast(array() as array<string>)").alias("seen"))
    return F.aggregate(files, start, one, lambda a: F.when(a["w"] > 0, F.exp(a["s"] / a["w"])))


MERGED = "run long, arxiv_id string, root string, latex string, used array<string>, unresolved array<string>, warnings array<string>"
_FILES = "files array<struct<name: string, ppl: double, sp_ppl: double, chars: bigint>>"


def merge(bundles: DataFrame) -> DataFrame:
    """(run, arxiv_id, root, latex, used, unresolved, warnings, kenlm_perplexity, kenlm_sp_perplexity): bundles as one
    file; without a root the fields are null or empty."""
    workers_see_package(bundles.sparkSession)

    file = pa.struct([("name", pa.string()), ("ppl", pa.float64()), ("sp_ppl", pa.float64()), ("chars", pa.int64())])
    fields = [("run", pa.int64()), *[(n, pa.string()) for n in ("arxiv_id", "root", "latex")], *[(n, pa.list_(pa.string())) for n in ("used", "unresolved", "warnings")], ("files", pa.list_(file))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                rows = []
                for r in whole.slice(at, 32).to_pylist():
                    m = merged([f["name"] for f in r["files"]], [f["latex"] for f in r["files"]])
                    files = [{"name": f["name"], "ppl": f["ppl"], "sp_ppl": f["sp_ppl"], "chars": len(f["latex"] or "")} for f in r["files"]]
                    rows.append({"run": r["run"], "arxiv_id": r["arxiv_id"], "files": files} | ({"root": m.root, "latex": m.text, "used": m.used, "unresolved": sorted(m.unresolved), "warnings": m.warnings} if m else {"used": [], "unresolved": [], "warnings": []}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    done = bundles.select("run", "arxiv_id", "files").mapInArrow(run, f"{MERGED}, {_FILES}")
    kept = [c for c in done.columns if c != "files"]
    return done.select(*kept, mean_perplexity(F.col("files"), F.col("used"), "ppl").alias("kenlm_perplexity"), mean_perplexity(F.col("files"), F.col("used"), "sp_ppl").alias("kenlm_sp_perplexity"))
