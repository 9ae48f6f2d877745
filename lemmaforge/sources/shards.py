"""Embedding shards, dataset listings and their caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.session import exists

SIZES = {"toy": 200, "tiny": 1_000, "small": 10_000, "medium": 100_000, "full": None}


def id_text(value: Column, kind: str) -> Column:
    """An id as a string, whatever container type it came in."""
    if kind == "binary":
        return F.decode(value, "UTF-8")
    if kind.startswith("array"):
        return F.array_join(value.cast("array<string>"), ",")
    return value.cast("string")


def read_shards(spark: SparkSession, path: str, ids: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, embedding) of a folder of shards. A vector of another length than the first kind, or none, fails the read."""
    return checked(spark.read.parquet(path), ids, vector)


def checked(rows: DataFrame, ids: str = "id", vector: str = "embedding") -> DataFrame:
    kind = dict(rows.dtypes)[ids]
    sizes = rows.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors have {sizes['a']} to {sizes['b']} numbers")
    if not dict(rows.dtypes)[vector] in ("array<float>", "array<double>"):
        raise ValueError(f"{vector} is {dict(rows.dtypes)[vector]}, not floating point")
    return rows.select(id_text(F.col(ids), kind).alias("id"), F.col(vector).cast("array<float>").alias("embedding"))


def _part(model: str, size: str, split: str) -> dict[str, str]:
    return {"model": model, "size": size, "split": split}


def _folder(part: dict[str, str]) -> str:
    return "/".join(f"{k}={v}" for k, v in part.items())


def write_embeddings(rows: DataFrame, path: str, model: str, size: str, split: str, overwrite: bool = False) -> None:
    """Vectors with their ids and, where rows have a paper_id, their papers: one partition of path/embeddings, by model, size and
    split, and its info row in path/info. Papers are a column of the vectors' table, so that they stay aligned and
    are read without the vectors. Overwriting replaces this partition alone; without it a partition that is there raises."""
    part = _part(model, size, split)
    if not overwrite and exists(rows.sparkSession, f"{path}/embeddings/{_folder(part)}"):
        raise FileExistsError(f"{_folder(part)} is stored already")
    columns = {k: F.lit(v) for k, v in part.items()}
    put = lambda df, to: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(f"{path}/{to}")
    put(rows.withColumns(columns), "embeddings")
    info = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    put(info.withColumns(columns).coalesce(1), "info")


def store(spark: SparkSession, path: str, table: str = "embeddings", **part: str) -> DataFrame:
    """The stored table, cut down to the named values of its partition columns, which prune what is read."""
    rows = spark.read.parquet(f"{path}/{table}")
    for k, v in part.items():
        rows = rows.filter(F.col(k) == v)
    return rows


def precomputed(spark: SparkSession, path: str, model: str, size: str, split: str) -> DataFrame | None:
    """Stored vectors of a model for a dataset, or None."""
    part = _part(model, size, split)
    if not exists(spark, f"{path}/embeddings/{_folder(part)}"):
        return None
    return checked(store(spark, path, **part))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, mb) of the files below a folder, from metadata only."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") / 1048576).alias("mb"))


def datasets(spark: SparkSession, path: str, ending: str = ".parquet") -> DataFrame:
    """(name, mb) of the datasets right below a folder, from metadata only: a file, or a folder of files and partitions, is one
    dataset when its name has the ending."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    below = F.substring(F.regexp_replace("path", "^[^/:]+:(//[^/]*)?", ""), F.lit(len(root) + 2), F.length("path"))
    found = files(spark, path).select(F.split(below, "/")[0].alias("name"), "mb").filter(F.endswith("name", F.lit(ending)))
    return found.groupBy("name").agg(F.sum("mb").alias("mb"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """(model, title, projection, adapter, embeddings): models with files of one of these kinds. A model is what a partition
    of the store is named after, or else the folder that holds the file."""
    stored, folder = F.regexp_extract("path", "/model=([^/]+)/", 1), F.element_at(F.split("path", "/"), -2)
    at = files(spark, path).select(F.when(stored != "", stored).otherwise(folder).alias("model"), "name")
    has = lambda pattern: F.bool_or(F.col("name").rlike(pattern))
    kinds = at.groupBy("model").agg(has("^projection").alias("projection"), has("^adapter|^lora").alias("adapter"), has("embedding|parquet$").alias("embeddings"))
    title = F.initcap(F.translate("model", "-_", "  "))
    return kinds.filter(F.col("projection") | F.col("adapter") | F.col("embeddings")).select("model", title.alias("title"), "projection", "adapter", "embeddings")


def dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL corpus, kept by the session's cache after its first use: a later call's plan finds the stored rows.
    `unpersist` on any of the returned frames lets go of them."""
    rows = spark.read.schema(schema).json(path)
    return rows if rows.storageLevel.useMemory else rows.cache()


def scale_variant(rows: DataFrame, size: str, index: str = "index") -> DataFrame:
    """The first lines of a numbered corpus, as many as the size has."""
    most = SIZES[size]
    return rows if most is None else rows.filter(F.col(index) < most)
