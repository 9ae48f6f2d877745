"""Corpus cleaning in five stages, each applied to all that the stage before it kept.

toxicity: documents that the lexicon scores as toxic go. line_dedup: later repeats of 50 words or more are cut.
jaccard_join: of documents linked by five-word shingles at a likeness of 0.8 or more, as they are now or as the corpus has
them, the one with the least id stays.
decontamination: documents of which at least one word in twenty repeats a benchmark window go. sentencepiece: the
rest is encoded, and decoded again to compare.

Every stage but the last returns the columns of `documents`; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.llm import decontaminate as benchmark_ngrams
from lemmaforge.llm import jaccard, passages, pieces, toxicity
from lemmaforge.llm.components import components
from lemmaforge.session import cut

SHINGLE, LINK, OF = 5, 80, 100
BROADCAST_ROWS = 500_000
# What jaccard takes as white space.
WORD = r"[^\x20\x09-\x0D]"


def unused(docs: DataFrame, name: str) -> str:
    """A name like `name` that no column of `docs` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the lexicon is fitted to the labelled documents of the corpus. Where they give no
    terms, as without labels, nothing tells a toxic document and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = toxicity.fit(corpus, labels, ~toxicity.held_out(F.col("doc_id"), 5, 0))
    if not lexicon.weights:
        return docs
    out = unused(docs, "toxic_score")
    return toxicity.score(docs, lexicon, out=out).filter(F.col(out) < 0.5).drop(out)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of 50 words or more; those of which nothing is left go."""
    removed = unused(docs, "words_removed")
    done = passages.dedup_passages(docs, removed=removed)
    kept = done.filter((F.col(removed) == 0) | (F.trim("text") != ""))
    changed = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def has_words(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("text").rlike(WORD))


def texts_before(spark: SparkSession, keyed: DataFrame, sf_dir: str) -> DataFrame:
    """(jj_row, text): the corpus text of every row whose text an earlier stage changed, found by its id.

    Rows without words, without an id, or with an id that the corpus holds more than once have none. Up to BROADCAST_ROWS
    such rows are broadcast, so that texts stay where they are read; more of them are joined by a shuffle.
    """
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    once = corpus.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("was")).filter("n = 1").select("doc_id", "was")
    now = has_words(keyed).select("jj_row", "doc_id", F.xxhash64("text").alias("now"))
    changed = cut(now.join(once, "doc_id").filter("now <> was").select("jj_row", "doc_id").distinct(), "changed")
    return corpus.join(F.broadcast(changed) if changed.count() <= BROADCAST_ROWS else changed, "doc_id").select("jj_row", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every component of near-duplicates; of repeated rows one.

    A document links by its text as it is now and by its text in the corpus: a near copy that line_dedup has cut down to
    what differs is still a near copy. Rows without words stay.
    """
    row, place = unused(docs, "jj_row"), unused(docs, "jj_nth")
    whole = docs.withColumn(row, F.xxhash64(*docs.columns))
    keyed = whole.select(F.col(row).alias("jj_row"), "doc_id", "text")
    views = keyed.select("jj_row", "text").unionByName(texts_before(spark, keyed, sf_dir))
    joined = jaccard.jaccard_join(views, "jj_row", n=SHINGLE, num=LINK, den=OF)
    held = joined.groupBy("jj_row").agg(F.min("component_id").alias("u"), F.max("component_id").alias("v"))
    roots = components(held.filter("u <> v").select("u", "v"), "views")
    placed = held.select("jj_row", F.col("u").alias("node")).join(roots, "node", "left").select("jj_row", F.coalesce("root", "node").alias("part"))
    ids = has_words(keyed).select("jj_row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("jj_doc")).distinct()
    best = placed.join(ids, "jj_row").groupBy("part").agg(F.min(F.struct("jj_doc", "jj_row")).alias("r"))
    kept = best.select(F.col("r.jj_row").alias("jj_row"))
    nth = F.row_number().over(Window.partitionBy(row).orderBy(row))
    rows = has_words(whole).join(kept.withColumnRenamed("jj_row", row), row).withColumn(place, nth).filter(F.col(place) == 1).select(*docs.columns)
    return rows.unionByName(docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return benchmark_ngrams.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and whether decoding gives the text back."""
    table = pieces.PieceTable.load()
    back = pieces.encode(docs.select("doc_id", "text"), table, decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.replace("text", F.lit(pieces.MARK), F.lit(" ")), F.lit(""))
    return back.select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
