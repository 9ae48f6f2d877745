"""SentencePiece encoding as relations: the lattice in DataFrame operations, folded by higher-order functions.

Words' substrings up to the longest piece are exploded and equi-joined to the piece table, which is broadcast (as many rows
as the model has pieces); edges are grouped by word, and `aggregate` folds them:

* unigram models: Viterbi; the state is the best score at each place and where its last edge begins;
* BPE models: merges; the state is the list of cuts, and of the edges that span exactly two neighbouring stretches the best
  score, leftmost first, takes the cut between them out.

`scope` says whose words are grouped: "document" (words of one document; texts are dealt by document once, and nothing else
is shuffled) or "corpus" (every distinct word is folded once and joined to its occurrences).

This form costs more than the query may; `pieces.encode` is the same function in Arrow batches, and the README has both
figures. Words of over LONG characters, on which a fold over all edges takes too many steps, are folded by `pieces`.

Defined cases: as in `pieces`; rows with equal ids and texts are encoded once and stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm.pieces import BPE, LONG, MARK, MODEL, PieceTable
from lemmaforge.session import cut, workers_see_package

_PIECES = "piece string, id int, score double"


def words(text: Column, prefix: bool) -> Column:
    body = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    body = F.when(body != "", F.concat(F.lit(" "), body) if prefix else body).otherwise(F.lit(""))
    return F.regexp_extract_all(body, F.lit(r" *[^ \n]+| +|\n"), F.lit(0))


def lattice(rows: DataFrame, table: PieceTable, by: list[str], keep: list[str]) -> DataFrame:
    """Rows of `by` (the word is its last column) with `edges`: (begin, end, id, score) of every piece in the word."""
    pieces = rows.sparkSession.createDataFrame([(p, i, float(table.scores[i])) for p, i in table.id_of.items()], _PIECES)
    word, longest = by[-1], table.longest
    begins = rows.withColumn("begin", F.explode(F.sequence(F.lit(0), F.length(word) - 1)))
    spans = begins.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word) - F.col("begin")))))
    subs = spans.withColumn("piece", F.substring(F.col(word), F.col("begin") + 1, F.col("size")))
    found = subs.join(F.broadcast(pieces), "piece", "left")  # a character without a piece keeps its word
    edge = F.when(F.col("id").isNotNull(), F.struct(F.col("begin"), (F.col("begin") + F.col("size")).alias("end"), "id", "score"))
    return found.groupBy(*by).agg(F.collect_list(edge).alias("edges"), *[F.first(c).alias(c) for c in keep])


def _first(edges: Column) -> Column:
    return F.get(edges, F.lit(0))


def merged(word: Column, edges: Column) -> Column:
    """Cuts of a word after all merges; edges come by falling score and then by begin."""

    def step(cuts: Column, _: Column) -> Column:
        place = lambda x: F.array_position(cuts, x)
        fits = F.filter(edges, lambda e: (place(e["begin"]) > 0) & (place(e["end"]) - place(e["begin"]) == 2))
        gone = F.element_at(cuts, (place(_first(fits)["begin"]) + 1).cast("int"))
        return F.when(F.size(fits) > 0, F.array_remove(cuts, gone)).otherwise(cuts)

    whole = F.sequence(F.lit(0), F.length(word))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), whole, step)


def best_path(word: Column, edges: Column, worst: float) -> Column:
    """Cuts of a word on the path of the greatest score; the longest piece wins a tie."""
    bare = F.lit(worst)

    def step(state: Column, q: Column) -> Column:
        ending = F.transform(F.filter(edges, lambda e: e["end"] == q), lambda e: F.struct((F.get(state, e["begin"])["score"] + e["score"]).alias("score"), (-e["begin"]).alias("by")))
        single = F.struct((F.get(state, q - 1)["score"] + bare).alias("score"), (1 - q).alias("by"))
        held = F.exists(edges, lambda e: (e["end"] == q) & (e["begin"] == q - 1))
        best = F.array_max(F.when(held, ending).otherwise(F.concat(ending, F.array(single))))
        return F.concat(state, F.array(F.struct(best["score"].alias("score"), best["by"].alias("by"))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("by")))
    states = F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)
    back = F.aggregate(
        F.sequence(F.lit(1), F.length(word)),
        F.struct(states.alias("s"), F.array(F.length(word)).alias("cuts")),
        lambda a, _: F.struct(a["s"].alias("s"), F.when(F.get(a["cuts"], F.lit(0)) > 0, F.concat(F.array(-F.get(a["s"], F.get(a["cuts"], F.lit(0)))["by"]), a["cuts"])).otherwise(a["cuts"]).alias("cuts")),
    )
    return back["cuts"]


def _ids(word: Column, cuts: Column, edges: Column, table: PieceTable) -> Column:
    """Token ids between the cuts; a character without a piece gives its bytes, or the unknown piece."""
    spare = F.array(*[F.lit(table.bytes_of[b]) for b in range(256)]) if table.bytes_of else None

    def fallback(a: Column, b: Column) -> Column:
        if spare is None:
            return F.array(F.lit(table.unknown))
        pairs = F.regexp_extract_all(F.hex(F.encode(F.substring(word, a + 1, b - a), "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
        return F.transform(pairs, lambda x: F.get(spare, F.conv(x, 16, 10).cast("int")))

    def token(a: Column, b: Column) -> Column:
        hit = _first(F.filter(edges, lambda e: (e["begin"] == a) & (e["end"] == b)))
        return F.when(hit.isNotNull(), F.array(hit["id"])).otherwise(fallback(a, b))

    return F.flatten(F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), token))


def folded(rows: DataFrame, table: PieceTable, by: list[str], keep: list[str], long_words: bool) -> DataFrame:
    """Rows of `by` and `keep` with the token ids of the word, the last column of `by`."""
    word = by[-1]
    ranked = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(a["begin"] - b["begin"])
    short = lattice(rows.filter(F.length(word) <= LONG), table, by, keep).withColumn("edges", F.array_sort("edges", ranked))
    cuts = merged(F.col(word), F.col("edges")) if table.kind == BPE else best_path(F.col(word), F.col("edges"), table.worst)
    done = short.withColumn("cuts", cuts).select(*by, *keep, _ids(F.col(word), F.col("cuts"), F.col("edges"), table).alias("ids"))
    if not long_words:
        return done
    shared = workers_see_package(rows.sparkSession).sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value
            found = [known.encode_words([w]) for w in batch.column(word).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    long = rows.filter(F.length(word) > LONG).select(*by, *keep)
    return done.unionByName(long.mapInArrow(run, long.withColumn("ids", F.lit(None).cast("array<int>")).schema))


def encode(docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text", scope: str = "document") -> DataFrame:
    """`key` and `tokens` of every row of `docs`."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(body).alias("h"), body.alias("body"))
    long = bool(rows.filter(F.col("body").rlike(rf"[^ \n]{{{LONG}}}| {{{LONG}}}")).limit(1).count())
    split, row = words(F.col("body"), table.prefix), ["k", "h"]
    if scope == "document":  # equal rows are one document here: sets of places
        own = rows.repartition(*row).select(*row, F.posexplode(split).alias("at", "word")).groupBy(*row, "word").agg(F.collect_set("at").alias("places"))
        placed = folded(own, table, [*row, "word"], ["places"], long).select(*row, F.explode("places").alias("at"), "ids")
    else:
        occurrences = rows.select(*row, F.posexplode(split).alias("at", "word")).distinct()
        known = cut(folded(occurrences.select("word").distinct(), table, ["word"], [], long), "known-words")
        placed = occurrences.join(known, "word").select(*row, "at", "ids")
    tokens = placed.groupBy(*row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("tokens"))
    return rows.select("k", "h", F.col("key").alias(key)).join(tokens, row, "left").select(key, F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))


def measured(spark: SparkSession, sf_dir: str, scope: str = "document", model: str = MODEL) -> DataFrame:
    """The relational form over all documents, for the figures in the README."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, PieceTable.load(model), scope=scope).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"))
