"""Exact best documents by inner products of sparse weights, from a stored index that leaves most postings unread.

The index has three stored tables: bags by document, statistics by term (document frequency, greatest weight), and postings. Postings
of terms that more than one document in FREQUENT holds are laid out in blocks by zone and layer: a zone is a bucket of
terms, a layer a range of weights (an octave), and the greatest weight of each block is kept. Zones and layers are partition
columns, so a block that isn't asked for is not opened. Other terms lie in zones of their own, without layers. A file has some
POSTINGS_A_FILE postings, so small indexes have few zones.

A search for the k best documents of each query goes in four steps:

1. opening: the query's rarest terms are read, and the k best documents by them are scored exactly; the least of these scores
   is a threshold that the k-th best document reaches;
2. a term can give at most its weight in the query times its greatest weight anywhere. The terms with the least such bounds, as many
   as together stay under the threshold, cannot lift a document over it by themselves and are not read; nor are blocks of the
   others whose own bound, with all other terms at theirs, stays under it;
3. of the postings that are read each query's best documents so far are scored exactly, which lifts the threshold; documents are
   kept where their sum so far and the bounds of the unread terms reach it;
4. these are scored exactly from their bags.

Weights must not be negative. Queries' terms are broadcast up to MAX_BROADCAST_TERMS of them, else joined by a shuffle, whose
large partitions Spark may split; documents' bags are joined by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.session import cut, fresh_path, workers_see_package

FREQUENT = 64
POSTINGS_A_FILE = 4_000_000
MOST_ZONES = 256
OPENING = 20  # postings that the opening reads for each wanted document
MAX_BROADCAST_TERMS = 100_000
SLACK = 2e-6  # scores are compared after rounding to six digits


def layer_of(weight: Column) -> Column:
    """Octaves below 2 ** 16, from 0; weights of under 2 ** -16 share the last one."""
    return F.greatest(F.lit(0), F.least(F.lit(32), F.floor(16 - F.log2(F.greatest(weight, F.lit(2.0**-40)))))).cast("int")


@dataclass(frozen=True)
class Index:
    """bags: item, size, bag (array of term and w). terms: term, df, most, frequent. blocks: term, layer, n, most."""

    bags: DataFrame
    terms: DataFrame
    blocks: DataFrame
    path: str
    zones: int

    @property
    def postings(self) -> DataFrame:
        """term, item, w and the partition columns zone and layer."""
        return self.bags.sparkSession.read.parquet(self.path)


def zone_of(term: Column, frequent: Column, zones: int) -> Column:
    return (F.pmod(F.xxhash64(term), F.lit(zones)) + F.when(frequent, F.lit(zones)).otherwise(F.lit(0))).cast("int")


def build(bags: DataFrame, documents: int, frequent: int = FREQUENT) -> Index:
    """The index of (item, bag), a row a document, bag being an array of structs of term and w."""
    spark = bags.sparkSession
    stored = cut(bags.select("item", F.size("bag").cast("long").alias("size"), "bag"), "index-bags")
    rows = stored.select("item", F.explode("bag").alias("x")).select("item", "x.term", "x.w")
    terms = cut(rows.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most")).withColumn("frequent", F.col("df") * frequent > documents), "index-terms")
    # a document's average number of terms times `frequent` bounds how many terms are frequent
    often = F.broadcast(terms.filter("frequent").select("term", "frequent"))
    marked = rows.join(often, "term", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    files = max(1, (terms.agg(F.sum("df")).first()[0] or 0) // POSTINGS_A_FILE)
    zones, salts = min(MOST_ZONES, files), max(1, files // MOST_ZONES)
    placed = marked.select("term", "item", "w", zone_of(F.col("term"), F.col("frequent"), zones).alias("zone"), F.when(F.col("frequent"), layer_of(F.col("w"))).otherwise(F.lit(-1)).alias("layer"))
    path = fresh_path(spark, "index-postings")
    dealt = placed.repartition("zone", "layer", F.pmod(F.xxhash64("item"), F.lit(salts))).sortWithinPartitions("zone", "layer", "term")
    dealt.write.partitionBy("zone", "layer").parquet(path)
    blocks = cut(marked.filter("frequent").groupBy("term", layer_of(F.col("w")).alias("layer")).agg(F.count("*").alias("n"), F.max("w").alias("most")), "index-blocks")
    return Index(stored, terms, blocks, path, zones)


def _with(rows: DataFrame, small: DataFrame, on: list[str], broadcast: bool) -> DataFrame:
    return rows.join(F.broadcast(small) if broadcast else small, on)


def _sums(index: Index, wanted: DataFrame, broadcast: bool) -> DataFrame:
    """(q, item, part): summed contributions of the wanted blocks (q, term, qw, zone, layer)."""
    places = [(r["zone"], r["layer"]) for r in wanted.select("zone", "layer").distinct().collect()]  # at most 2 MOST_ZONES times 33 layers
    by_layer: dict[int, list[int]] = {}
    for zone, layer in places:
        by_layer.setdefault(layer, []).append(zone)
    where = F.lit(False)
    for layer, zones in sorted(by_layer.items()):
        where |= (F.col("layer") == layer) & F.col("zone").isin(sorted(zones))
    read = index.postings.filter(where)
    return _with(read, wanted, ["term", "zone", "layer"], broadcast).groupBy("q", "item").agg(F.sum(F.col("qw") * F.col("w")).alias("part"))


def _exact(index: Index, pairs: DataFrame, terms: DataFrame, known: Broadcast | None, score: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(q, item, score) of pairs of query and document, from the documents' bags."""
    if known is not None:
        return _scored(index, pairs, known).select("q", "item", score(F.col("dot"), F.col("query_size"), F.col("size")).alias("score"))
    bags = index.bags.join(pairs, "item").select("q", "item", "size", F.explode("bag").alias("x")).select("q", "item", "size", "x.term", "x.w")
    met = bags.join(terms.select("q", "term", "qw", "query_size"), ["q", "term"])
    sums = met.groupBy("q", "item", "size", "query_size").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return sums.select("q", "item", score(F.col("dot"), F.col("query_size"), F.col("size")).alias("score"))


def _scored(index: Index, pairs: DataFrame, known: Broadcast) -> DataFrame:
    """(q, item, dot, query_size, size) of pairs, with the queries' terms at hand: a document's bag is looked through once a pair."""
    kinds = {"q": dict(pairs.dtypes)["q"], "item": dict(pairs.dtypes)["item"]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                dots, sizes = [], []
                for q, terms, weights in zip(batch.column("q").to_pylist(), batch.column("terms").to_pylist(), batch.column("ws").to_pylist(), strict=True):
                    of, (own, size) = dict(zip(terms, weights, strict=True)), known.value[q]
                    dots.append(sum(qw * of[t] for t, qw in own if t in of))
                    sizes.append(size)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("item"), pa.array(dots, pa.float64()), pa.array(sizes, pa.int64()), batch.column("size")], names=["q", "item", "dot", "query_size", "size"])

    rows = pairs.join(index.bags, "item").select("q", "item", "size", F.col("bag.term").alias("terms"), F.col("bag.w").alias("ws"))
    return rows.mapInArrow(scan, f"q {kinds['q']}, item {kinds['item']}, dot double, query_size long, size long")


def _at_hand(terms: DataFrame) -> Broadcast:
    """Each query's terms with their weights, and its size."""
    found: dict = {}
    for r in terms.select("q", "term", "qw", "query_size").collect():  # MAX_BROADCAST_TERMS at most
        found.setdefault(r["q"], ([], r["query_size"]))[0].append((r["term"], r["qw"]))
    return terms.sparkSession.sparkContext.broadcast(found)


def best(
    index: Index, queries: DataFrame, k: int, score: Callable[[Column, Column, Column], Column] = lambda dot, query_size, size: dot,
    idf: Callable[[Column], Column] | None = None, max_broadcast: int = MAX_BROADCAST_TERMS, seen: dict | None = None,
) -> DataFrame:
    """(q, item, score, rk) of the k best documents of each query (q, term, qw), by score rounded to six digits and then by item.

    `score` may replace the inner product by a smaller value of it and the two sizes (terms of the query and of the document),
    for instance a Jaccard likeness of binary bags. `idf` makes a factor of a term's document frequency. `seen` gets the
    numbers of postings that the queries' terms have and that the search has read.
    """
    workers_see_package(queries.sparkSession)
    sized = queries.withColumn("query_size", F.count("*").over(Window.partitionBy("q")))
    met = sized.join(index.terms, "term")
    met = met.withColumn("qw", F.col("qw") * idf(F.col("df"))) if idf else met
    terms = cut(met.withColumn("bound", F.col("qw") * F.col("most")), "query-terms")
    small = terms.limit(max_broadcast + 1).count() <= max_broadcast
    known = _at_hand(terms) if small else None
    layered = terms.join(index.blocks.select("term", "layer", F.col("n"), F.col("most").alias("block_most")), "term", "left")
    layered = layered.withColumns({"layer": F.coalesce("layer", F.lit(-1)), "n": F.coalesce("n", "df"), "block_most": F.coalesce("block_most", "most"), "zone": zone_of(F.col("term"), F.col("frequent"), index.zones)})
    blocks = cut(layered, "query-blocks")

    rarest = Window.partitionBy("q").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    opening = terms.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).filter(F.col("before") < OPENING * k).select("q", "term")
    first_blocks = cut(blocks.join(opening, ["q", "term"]).select("q", "term", "qw", "zone", "layer", "n"), "opening")
    first = _top(_sums(index, first_blocks.drop("n"), small).withColumnRenamed("part", "score"), k).select("q", "item")
    reached = _threshold(_exact(index, first, terms, known, score), k)

    least_bound = Window.partitionBy("q").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    limits = cut(terms.join(reached, "q").withColumns({"upto": F.sum("bound").over(least_bound), "total": F.sum("bound").over(Window.partitionBy("q"))}).select("q", "term", "bound", "upto", "total", "threshold"), "limits")
    read = limits.filter(F.col("upto") >= F.col("threshold"))
    unread = limits.groupBy("q").agg(F.max("threshold").alias("threshold"), F.coalesce(F.sum(F.when(F.col("upto") < F.col("threshold"), F.col("bound"))), F.lit(0.0)).alias("rest"))
    able = F.col("qw") * F.col("block_most") + F.col("total") - F.col("bound") >= F.col("threshold")
    wanted = cut(blocks.drop("bound").join(read, ["q", "term"]).filter(able).select("q", "term", "qw", "zone", "layer", "n"), "wanted-blocks")
    if seen is not None:
        of = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        seen |= {"postings": of(blocks), "read": of(wanted), "opening": of(first_blocks)}
    sums = cut(_with(_sums(index, wanted.drop("n"), small), unread, ["q"], small).filter(F.col("part") + F.col("rest") >= F.col("threshold")), "sums")
    leading = _top(sums.select("q", "item", F.col("part").alias("score")), 2 * k).select("q", "item")
    lifted = cut(_threshold(_top(_exact(index, leading, terms, known, score), k), k).withColumnRenamed("threshold", "lifted"), "lifted")
    kept = _with(sums, lifted, ["q"], small).filter(F.col("part") + F.col("rest") >= F.col("lifted")).select("q", "item")
    if seen is not None:
        kept = cut(kept, "candidates")
        seen |= {"sums": sums.count(), "candidates": kept.count()}
    return _top(_exact(index, kept, terms, known, score), k, True)


def _threshold(scored: DataFrame, k: int) -> DataFrame:
    """(q, threshold): what the k-th best document reaches, 0 where fewer are known."""
    found = scored.groupBy("q").agg(F.count("*").alias("c"), F.min("score").alias("least"))
    return found.select("q", F.when(F.col("c") >= k, F.col("least") - SLACK).otherwise(F.lit(0.0)).alias("threshold"))


def _top(scored: DataFrame, k: int, ranked: bool = False) -> DataFrame:
    rounded = scored.select("q", "item", F.round("score", 6).alias("score"))
    rk = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item"))
    found = rounded.withColumn("rk", rk.cast("long")).filter(F.col("rk") <= k)
    return found if ranked else found.drop("rk")
