"""Queries over stored vectors: `embeddings` with label as paper id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions.text import md5_key
from lemmaforge.functions.vectors import dot, first_vector, last_vector, norm, normalised
from lemmaforge.operators import similarity as sim
from lemmaforge.operators.ordinals import numbered
from lemmaforge.session import cut

TAU = 0.07
NEGATIVES = 50
QUERIES_MAX = 5000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, vec."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: the vectors 2 id and 2 id + 1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    x = e.filter("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("id"), F.col("embedding").alias("x"))
    y = e.filter("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("id"), F.col("embedding").alias("y"))
    return x.join(y, "id")


def _round(c, digits: int = 6):
    return F.round(c, digits)


def v1_dot(spark, d):
    return pairs(spark, d).select("id", _round(dot(F.col("x"), F.col("y"))).alias("dot"))


def v2_normalise(spark, d):
    """Every third vector is zero and stays so."""
    u = normalised(F.transform("vec", lambda x: F.when(F.col("id") % 3 == 2, F.lit(0.0)).otherwise(x * 3)))
    sized = vectors(spark, d).select("id", u.alias("u")).select("id", "u", _round(norm(F.col("u")), 5).alias("length"))  # once a vector, not once a number
    return sized.select("id", "length", F.posexplode("u").alias("dim", "x")).select("id", "length", "dim", _round("x", 5).alias("x"))


def v13_first_pooling(spark, d):
    return vectors(spark, d).select("id", F.posexplode(first_vector(F.array("vec", F.reverse("vec")))).alias("dim", "x")).select("id", "dim", _round(F.col("x").cast("double")).alias("pooled"))


def v14_last_pooling(spark, d):
    states, mask = F.array("vec", F.reverse("vec"), "vec"), F.array(F.lit(1), F.lit(1), F.lit(0))
    return vectors(spark, d).select("id", F.posexplode(last_vector(states, mask)).alias("dim", "x")).select("id", "dim", _round(F.col("x").cast("double")).alias("pooled"))


def j12_all_pairs(spark, d):
    return sim.score_totals(vectors(spark, d)).select("q", "n", _round("total", 4).alias("total"))


def j13_positives(spark, d):
    """How many other vectors of its group each has, and the first of them: from group summaries, without pairs."""
    v = vectors(spark, d).select("id", "grp")
    least = v.groupBy("grp").agg(F.count("*").alias("c"), F.min("id").alias("a")).filter("c > 1")
    second = v.join(least, "grp").filter("id <> a").groupBy("grp").agg(F.min("id").alias("b"))
    return v.join(least, "grp").join(second, "grp").select(F.col("id").alias("q"), (F.col("c") - 1).alias("n"), F.when(F.col("id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first"))


def j15_single_query(spark, d):
    q = vectors(spark, d).filter("id = 7").select(F.col("vec").alias("qv"))  # one row by its id
    return vectors(spark, d).crossJoin(F.broadcast(q)).select("id", _round(dot(F.col("vec"), F.col("qv"))).alias("score"))


def j16_diagonal(spark, d):
    return pairs(spark, d).select("id", _round(dot(F.col("x"), F.col("y")) / TAU, 4).alias("d"))


def w1_full_ranking(spark, d):
    return sim.ranking(vectors(spark, d), scores=False).select("q", "c", "rk")


def w2_first_positive(spark, d):
    return sim.first_positive_ranks(vectors(spark, d))


def w3_hits(spark, d):
    """A hit<k> is null where there are not k other vectors."""
    v = vectors(spark, d)
    r = sim.first_positive_ranks(v).crossJoin(F.broadcast(v.agg(F.count("*").alias("n"))))  # one row
    return r.select("id", *[F.when(F.col("n") > k, F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"hit{k}") for k in (1, 5, 10, 100_000)])


def w4_similar(spark, d):
    """Neighbours of the third vector of label 2."""
    v = vectors(spark, d)
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("id"))
    q = v.filter("grp = 2").withColumn("nth", nth).filter("nth = 3").select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    s = v.crossJoin(F.broadcast(q)).filter("id <> qid").select("id", _round(dot(F.col("vec"), F.col("qv"))).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(1000)


def w4_nearest_all(spark, d):
    return sim.ranking(vectors(spark, d), 5).select("q", "c", "rk")


def a14_retrieval_metrics(spark, d):
    return sim.retrieval_metrics(vectors(spark, d))


def a16_paired_metrics(spark, d):
    r = sim.paired_ranks(pairs(spark, d))
    return r.agg(F.count("*").alias("n"), _round(F.avg(1.0 / F.col("rank"))).alias("mrr"), *[_round(F.avg((F.col("rank") <= k).cast("double"))).alias(f"top{k}") for k in (1, 5, 10)])


def a17_log_normalisers(spark, d):
    p = pairs(spark, d)
    return sim.normalisers(p, TAU, p.count()).select("id", _round("a", 5).alias("a"), _round("b", 5).alias("b"))


def a18_symmetric_loss(spark, d):
    return sim.symmetric_loss(pairs(spark, d), TAU).select("n", _round("loss", 5).alias("loss"))


def a19_gradients(spark, d):
    g = sim.loss_gradients(pairs(spark, d), TAU)
    return g.select("id", F.col("dim").cast("int").alias("dim"), _round("gx", 7).alias("gx"), _round("gy", 7).alias("gy"))


def scheduled(v: DataFrame, seed: int = 42, most: int = QUERIES_MAX) -> DataFrame:
    """q, grp, place: one vector of every group of two or more first, then the rest, up to `most`."""
    eligible = v.groupBy("grp").count().filter("count >= 2").select("grp")
    keyed = v.select("id", "grp").join(eligible, "grp").withColumn("key", md5_key(seed, F.col("id")))
    turn = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("key", "id")))
    first = F.when(F.col("rn") > 1, 1).otherwise(0)
    chosen = turn.orderBy(first, "key", "id").limit(most)
    return chosen.select(F.col("id").alias("q"), "grp", F.row_number().over(Window.orderBy(first, "key", "id")).cast("long").alias("place"))


def w7_schedule(spark, d):
    return scheduled(vectors(spark, d))


def chosen_positive(v: DataFrame, q: DataFrame, seed: int = 42) -> DataFrame:
    c = v.select(F.col("id").alias("c"), "grp")
    return q.join(c, "grp").filter("q <> c").groupBy("q", "grp").agg(F.min_by("c", md5_key(seed, F.col("q"), F.col("c"))).alias("c"))


def w8_random_positive(spark, d):
    v = vectors(spark, d)
    return chosen_positive(v, scheduled(v)).select("q", "c")


def sampled_negatives(v: DataFrame, q: DataFrame, k: int = NEGATIVES, seed: int = 42) -> DataFrame:
    """(q, c): k different vectors of other groups than the query's, or all of them where there are fewer.

    Vectors are numbered by group, so a group's places are one interval and all others are m numbers with that interval
    skipped. Each query draws k of 0 to m - 1 without replacement by itself: for j from m - k to m - 1 it takes a hashed number
    of 0 to j, or j where it has that one already, which makes all k-subsets equally likely. The work is queries
    times k at any number of vectors and any sizes of groups; only drawn places are joined.
    """
    placed = cut(numbered(v.select(F.col("id").alias("c"), F.col("grp").alias("cg")), [F.col("cg"), F.col("c")], "place", "by-group"), "placed")
    group = placed.groupBy(F.col("cg").alias("grp")).agg(F.min("place").alias("first"), F.count("*").alias("own"))
    m = placed.agg(F.count("*").alias("n"))  # one row
    drawing = q.select("q", "grp").join(group, "grp").crossJoin(F.broadcast(m)).withColumn("m", F.col("n") - F.col("own")).filter("m > 0")
    hashed = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:neg"), F.col("q").cast("string"), j.cast("string"))), 1, 12), 16, 10).cast("long") % (j + 1)
    several = F.expr(f"sequence(greatest(m - {k}, 0), m - 1)")
    taken = F.aggregate(F.transform(several, lambda j: F.struct(j.alias("j"), hashed(j).alias("t"))), F.array().cast("array<bigint>"), lambda got, x: F.concat(got, F.array(F.when(F.array_contains(got, x["t"]), x["j"]).otherwise(x["t"]))))
    drawn = drawing.select("q", "first", "own", F.explode(taken).alias("x"))
    place = F.when(F.col("x") < F.col("first"), F.col("x")).otherwise(F.col("x") + F.col("own"))
    return drawn.select("q", place.alias("place")).join(placed.select("place", "c"), "place").select("q", "c")


def j14_negatives(spark, d):
    v = vectors(spark, d)
    return sampled_negatives(v, scheduled(v))


def sampled_ranks(v: DataFrame) -> DataFrame:
    q = cut(scheduled(v), "scheduled")
    cand = chosen_positive(v, q).select("q", "c", F.lit(1).alias("pos")).unionByName(sampled_negatives(v, q).withColumn("pos", F.lit(0)))
    qv, cv = v.select(F.col("id").alias("q"), F.col("vec").alias("qv")), v.select(F.col("id").alias("c"), F.col("vec").alias("cv"))
    scored = cand.join(qv, "q").join(cv, "c").select("q", "c", "pos", _round(dot(F.col("qv"), F.col("cv"))).alias("s"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter("pos = 1").select("q", "rank")


def w6_sampled_rank(spark, d):
    return sampled_ranks(vectors(spark, d))


def a15_sampled_metrics(spark, d):
    r = sampled_ranks(vectors(spark, d))
    return r.agg(F.count("*").alias("n"), _round(F.avg(1.0 / F.col("rank"))).alias("mrr"), *[_round(F.avg((F.col("rank") <= k).cast("double"))).alias(f"top{k}") for k in (1, 10)])


def v11_temperature(spark, d):
    return pairs(spark, d).select("id", *[_round(dot(F.col("x"), F.col("y")) / t, 4).alias(n) for n, t in (("s007", 0.07), ("s1", 1.0))])


_PAIR = "p AS (SELECT a.vec_id // 2 AS id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_DOT = "list_dot_product"
_DIMS = "ex AS (SELECT vec_id, CAST(unnest(range(64)) AS INT) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size FROM embeddings)"
_SCORED = "s AS (SELECT a.vec_id AS q, b.vec_id AS c, a.label AS g, b.label AS h, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rk FROM s)"
_FIRST = _SCORED + ", f AS (SELECT e.vec_id AS id, min(rk) AS rank FROM embeddings e LEFT JOIN r ON r.q = e.vec_id AND r.g = r.h GROUP BY e.vec_id)"
_SCHEDULE = f"""el AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 2),
k AS (SELECT vec_id, label, md5('42:' || vec_id) AS key FROM embeddings JOIN el USING (label)),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, vec_id) AS rn FROM k),
o AS (SELECT vec_id AS q, label AS grp, row_number() OVER (ORDER BY CASE WHEN rn > 1 THEN 1 ELSE 0 END, key, vec_id) AS place FROM t),
sch AS (SELECT * FROM o WHERE place <= {QUERIES_MAX})"""
_POSITIVE = _SCHEDULE + ", po AS (SELECT q, min_by(e.vec_id, md5('42:' || q || ':' || e.vec_id)) AS c FROM sch JOIN embeddings e ON e.label = grp AND e.vec_id <> q GROUP BY q)"
_NEGATIVE = f"""pl AS (SELECT vec_id AS c, label AS cg, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings),
gi AS (SELECT cg AS grp, min(place) AS first, count(*) AS own, (SELECT count(*) FROM pl) - count(*) AS m FROM pl GROUP BY cg),
fl AS (SELECT q, first, own, m, greatest(m - {NEGATIVES}, 0) AS j, CAST([] AS BIGINT[]) AS got FROM sch JOIN gi USING (grp) WHERE m > 0
  UNION ALL SELECT q, first, own, m, j + 1, list_append(got, CASE WHEN list_contains(got, ('0x' || substr(md5('42:neg:' || q || ':' || j), 1, 12))::BIGINT % (j + 1)) THEN j ELSE ('0x' || substr(md5('42:neg:' || q || ':' || j), 1, 12))::BIGINT % (j + 1) END) FROM fl WHERE j < m),
ne AS (SELECT q, c FROM (SELECT q, CASE WHEN x < first THEN x ELSE x + own END AS place FROM (SELECT q, first, own, unnest(got) AS x FROM fl WHERE j = m)) JOIN pl USING (place))"""
_SAMPLED = _POSITIVE + ", " + _NEGATIVE + """, ca AS (SELECT q, c, 1 AS pos FROM po UNION ALL SELECT q, c, 0 FROM ne),
sr AS (SELECT q, pos, row_number() OVER (PARTITION BY q ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, c) AS rank
       FROM ca JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = c)"""

QUERIES = {f.__name__: f for f in (v1_dot, v2_normalise, v11_temperature, v13_first_pooling, v14_last_pooling, j12_all_pairs, j13_positives, j14_negatives, j15_single_query, j16_diagonal, w1_full_ranking, w2_first_positive, w3_hits, w4_similar, w4_nearest_all, w6_sampled_rank, w7_schedule, w8_random_positive, a14_retrieval_metrics, a15_sampled_metrics, a16_paired_metrics, a17_log_normalisers, a18_symmetric_loss, a19_gradients)}
SQL = {
    "v1_dot": f"WITH {_PAIR} SELECT id, round({_DOT}(x, y), 6) AS dot FROM p",
    "v2_normalise": f"WITH {_DIMS} SELECT vec_id AS id, CASE WHEN vec_id % 3 = 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length, dim, CASE WHEN vec_id % 3 = 2 THEN 0.0::DOUBLE ELSE round(x / size, 5) END AS x FROM ex",
    "v11_temperature": f"WITH {_PAIR} SELECT id, round({_DOT}(x, y) / 0.07::DOUBLE, 4) AS s007, round({_DOT}(x, y), 4) AS s1 FROM p",
    "v13_first_pooling": f"WITH {_DIMS} SELECT vec_id AS id, dim, round(x, 6) AS pooled FROM ex",
    "v14_last_pooling": f"WITH {_DIMS} SELECT vec_id AS id, CAST(63 - dim AS INT) AS dim, round(x, 6) AS pooled FROM ex",
    "j12_all_pairs": "SELECT a.vec_id AS q, count(*) AS n, round(sum(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS total FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "j13_positives": "SELECT a.vec_id AS q, count(*) AS n, min(b.vec_id) AS first FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "j14_negatives": f"WITH RECURSIVE {_SCHEDULE}, {_NEGATIVE} SELECT q, c FROM ne",
    "j15_single_query": "SELECT a.vec_id AS id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b",
    "j16_diagonal": f"WITH {_PAIR} SELECT id, round({_DOT}(x, y) / 0.07::DOUBLE, 4) AS d FROM p",
    "w1_full_ranking": f"WITH {_SCORED} SELECT q, c, rk FROM r",
    "w2_first_positive": f"WITH {_FIRST} SELECT id, rank FROM f",
    "w3_hits": f"WITH {_FIRST} SELECT id, CAST(coalesce(rank <= 1, false) AS INT) AS hit1, CAST(coalesce(rank <= 5, false) AS INT) AS hit5, CAST(coalesce(rank <= 10, false) AS INT) AS hit10, CAST(NULL AS INT) AS hit100000 FROM f",
    "w4_similar": "WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 1 OFFSET 2) SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> qid ORDER BY score DESC, id LIMIT 1000",
    "w4_nearest_all": f"WITH {_SCORED} SELECT q, c, rk FROM r WHERE rk <= 5",
    "w6_sampled_rank": f"WITH RECURSIVE {_SAMPLED} SELECT q, rank FROM sr WHERE pos = 1",
    "w7_schedule": f"WITH {_SCHEDULE} SELECT q, grp, place FROM sch",
    "w8_random_positive": f"WITH {_POSITIVE} SELECT q, c FROM po",
    "a14_retrieval_metrics": f"WITH {_FIRST} SELECT count(*) AS n, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, round(sum(CAST(coalesce(rank <= 1, false) AS DOUBLE)) / count(*), 6) AS top1, round(sum(CAST(coalesce(rank <= 5, false) AS DOUBLE)) / count(*), 6) AS top5, round(sum(CAST(coalesce(rank <= 10, false) AS DOUBLE)) / count(*), 6) AS top10 FROM f",
    "a15_sampled_metrics": f"WITH RECURSIVE {_SAMPLED} SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS top10 FROM sr WHERE pos = 1",
    "a16_paired_metrics": f"WITH {_PAIR}, s AS (SELECT a.id AS q, b.id AS c, row_number() OVER (PARTITION BY a.id ORDER BY round({_DOT}(a.x, b.y), 6) DESC, b.id) AS rank FROM p a, p b) SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(rank <= 5 AS DOUBLE)), 6) AS top5, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS top10 FROM s WHERE q = c",
    "a17_log_normalisers": f"WITH {_PAIR}, s AS (SELECT a.id AS i, b.id AS j, {_DOT}(a.x, b.y) / 0.07::DOUBLE AS s FROM p a, p b), x AS (SELECT i AS id, max(s) + ln(sum(exp(s - m))) AS a FROM (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM s) GROUP BY i), y AS (SELECT j AS id, max(s) + ln(sum(exp(s - m))) AS b FROM (SELECT *, max(s) OVER (PARTITION BY j) AS m FROM s) GROUP BY j) SELECT id, round(a, 5) AS a, round(b, 5) AS b FROM x JOIN y USING (id)",
    "a18_symmetric_loss": f"WITH {_PAIR}, s AS (SELECT a.id AS i, b.id AS j, {_DOT}(a.x, b.y) / 0.07::DOUBLE AS s FROM p a, p b), x AS (SELECT i AS id, ln(sum(exp(s))) AS a FROM s GROUP BY i), y AS (SELECT j AS id, ln(sum(exp(s))) AS b FROM s GROUP BY j) SELECT count(*) AS n, round(sum(a + b - 2 * s) / (2 * count(*)), 5) AS loss FROM x JOIN y USING (id) JOIN s ON s.i = id AND s.j = id",
    "a19_gradients": f"WITH {_PAIR}, s AS (SELECT a.id AS i, b.id AS j, {_DOT}(a.x, b.y) / 0.07::DOUBLE AS s FROM p a, p b), la AS (SELECT i, ln(sum(exp(s))) AS a FROM s GROUP BY i), lb AS (SELECT j, ln(sum(exp(s))) AS b FROM s GROUP BY j), w AS (SELECT i, j, exp(s - a) + exp(s - b) - CASE WHEN i = j THEN 2 ELSE 0 END AS w FROM s JOIN la USING (i) JOIN lb USING (j)), ex AS (SELECT id, unnest(range(64)) AS dim, unnest(x) AS x, unnest(y) AS y FROM p), gx AS (SELECT i AS id, dim, sum(w * y) / (2 * (SELECT count(*) FROM p) * 0.07::DOUBLE) AS gx FROM w JOIN ex ON ex.id = j GROUP BY ALL), gy AS (SELECT j AS id, dim, sum(w * x) / (2 * (SELECT count(*) FROM p) * 0.07::DOUBLE) AS gy FROM w JOIN ex ON ex.id = i GROUP BY ALL) SELECT id, CAST(dim AS INT) AS dim, round(gx, 7) AS gx, round(gy, 7) AS gy FROM gx JOIN gy USING (id, dim)",
}
