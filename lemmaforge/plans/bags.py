"""Token-bag queries: `benchmark` items as queries over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaforge.functions.text import mask, padded, word_tokens
from lemmaforge.operators import bags as b
from lemmaforge.operators import similarity as sim
from lemmaforge.session import cut, spread

TOP = 10
LENGTH = 256
SMALL = 16


def _docs(spark, d):
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def _items(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet")


def _doc_bags(spark, d):
    return b.bag(_docs(spark, d), "doc_id", "text")


def _stored(spark, d):
    """Documents' bags by item, stored: texts are split once."""
    return cut(b.bags_by_item(_docs(spark, d), "doc_id", "text"), "bags")


def _item_bags(spark, d):
    return b.bag(_items(spark, d), "item_id", "text")


def _queries(spark, d):
    return b.bags_by_item(_items(spark, d), "item_id", "text")


def v15_tokens(spark, d):
    w = word_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


def v16_padded(spark, d):
    w = word_tokens(F.col("text"))
    return _items(spark, d).select("item_id", F.array_join(padded(w, LENGTH, F.lit("<pad>")), " ").alias("tokens"), F.aggregate(mask(w, LENGTH), F.lit(0), lambda s, x: s + x).cast("long").alias("kept"))


def v17_vocabulary(spark, d):
    return b.corpus_stats(_docs(spark, d), "text").select("vocabulary")


def a12_term_frequency(spark, d):
    return _item_bags(spark, d).select("item", "term", "tf", F.lit(1).alias("binary"))


def a13_corpus_stats(spark, d):
    return b.corpus_stats(_docs(spark, d), "text").select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def a13_document_frequency(spark, d):
    return b.document_frequencies(_doc_bags(spark, d))


def v5_idf(spark, d):
    n = b.corpus_stats(_docs(spark, d), "text").select("n")
    return b.document_frequencies(_doc_bags(spark, d)).crossJoin(F.broadcast(n)).select("term", F.round(b.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def v6_bm25(spark, d):
    return b.best_by_bm25(_queries(spark, d), _stored(spark, d), TOP)


def j17_term_join(spark, d):
    """How many documents' terms each query meets, and the sum of the products of counts: documents are summed by term first."""
    q = _item_bags(spark, d).select(F.col("item").alias("q"), "term", F.col("tf").alias("qf"))
    by_term = _doc_bags(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return q.join(by_term, "term").groupBy("q").agg(F.sum("df").alias("n"), F.sum(F.col("qf") * F.col("tf")).alias("weight"))


def v3_cosine(spark, d):
    return b.best_by_cosine(_queries(spark, d), b.bags_by_item(_docs(spark, d), "doc_id", "text"), TOP)


def v4_jaccard(spark, d):
    return b.best_by_jaccard(_queries(spark, d), b.bags_by_item(_docs(spark, d), "doc_id", "text"), TOP)


def v7_bm25_encoder(spark, d):
    return b.best_by_cosine(_queries(spark, d), b.bags_by_item(_docs(spark, d), "doc_id", "text"), TOP, b.encoder_bags)


def v8_jaccard_encoder(spark, d):
    return b.best_by_cosine(_queries(spark, d), b.bags_by_item(_docs(spark, d), "doc_id", "text"), TOP, b.binary_bags)


def v9_minhash(spark, d):
    return b.minhash(b.bags_by_item(_docs(spark, d), "doc_id", "text")).select("item", F.md5(F.concat_ws(",", F.transform("sig", lambda x: x.cast("string")))).alias("sig"), F.size("sig").alias("width"))


def _projection(spark, d, weigh):
    return b.projected(weigh(_queries(spark, d)), SMALL).select("item", F.posexplode("vec").alias("dim", "x")).select("item", "dim", F.round("x", 6).alias("x"))


def v7_projected(spark, d):
    """The BM25 encoder's vectors in SMALL dimensions."""
    return _projection(spark, d, b.encoder_bags)


def v8_projected(spark, d):
    """The Jaccard encoder's."""
    return _projection(spark, d, b.binary_bags)


def v9_minhash_search(spark, d):
    """The documents whose signatures have the greatest cosine with each item's. Documents' signatures are not stored."""
    signed = lambda rows, key: bags_of(rows, key).select(F.col("item").alias("id"), F.col("sig").alias("vec"))
    bags_of = lambda rows, key: b.minhash(b.bags_by_item(rows, key, "text"))
    return sim.nearest_of_scan(cut(signed(_items(spark, d), "item_id"), "signatures"), signed(_docs(spark, d), "doc_id"), TOP, True).select("q", F.col("c").alias("item"), "score", "rk")


def f10_valid_tokens(spark, d):
    """Token numbers between 100 and 30000 at kept places."""
    w = padded(word_tokens(F.col("text")), LENGTH, F.lit(None).cast("string"))
    ids = _items(spark, d).select("item_id", F.explode(w).alias("w")).filter("w is not null").select("item_id", b.term_number(F.col("w")).alias("id"))
    return ids.filter("id > 100 and id < 30000").groupBy("item_id").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


def w5_lexical_search(spark, d):
    """Free-text query over all documents, the hundred best. One query needs no index: documents are scored where they lie."""
    q = b.bags_by_item(spark.createDataFrame([(0, "the or and ingthe that")], "item_id long, text string"), "item_id", "text")
    return b.best_by_cosine(q, b.bags_by_item(_docs(spark, d), "doc_id", "text"), 100).select("item", "score")


def v10_next_prime(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    primes = {k: b.next_prime(30000 + k * 10) for k in range(25)}
    table = spark.createDataFrame(list(primes.items()), "k long, prime long")  # driver constants
    return n.join(F.broadcast(table), "k")


_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_BAGS = f"dt AS (SELECT doc_id AS item, unnest({_TOK}) AS term FROM documents), qt AS (SELECT item_id AS q, unnest({_TOK}) AS term FROM benchmark), db AS (SELECT item, term, count(*) AS tf FROM dt GROUP BY ALL), qb AS (SELECT q, term, count(*) AS qf FROM qt GROUP BY ALL)"
_STATS = f"st AS (SELECT count(*) AS n, avg(len({_TOK})) AS avgdl FROM documents), df AS (SELECT term, count(*) AS df FROM db GROUP BY term), dl AS (SELECT item, sum(tf) AS dl FROM db GROUP BY item)"
_SIZES = "o AS (SELECT q, item, count(*) AS shared FROM qb JOIN db USING (term) GROUP BY ALL), qs AS (SELECT q, count(*) AS qs FROM qb GROUP BY q), ds AS (SELECT item, count(*) AS ds FROM db GROUP BY item)"


def _best(scores: str) -> str:
    return f"SELECT q, item, score, rk FROM (SELECT q, item, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rk FROM (SELECT q, item, round(score, 6) AS score FROM ({scores}))) WHERE rk <= {TOP}"


def _w(name: str, key: str) -> str:
    return f"{name}r AS (SELECT x.{key}, term, f * 2.2::DOUBLE / (f + 1.2::DOUBLE * greatest(0.5::DOUBLE, 0.25::DOUBLE + 0.75::DOUBLE * l / 100)) + 1e-10 AS w FROM {name} x JOIN (SELECT {key}, sum(f) AS l FROM {name} GROUP BY {key}) USING ({key})), {name}w AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}r)"


_X = "(('0x' || substr(md5(term), 1, 6))::BIGINT % 30011)"
_HF = f"hf AS (SELECT range AS f, 1 + 7919 * (range + 1) % 30010 AS a, 104729 * (range + 1) % 30011 AS b FROM range({b.WIDTH}))"
_SIG = lambda rows, key: f"SELECT {key}, list(h ORDER BY f) AS v FROM (SELECT {key}, f, min((x * a + b) % 30011) AS h FROM (SELECT DISTINCT {key}, {_X} AS x FROM {rows}), hf GROUP BY {key}, f) GROUP BY {key}"


def _projected_sql(weights: str) -> str:
    """Signs, parities of bits and rows as the operator defines them, over the items' weights."""
    return f"""WITH {_BAGS}, qf AS (SELECT q, term, qf AS f FROM qb), {weights}, m AS (SELECT range AS dim, xor(range, range >> 7) * 11291 % 32768 AS r FROM range({SMALL})),
rw AS (SELECT dim, xor(r, r >> 9) AS r FROM m),
t AS (SELECT q, w, x, 1 - 2 * (('0x' || substr(md5(x::VARCHAR), 1, 1))::INT & 1) AS s FROM (SELECT q, w, {_X} AS x FROM qfw))
SELECT q AS item, CAST(dim AS INT) AS dim, round(sum(w * s * (1 - 2 * (bit_count(x & r) & 1))) / sqrt({SMALL}), 6) AS x FROM t, rw GROUP BY q, dim"""


QUERIES = {f.__name__: f for f in (v3_cosine, v4_jaccard, v5_idf, v6_bm25, v7_bm25_encoder, v8_jaccard_encoder, v7_projected, v8_projected, v9_minhash, v9_minhash_search, v10_next_prime, v15_tokens, v16_padded, v17_vocabulary, a12_term_frequency, a13_corpus_stats, a13_document_frequency, j17_term_join, f10_valid_tokens, w5_lexical_search)}
SQL = {
    "v3_cosine": f"WITH {_BAGS}, qn AS (SELECT q, sqrt(sum(qf * qf)) + 1e-8 AS qn FROM qb GROUP BY q), dn AS (SELECT item, sqrt(sum(tf * tf)) + 1e-8 AS dn FROM db GROUP BY item) " + _best("SELECT q, item, sum(qf * tf) / (any_value(qn) * any_value(dn)) AS score FROM qb JOIN db USING (term) JOIN qn USING (q) JOIN dn USING (item) GROUP BY q, item"),
    "v4_jaccard": f"WITH {_BAGS}, {_SIZES} " + _best("SELECT q, item, shared / (qs + ds - shared + 1e-12) AS score FROM o JOIN qs USING (q) JOIN ds USING (item)"),
    "v5_idf": f"WITH {_BAGS}, {_STATS} SELECT term, round(ln(1 + (n::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st",
    "v6_bm25": f"WITH {_BAGS}, {_STATS} " + _best("SELECT q, item, sum(ln(1 + (n::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qb JOIN db USING (term) JOIN df USING (term) JOIN dl USING (item), st GROUP BY q, item"),
    "v7_bm25_encoder": f"WITH {_BAGS}, qf AS (SELECT q, term, qf AS f FROM qb), tf AS (SELECT item, term, tf AS f FROM db), {_w('qf', 'q')}, {_w('tf', 'item')} " + _best("SELECT q, item, sum(a.w * b.w) AS score FROM qfw a JOIN tfw b USING (term) GROUP BY q, item"),
    "v8_jaccard_encoder": f"WITH {_BAGS}, {_SIZES} " + _best("SELECT q, item, shared / sqrt(qs::DOUBLE * ds) AS score FROM o JOIN qs USING (q) JOIN ds USING (item)"),
    "v9_minhash": f"WITH {_BAGS}, {_HF} SELECT item, md5(array_to_string(v, ',')) AS sig, CAST(len(v) AS INT) AS width FROM ({_SIG('db', 'item')})",
    "v7_projected": _projected_sql(_w("qf", "q")),
    "v8_projected": _projected_sql("qfw AS (SELECT q, term, 1 / sqrt(count(*) OVER (PARTITION BY q)) AS w FROM qf)"),
    "v9_minhash_search": f"WITH {_BAGS}, {_HF}, dg AS (SELECT item, CAST(v AS DOUBLE[]) AS v FROM ({_SIG('db', 'item')})), qg AS (SELECT q, CAST(v AS DOUBLE[]) AS v FROM ({_SIG('qb', 'q')})) " + _best("SELECT q, item, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM qg a, dg b"),
    "v15_tokens": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS w FROM documents)",
    "v16_padded": f"SELECT item_id, array_to_string(list_resize(list_slice(w, 1, {LENGTH}), {LENGTH}, '<pad>'), ' ') AS tokens, CAST(least(len(w), {LENGTH}) AS BIGINT) AS kept FROM (SELECT item_id, {_TOK} AS w FROM benchmark)",
    "v17_vocabulary": f"WITH {_BAGS} SELECT count(DISTINCT term) AS vocabulary FROM db",
    "a12_term_frequency": f"WITH {_BAGS} SELECT q AS item, term, qf AS tf, 1 AS binary FROM qb",
    "a13_corpus_stats": f"WITH {_BAGS}, {_STATS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS vocabulary FROM st",
    "a13_document_frequency": f"WITH {_BAGS} SELECT term, count(*) AS df FROM db GROUP BY term",
    "j17_term_join": f"WITH {_BAGS} SELECT q, count(*) AS n, CAST(sum(qf * tf) AS BIGINT) AS weight FROM qb JOIN db USING (term) GROUP BY q",
    "f10_valid_tokens": f"SELECT item_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM (SELECT item_id, ('0x' || substr(md5(w), 1, 6))::BIGINT % 30011 AS id FROM (SELECT item_id, unnest(list_slice({_TOK}, 1, {LENGTH})) AS w FROM benchmark)) WHERE id > 100 AND id < 30000 GROUP BY item_id",
    "w5_lexical_search": f"WITH {_BAGS}, qx AS (SELECT unnest(['the', 'or', 'and', 'ingthe', 'that']) AS term), dn AS (SELECT item, sqrt(sum(tf * tf)) + 1e-8 AS dn FROM db GROUP BY item) SELECT item, round(sum(tf) / ((sqrt(5) + 1e-8) * any_value(dn)), 6) AS score FROM qx JOIN db USING (term) JOIN dn USING (item) GROUP BY item ORDER BY score DESC, item LIMIT 100",
    "v10_next_prime": "WITH c AS (SELECT range AS p FROM range(30000, 30600)), ok AS (SELECT p FROM c WHERE NOT list_bool_or(list_transform(range(2, 175), lambda k: p % k = 0))) SELECT CAST(n_nationkey AS BIGINT) AS k, (SELECT min(p) FROM ok WHERE p >= 30000 + n_nationkey * 10) AS prime FROM nation",
}
