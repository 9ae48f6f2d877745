"""Scans, filters, flattening, splits, pairs and statistics. `conversations` are papers: user turns are lemmas, assistant
turns theorems, in order of turn."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge import schemas
from lemmaforge.functions.text import word_tokens
from lemmaforge.operators import corpus as c
from lemmaforge.session import fresh_path
from lemmaforge.sources import jsonl, shards

SEED = 42
BATCH = 16


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _papers(spark, d):
    """index, lemmas, theorems."""
    kinds = {"user": "lemmas", "assistant": "theorems"}
    ordered = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"])
    return _turns(spark, d).groupBy(F.col("conv_id").alias("index")).agg(*[ordered(r).alias(k) for r, k in kinds.items()])


def _lines(spark, d, bad: bool):
    """JSONL files of the turns, with blank lines and, if asked for, a malformed one after every tenth turn. A turn's edges
    are as many as its number modulo three."""
    pair = F.struct(F.col("role").alias("from"), F.col("turn").cast("string").alias("to"))
    edges = F.array_repeat(pair, (F.col("turn") % 3).cast("int")).alias("edges")
    rows = _turns(spark, d).select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text", edges)).alias("value"))
    extra = rows.filter("turn = 1 and conv_id % 10 = 3").select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit('{"conv_id": 1, "tu').alias("value"))
    blank = rows.filter("turn = 0 and conv_id % 7 = 2").select("conv_id", F.lit(98).cast("long").alias("turn"), F.lit("  ").alias("value"))
    all_rows = rows.unionByName(blank).unionByName(extra) if bad else rows.unionByName(blank)
    path = fresh_path(spark, "lines")
    all_rows.orderBy("conv_id", "turn").select("value").write.text(path)
    return path


_TURN = "conv_id bigint, turn bigint, role string, text string"


def s1_strict_scan(spark, d):
    return jsonl.read_strict(spark, _lines(spark, d, False), _TURN)


def s2_scan_with_errors(spark, d):
    r = jsonl.read_with_errors(spark, _lines(spark, d, True), _TURN)
    return r.select("index", "conv_id", "turn", F.col("error").isNotNull().alias("failed"))


def s3_lenient_scan(spark, d):
    r = jsonl.read_lenient(spark, _lines(spark, d, True), _TURN)
    return r.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count("text").alias("texts"))


def s4_edge_scan(spark, d):
    """Malformed lines count as records without edges."""
    r = jsonl.read_lenient(spark, _lines(spark, d, True), "conv_id bigint, turn bigint, edges array<struct<from:string,to:string>>")
    return r.select("index", F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"))


def s5_training_scan(spark, d):
    path = fresh_path(spark, "training")
    jsonl.write_lines(_papers(spark, d), path, "index")
    r = jsonl.read_strict(spark, path, f"index bigint, {schemas.PAPER}")
    return r.select("index", F.coalesce(F.size("lemmas"), F.lit(0)).alias("lemmas"), F.coalesce(F.size("theorems"), F.lit(0)).alias("theorems"))


def _stored_shards(spark, d):
    path = fresh_path(spark, "shards")
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("label").alias("paper_id"), "embedding")
    shards.write_embeddings(v, path, "bert-base", "toy", "eval")
    return path


def s6_shard_scan(spark, d):
    v = shards.precomputed(spark, _stored_shards(spark, d), "bert-base", "toy", "eval")
    return v.select("id", F.posexplode("embedding").alias("dim", "x")).select("id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def s7_id_text(spark, d):
    o = spark.read.parquet(f"{d}/nation.parquet")
    return o.select(
        F.col("n_nationkey").cast("long").alias("k"), shards.id_text(F.encode("n_name", "UTF-8"), "binary").alias("of_bytes"),
        shards.id_text(F.col("n_nationkey"), "bigint").alias("of_number"), shards.id_text(F.array("n_nationkey", "n_regionkey"), "array<int>").alias("of_pair"),
    )


def s8_precomputed(spark, d):
    path = _stored_shards(spark, d)
    found = shards.precomputed(spark, path, "bert-base", "toy", "eval")
    missing = shards.precomputed(spark, path, "bert-base", "full", "eval")
    return found.select("id", F.size("embedding").alias("numbers"), F.lit(missing is None).alias("missing"))


def s9_listing(spark, d):
    return shards.datasets(spark, d).select("name", (F.col("mb") > 0).alias("has_size"))


def s10_dataset(spark, d):
    path = fresh_path(spark, "dataset")
    jsonl.write_lines(_papers(spark, d), path)
    first, second = shards.dataset(spark, path, schemas.PAPER), shards.dataset(spark, path, schemas.PAPER)
    return second.agg(F.count("*").alias("n")).withColumn("same", F.lit(first.sameSemantics(second) and second.storageLevel.useMemory))


def s11_scale_variants(spark, d):
    """Lines in each size's variant."""
    numbered = jsonl.raw_lines(spark, _lines(spark, d, False)).filter(F.trim("line") != "")
    sizes = [(k, shards.SIZES[k] or 2**62) for k in shards.SIZES]
    t = spark.createDataFrame(sizes, "size string, most long")  # five rows
    return numbered.crossJoin(F.broadcast(t)).filter("index < most").groupBy("size").agg(F.count("*").alias("n"))


def s13_models(spark, d):
    """A model for each label, beside folders without files of a known kind."""
    path = fresh_path(spark, "models")
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    v.select("vec_id", F.concat(F.lit("enc-"), "label").alias("model"), F.lit("toy").alias("size")).write.partitionBy("model", "size").parquet(f"{path}/embeddings")
    v.select(F.col("label").cast("string").alias("value")).write.text(f"{path}/notes")
    return shards.models(spark, path).select("model", "title", "projection", "adapter", "embeddings")


def k1_line_sink(spark, d):
    path = fresh_path(spark, "sink")
    jsonl.write_lines(_turns(spark, d).select("conv_id", "turn"), path)
    return spark.read.schema("conv_id bigint, turn bigint").json(path)


def k2_ordered_sink(spark, d):
    path = fresh_path(spark, "ordered")
    rows = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("key"))
    jsonl.write_lines(rows, path, "key")
    return jsonl.raw_lines(spark, path).select(F.from_json("line", "key bigint")["key"].alias("key"), F.col("index").alias("place"))


def k3_non_empty_sink(spark, d):
    path = fresh_path(spark, "filled")
    jsonl.write_non_empty(_papers(spark, d).filter("index % 5 <> 1").unionByName(_papers(spark, d).filter("index % 5 = 1").withColumns({"lemmas": F.expr("cast(array() as array<string>)"), "theorems": F.expr("cast(array() as array<string>)")})), path, ["lemmas", "theorems"])
    return spark.read.schema("index bigint").json(path)


def k4_no_overwrite(spark, d):
    path = fresh_path(spark, "guard")
    rows = _turns(spark, d).select("conv_id")
    jsonl.write_lines(rows, path)
    try:
        jsonl.write_lines(rows, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    jsonl.write_lines(rows, path, overwrite=True)
    return spark.read.schema("conv_id bigint").json(path).withColumn("refused", F.lit(refused))


def k5_embedding_sink(spark, d):
    """Every stored id with its paper and the number of its components, beside the info row."""
    path = _stored_shards(spark, d)
    info = shards.store(spark, path, "info", model="bert-base", size="toy", split="eval").select("model", "size", "split", "n", F.col("dim").cast("long").alias("dim"))
    return shards.store(spark, path, model="bert-base", size="toy", split="eval").select("id", "paper_id", F.size("embedding").alias("numbers")).crossJoin(F.broadcast(info))  # one row


def k6_edge_array(spark, d):
    t = _turns(spark, d)
    edges = t.filter("turn > 0").select(F.col("conv_id").alias("index"), F.col("turn").alias("place"), (F.col("turn") - 1).cast("string").alias("from"), F.col("turn").cast("string").alias("to"), F.lit("a").alias("from_text"), F.col("role").alias("to_text"))
    records = t.select(F.col("conv_id").alias("index")).distinct()
    paths = {form: fresh_path(spark, form) for form in ("plain", "wrapped")}
    for form, path in paths.items():
        jsonl.write_edges(edges, path, form == "wrapped", records)
    plain, wrapped = (spark.read.text(path).select(F.lit(form).alias("form"), F.col("value").alias("line")) for form, path in paths.items())
    return plain.unionByName(wrapped)


def k7_histogram(spark, d):
    return c.histogram(_turns(spark, d).select(F.length("text").alias("n")), "n")


def f1_math_category(spark, d):
    cats = F.concat_ws(" ", F.lower("p_type"), F.concat(F.lit("math."), F.substring("p_brand", 7, 2)), F.lit("cs.LG"))
    odd = F.when(F.col("p_partkey") % 3 == 0, F.lit("hep-th Math.AG")).when(F.col("p_partkey") % 3 == 1, cats).otherwise(F.lit("cs.LG stat.ML"))
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", odd.alias("categories"))
    return p.filter(F.exists(F.split("categories", " "), lambda x: F.lower(x).startswith("math."))).select("p_partkey")


def f2_path_split(spark, d):
    parts = F.split("url", "/")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", parts.alias("p")).filter(F.size("p") >= 2).select("page_id", F.element_at("p", -2).alias("paper"), F.element_at("p", -1).alias("file"))


def f3_extension(spark, d):
    name = F.concat("role", F.when(F.col("turn") % 3 == 0, ".tex").when(F.col("turn") % 3 == 1, ".TEX").otherwise(".bib"))
    return _turns(spark, d).select("conv_id", "turn", name.alias("file")).filter(F.col("file").endswith(".tex"))


def f5_two_statements(spark, d):
    return _papers(spark, d).filter(F.size(F.concat("lemmas", "theorems")) >= 2).select("index")


def f6_one_statement(spark, d):
    return _papers(spark, d).filter(F.size(F.concat("lemmas", "theorems")) >= 1).select("index")


def f7_usable_items(spark, d):
    mixed = F.array(F.col("text"), F.lit(None).cast("string"), F.lit(" \t"), F.col("role"))
    return _turns(spark, d).select("conv_id", "turn", F.size(c.usable(mixed)).alias("n"))


def f8_empty_papers(spark, d):
    """Papers of every fifth conversation have blank items only."""
    items = F.concat("lemmas", "theorems")
    n = F.size(c.usable(F.when(F.col("index") % 5 == 1, F.transform(items, lambda x: F.lit(" "))).otherwise(items)))
    return _papers(spark, d).agg(F.count("*").alias("papers"), F.count_if(n == 0).alias("empty"), F.sum(n).alias("items"))


def f9_eligible(spark, d):
    return c.items(_papers(spark, d)).groupBy("paper").agg(F.count("*").alias("n")).filter("n >= 4")


def f11_unified(spark, d):
    """Even papers come in the new format, odd ones in the old."""
    given = F.when(F.col("index") % 2 == 0, c.statements(F.col("lemmas"), F.col("theorems"), theorems_first=True))
    s = c.statements(F.col("lemmas"), F.col("theorems"), given)
    return _papers(spark, d).select("index", F.posexplode(s).alias("place", "s")).select("index", "place", F.col("s.type").alias("type"), F.md5("s.text").alias("digest"))


def f12_summary(spark, d):
    s = c.statements(F.col("lemmas"), F.col("theorems"))
    return _papers(spark, d).select("index", c.count_of(s, "theorem").alias("theorems"), c.count_of(s, "lemma").alias("lemmas"), F.size(s).alias("total"))


def f13_point_lookup(spark, d):
    return _papers(spark, d).filter("index = 5").select("index", F.size("lemmas").alias("lemmas"), F.size("theorems").alias("theorems"))


def f14_search_rows(spark, d):
    return c.search_text(_turns(spark, d), "THE", ["conv_id", "turn"])[1].select("conv_id", "turn")


def f14_search_count(spark, d):
    return c.search_text(_turns(spark, d), "THE", ["conv_id", "turn"])[0]


def f16_items(spark, d):
    return c.items(_papers(spark, d)).select("id", "paper", "kind", "idx", F.md5("text").alias("digest"))


def f17_paper_of_id(spark, d):
    return c.items(_papers(spark, d)).select("id", c.paper_of(F.col("id")).alias("paper"))


def f18_split_items(spark, d):
    """Statements with their paper's place inside its split."""
    s = c.split_papers(_papers(spark, d), "index")
    numbered = c.positions(s.select("index", "split"), "index", "split", "place")
    return c.items(s).select("paper", "id").join(numbered, F.col("paper") == F.col("index")).select("split", "place", "id")


def w9_split(spark, d):
    return c.split_papers(_papers(spark, d).select("index"), "index")


def _pairs(spark, d, epoch: int):
    s = _turns(spark, d).select(F.col("conv_id").alias("paper"), F.col("turn").alias("stmt"))
    return c.shuffled(c.pair_up(s, "paper", "stmt", SEED, epoch), ["paper", "pair"], SEED, epoch)


def w10_pairs(spark, d):
    return _pairs(spark, d, 0)


def w12_epoch_pairs(spark, d):
    return _pairs(spark, d, 3)


def w11_eval_pairs(spark, d):
    s = F.concat("lemmas", "theorems")
    return _papers(spark, d).filter(F.size(s) >= 2).select("index", F.md5(s[0]).alias("x"), F.md5(s[1]).alias("y"))


def w13_global_index(spark, d):
    order = Window.partitionBy("conv_id").orderBy(F.col("turn") % 3, "turn")
    return _turns(spark, d).select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("index"))


def w15_modulo_shards(spark, d):
    lines = jsonl.raw_lines(spark, _lines(spark, d, False))
    return lines.groupBy((F.col("index") % 4).alias("worker")).agg(F.count("*").alias("n"))


def w17_full_batches(spark, d):
    return c.full_batches(_pairs(spark, d, 0), "place", BATCH).select("paper", "pair", "place", "batch")


def w18_sample(spark, d):
    return c.sample_of(_papers(spark, d).select("index"), "index", 1000)


def a20_length_stats(spark, d):
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.size(word_tokens(F.col("text"))).cast("long").alias("n"))
    return c.length_stats(words, "n")


def u1_bag_union(spark, d):
    s = F.concat("lemmas", "theorems")
    return _papers(spark, d).select("index", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


def u3_shard_union(spark, d):
    t = _turns(spark, d).select("conv_id", "turn")
    return t.filter("conv_id % 2 = 0").unionByName(t.filter("conv_id % 2 = 1"))


def u5_merged_names(spark, d):
    base, more = F.array(F.lit("theorem"), F.lit("lemma")), F.array_sort(F.collect_set("role"))
    return _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.array_distinct(F.concat(base, more, base)), ",").alias("names"))


def u6_paper_minus_self(spark, d):
    t = _turns(spark, d).select("conv_id", "turn")
    every = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("all"))
    return t.join(every, "conv_id").select("conv_id", "turn", F.array_join(F.array_except("all", F.array("turn")).cast("array<string>"), ",").alias("others"))


_P = "p AS (SELECT conv_id AS index, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS lemmas, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS theorems FROM conversations GROUP BY conv_id)"
_I = "i AS (SELECT conv_id AS paper, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) - 1 AS idx, text FROM (SELECT *, CASE role WHEN 'user' THEN 'lemma' ELSE 'theorem' END AS kind FROM conversations WHERE role IN ('user', 'assistant')))"
_L = "l AS (SELECT conv_id, turn, 0 AS bad FROM conversations UNION ALL SELECT conv_id, 98, 2 FROM conversations WHERE turn = 0 AND conv_id % 7 = 2 UNION ALL SELECT conv_id, 99, 1 FROM conversations WHERE turn = 1 AND conv_id % 10 = 3), n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM l)"
_NUM = "c AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS rn, count(*) OVER () AS n FROM c), sp AS (SELECT conv_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM k)"


def _pair_sql(seed: int) -> str:
    return f"""WITH r AS (SELECT conv_id AS paper, turn AS stmt, row_number() OVER (PARTITION BY conv_id ORDER BY md5('{seed}:' || conv_id || ':' || turn), turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT * FROM r WHERE n > 1 UNION ALL SELECT paper, stmt, n + 1, n FROM r WHERE n > 1 AND rn = 1 AND n % 2 = 1),
p AS (SELECT paper, (rn - 1) // 2 AS pair, min_by(stmt, rn) AS x, max_by(stmt, rn) AS y FROM b GROUP BY ALL)
SELECT paper, pair, x, y, row_number() OVER (ORDER BY md5('{seed}:pair:' || paper || ':' || pair), paper, pair) - 1 AS place FROM p"""


QUERIES = {f.__name__: f for f in (s1_strict_scan, s2_scan_with_errors, s3_lenient_scan, s4_edge_scan, s5_training_scan, s6_shard_scan, s7_id_text, s8_precomputed, s9_listing, s10_dataset, s11_scale_variants, s13_models, k1_line_sink, k2_ordered_sink, k3_non_empty_sink, k4_no_overwrite, k5_embedding_sink, k6_edge_array, k7_histogram, f1_math_category, f2_path_split, f3_extension, f5_two_statements, f6_one_statement, f7_usable_items, f8_empty_papers, f9_eligible, f11_unified, f12_summary, f13_point_lookup, f14_search_rows, f14_search_count, f16_items, f17_paper_of_id, f18_split_items, w9_split, w10_pairs, w11_eval_pairs, w12_epoch_pairs, w13_global_index, w15_modulo_shards, w17_full_batches, w18_sample, a20_length_stats, u1_bag_union, u3_shard_union, u5_merged_names, u6_paper_minus_self)}
SQL = {
    "s1_strict_scan": "SELECT conv_id, turn, role, text FROM conversations",
    "s2_scan_with_errors": f"WITH {_L} SELECT index, CASE bad WHEN 0 THEN conv_id END AS conv_id, CASE bad WHEN 0 THEN turn END AS turn, bad = 1 AS failed FROM n WHERE bad <> 2",
    "s3_lenient_scan": f"WITH {_L} SELECT count(*) AS n, count(*) FILTER (bad = 1) AS bad, count(*) FILTER (bad = 0) AS texts FROM n WHERE bad <> 2",
    "s4_edge_scan": f"WITH {_L} SELECT index, CASE bad WHEN 0 THEN CAST(turn % 3 AS INT) ELSE 0 END AS n_edges FROM n WHERE bad <> 2",
    "s5_training_scan": f"WITH {_P} SELECT index, len(lemmas) AS lemmas, len(theorems) AS theorems FROM p",
    "s6_shard_scan": "SELECT 'v' || vec_id AS id, CAST(unnest(range(len(embedding))) AS INT) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings",
    "s7_id_text": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS of_bytes, CAST(n_nationkey AS VARCHAR) AS of_number, n_nationkey || ',' || n_regionkey AS of_pair FROM nation",
    "s8_precomputed": "SELECT 'v' || vec_id AS id, CAST(len(embedding) AS INT) AS numbers, true AS missing FROM embeddings",
    "s9_listing": "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS name, true AS has_size",
    "s10_dataset": "SELECT count(DISTINCT conv_id) AS n, true AS same FROM conversations",
    "s11_scale_variants": "WITH l AS (SELECT conv_id, turn, 0 AS b FROM conversations UNION ALL SELECT conv_id, 98, 1 FROM conversations WHERE turn = 0 AND conv_id % 7 = 2), n AS (SELECT b, row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM l) SELECT size, count(*) AS n FROM n, (VALUES ('toy', 200), ('tiny', 1000), ('small', 10000), ('medium', 100000), ('full', 4611686018427387904)) t(size, most) WHERE b = 0 AND index < most GROUP BY size",
    "s13_models": "SELECT DISTINCT 'enc-' || label AS model, 'Enc ' || label AS title, false AS projection, false AS adapter, true AS embeddings FROM embeddings",
    "k1_line_sink": "SELECT conv_id, turn FROM conversations",
    "k2_ordered_sink": "SELECT conv_id * 100 + turn AS key, row_number() OVER (ORDER BY conv_id * 100 + turn) - 1 AS place FROM conversations",
    "k3_non_empty_sink": f"WITH {_P} SELECT index FROM p WHERE index % 5 <> 1 AND len(lemmas) + len(theorems) > 0",
    "k4_no_overwrite": "SELECT conv_id, true AS refused FROM conversations",
    "k5_embedding_sink": "SELECT 'v' || vec_id AS id, label AS paper_id, CAST(len(embedding) AS INT) AS numbers, 'bert-base' AS model, 'toy' AS size, 'eval' AS split, count(*) OVER () AS n, CAST(max(len(embedding)) OVER () AS BIGINT) AS dim FROM embeddings",
    "k6_edge_array": """WITH e AS (SELECT conv_id, '[' || coalesce(string_agg('["' || (turn - 1) || '","a","' || turn || '","' || role || '"]', ',' ORDER BY turn) FILTER (WHERE turn > 0), '') || ']' AS line FROM conversations GROUP BY conv_id)
SELECT 'plain' AS form, line FROM e UNION ALL SELECT 'wrapped', '{"index":' || conv_id || ',"edges":' || line || '}' FROM e""",
    "k7_histogram": "WITH n AS (SELECT length(text) AS n FROM conversations), e AS (SELECT min(n) AS lo, max(n) AS hi FROM n) SELECT CAST(least(floor((n - lo) * 50 / greatest(hi - lo, 1)), 49) AS INT) AS bin, count(*) AS n FROM n, e GROUP BY 1",
    "f1_math_category": "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 2",
    "f2_path_split": "SELECT page_id, string_split(url, '/')[-2] AS paper, string_split(url, '/')[-1] AS file FROM pages WHERE len(string_split(url, '/')) >= 2",
    "f3_extension": "SELECT conv_id, turn, role || '.tex' AS file FROM conversations WHERE turn % 3 = 0",
    "f5_two_statements": f"WITH {_P} SELECT index FROM p WHERE len(lemmas) + len(theorems) >= 2",
    "f6_one_statement": f"WITH {_P} SELECT index FROM p WHERE len(lemmas) + len(theorems) >= 1",
    "f7_usable_items": "SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN 2 ELSE 1 END AS n FROM conversations",
    "f8_empty_papers": f"WITH {_P} SELECT count(*) AS papers, count(*) FILTER (index % 5 = 1 OR len(lemmas) + len(theorems) = 0) AS empty, CAST(sum(len(lemmas) + len(theorems)) FILTER (index % 5 <> 1) AS BIGINT) AS items FROM p",
    "f9_eligible": f"WITH {_I} SELECT paper, count(*) AS n FROM i GROUP BY paper HAVING count(*) >= 4",
    "f11_unified": f"WITH {_I} SELECT paper AS index, CAST(row_number() OVER (PARTITION BY paper ORDER BY CASE WHEN paper % 2 = 0 THEN kind = 'lemma' ELSE kind = 'theorem' END, idx) - 1 AS INT) AS place, kind AS type, md5(text) AS digest FROM i",
    "f12_summary": f"WITH {_P} SELECT index, len(theorems) AS theorems, len(lemmas) AS lemmas, len(theorems) + len(lemmas) AS total FROM p",
    "f13_point_lookup": f"WITH {_P} SELECT index, len(lemmas) AS lemmas, len(theorems) AS theorems FROM p WHERE index = 5",
    "f14_search_rows": "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 100",
    "f14_search_count": "SELECT count(*) AS n FROM conversations WHERE contains(lower(text), 'the')",
    "f16_items": f"WITH {_I} SELECT paper || '-' || kind || '-' || idx AS id, paper, kind, CAST(idx AS INT) AS idx, md5(text) AS digest FROM i",
    "f17_paper_of_id": f"WITH {_I} SELECT paper || '-' || kind || '-' || idx AS id, paper FROM i",
    "f18_split_items": f"WITH {_NUM}, {_I}, q AS (SELECT conv_id, split, row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS place FROM sp) SELECT split, place, paper || '-' || kind || '-' || idx AS id FROM i JOIN q ON q.conv_id = paper",
    "w9_split": f"WITH {_NUM} SELECT conv_id AS index, split FROM sp",
    "w10_pairs": _pair_sql(42),
    "w12_epoch_pairs": _pair_sql(45),
    "w11_eval_pairs": f"WITH {_P} SELECT index, md5(list_concat(lemmas, theorems)[1]) AS x, md5(list_concat(lemmas, theorems)[2]) AS y FROM p WHERE len(lemmas) + len(theorems) >= 2",
    "w13_global_index": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, turn) - 1 AS index FROM conversations",
    "w15_modulo_shards": "WITH l AS (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, 98 FROM conversations WHERE turn = 0 AND conv_id % 7 = 2), n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS index FROM l) SELECT index % 4 AS worker, count(*) AS n FROM n GROUP BY 1",
    "w17_full_batches": f"WITH o AS ({_pair_sql(42)}) SELECT paper, pair, place, place // {BATCH} AS batch FROM o WHERE place // {BATCH} < (SELECT count(*) // {BATCH} FROM o)",
    "w18_sample": "SELECT index FROM (SELECT DISTINCT conv_id AS index FROM conversations) ORDER BY md5('42:' || index), index LIMIT 1000",
    "a20_length_stats": "WITH w AS (SELECT CAST(len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS rn, count(*) OVER () AS t FROM w) SELECT count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, "
    + ", ".join(f"max(n) FILTER (rn = CAST(floor(t * {p} / 100) AS BIGINT)) AS p{p}" for p in (50, 75, 90, 95, 99))
    + ", " + ", ".join(f"count(*) FILTER (n <= {k}) AS fit{k}" for k in (128, 256, 512)) + " FROM s",
    "u1_bag_union": f"WITH {_P} SELECT index, len(lemmas) + len(theorems) AS n, md5(array_to_string(list_concat(lemmas, theorems), '|')) AS digest FROM p",
    "u3_shard_union": "SELECT conv_id, turn FROM conversations",
    "u5_merged_names": "SELECT conv_id, 'theorem,lemma,' || string_agg(role, ',' ORDER BY role) AS names FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id",
    "u6_paper_minus_self": "SELECT a.conv_id, a.turn, coalesce(string_agg(b.turn::VARCHAR, ',' ORDER BY b.turn), '') AS others FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY a.conv_id, a.turn",
}
