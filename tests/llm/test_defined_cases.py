"""Repeated rows over files, ids near the end of 64 bits, versions written twice, and bounds of fits."""

import random

import pytest
from pyspark.sql import functions as F

from lemmaforge.llm import labelled, quality, shard, syncmers, toxicity, warc
from lemmaforge.llm.registry import oracle_sql, queries
from tests.oracle import by_spark, by_sql


def test_one_response_where_its_page_is_in_several_files(spark, tmp_path):
    big = "<p>" + "same " * 40
    path = str(tmp_path / "pages.parquet")
    for i in range(6):
        rows = [(1, "u", big), (10 + i, f"v{i}", big), (100, "w", "short"), (None, "n", big)]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(1, "a", big), (7, "x", "y" * 200), (7, None, "y" * 200)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(path)
    for url, copies in (("a", 1), ("u", 6)):  # the least url is the response, also where it is the repeated one
        pages = spark.read.parquet(path)
        pages = pages if url == "a" else pages.filter("url <> 'a' or url is null")
        got = warc.read_archives(warc.write_archives(pages)).collect()
        of_big = [r for r in got if r["payload_bytes"] == len(big)]
        responses = [r for r in of_big if r["record_type"] == "response"]
        assert len(of_big) == (19 if url == "a" else 18) and [(r["page_id"], r["url"]) for r in responses] == [(1, url)]
        assert all(r["refers_to"] == 1 for r in of_big if r["record_type"] == "revisit")
        assert sorted((r["url"] or "", r["record_type"]) for r in got if r["page_id"] == 7) == [("", "response"), ("x", "revisit")]
        assert [r["record_type"] for r in got if r["page_id"] == 100] == ["response"] * 6
    assert by_spark(queries()["op10_warc"](spark, str(tmp_path))) == by_sql(oracle_sql()["op10_warc"], str(tmp_path))


def test_equal_payloads_without_ids(spark):
    pages = spark.createDataFrame([(None, "a", "z" * 150), (None, "b", "z" * 150)], "page_id long, url string, html string")
    assert [r["record_type"] for r in warc.read_archives(warc.write_archives(pages)).collect()] == ["response"] * 2


def test_fingerprints_of_ids_near_the_end_of_64_bits(spark, tmp_path):
    rng, top = random.Random(2), 2**63 - 1
    words = ["a", "bb", "ccc", "dd"]
    ids = [top - i for i in range(40)] + [-(2**63), 0]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in syncmers.op9_syncmers(spark, str(tmp_path)).collect()}
    texts, order = dict(rows), sorted(ids)
    import hashlib

    for i, k in enumerate(order):
        own, after = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(own) // 2
        assert got[k]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()


def test_anchors_of_text_without_spaces(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghij", k=2000))
    edits = [(0, text), (1, text[:5] + "X" + text[5:]), (2, "".join(rng.choices("abcdefghij", k=2000)))]
    at = {r["i"]: r["a"] for r in spark.createDataFrame(edits, "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("a")).collect()}
    sets = {i: {x["hash"] for x in a} for i, a in at.items()}
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.98 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.1
    assert spark.range(1).select(F.size(syncmers.words(F.lit("ab " + "x" * 18 + " c")))).first()[0] == 1 + 2 + 1 + 1


def test_map_versions_are_written_once(spark, tmp_path):
    path = str(tmp_path / "map")
    one = shard.in_turn([1] * 8, [1] * 8, 2)
    one.save(spark, path)
    with pytest.raises(Exception, match="exist"):
        one.save(spark, path)
    assert shard.SlotMap.load(spark, path) == one
    one.frame(spark).drop("version").limit(3).write.mode("append").parquet(f"{path}/version=1")  # what a foreign writer might do
    with pytest.raises(ValueError, match="version 1 .* each slot once"):
        shard.SlotMap.load(spark, path)


def test_bound_of_the_fits_counts_joined_rows(spark):
    repeated = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    equal = spark.range(3000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    docs = repeated.unionByName(equal).unionByName(spark.createDataFrame([(9, None), (10, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (9, 1, 0), (10, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    got = labelled.labelled(docs, labels, "quality", F.lit(True), 500).collect()
    assert 400 < len(got) <= 500 and got.count(got[0]) == 1 and sum(r["text"] == "one text" for r in got) <= 1
    assert labelled.labelled(docs, labels, "quality", F.lit(True), 10_000).count() == 6002
    assert isinstance(quality.fit(docs, labels, F.lit(True), 200), quality.RuleModel)
    assert isinstance(toxicity.fit(docs, labels, F.lit(True), 200), toxicity.Lexicon)
