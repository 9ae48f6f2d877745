"""The index against scoring every document, and how much of it a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from lemmaforge.operators import bags, index


@pytest.fixture(scope="module")
def texts(spark):
    """Frequent words in most documents, rare ones in a few; queries with both."""
    rng = random.Random(12)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(1500)] + [(5000, None), (5001, "")]
    items = [(i, " ".join(rng.sample(common, rng.randint(0, 4)) + rng.sample(rare, rng.randint(0, 4)))) for i in range(25)] + [(90, "unknown words"), (91, None), (92, "c0"), (93, "c0 c1 c2")]
    frame = lambda rows: bags.bags_by_item(spark.createDataFrame(rows, "id long, text string"), "id", "text").cache()
    return frame(docs), frame(items)


def rows(frame):
    return sorted((r["q"], r["item"], round(r["score"], 6), r["rk"]) for r in frame.collect())


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_index_finds_the_same_documents(texts, broadcast):
    docs, items = texts
    for weigh in (bags.count_bags, bags.encoder_bags):
        expected = rows(bags.best_documents(bags.query_terms(weigh(items)), weigh(docs), 5))
        made = index.build(weigh(docs), 1502)
        assert expected and rows(index.best(made, bags.query_terms(weigh(items)), 5, max_broadcast=broadcast)) == expected
    expected = rows(bags.best_by_jaccard(items, docs, 4))
    made = index.build(bags.binary_bags(docs), 1502)
    assert rows(index.best(made, bags.query_terms(bags.binary_bags(items)), 4, bags.jaccard_of_cosine, max_broadcast=broadcast)) == expected


def test_most_postings_of_frequent_words_stay_unread(spark, texts):
    docs, items = texts
    size = docs.agg(F.avg("dl").alias("a")).first()
    made = index.build(bags.bm25_bags(docs, size["a"]), 1502)
    rare = items.filter(F.exists("terms", lambda t: t.startswith("r"))).withColumn("terms", F.col("terms"))
    once = bags.query_terms(bags._weighted(rare, lambda tf, dl: F.lit(1.0), None))
    seen = {}
    got = rows(index.best(made, once, 1, idf=lambda df: bags.idf(F.lit(1502), df), seen=seen))
    assert got == rows(bags.best_by_bm25(rare, docs, 1))
    frequent = made.blocks.agg(F.sum("n")).first()[0]
    assert frequent > 10_000 and seen["postings"] > 10_000 and seen["read"] < 0.05 * seen["postings"] and seen["read"] + seen["opening"] < 0.35 * seen["postings"]


def test_blocks_that_are_not_wanted_are_not_opened(texts):
    docs, _ = texts
    made = index.build(bags.count_bags(docs), 1502)
    some = made.postings.filter("zone = 0 and layer = -1")
    assert "PartitionFilters: [isnotnull(zone" in some._jdf.queryExecution().toString() and 0 < some.count() < made.postings.count()


def test_scores_of_too_many_terms_go_through_the_index(texts):
    docs, items = texts
    assert rows(bags.best_documents(bags.query_terms(bags.count_bags(items)), bags.count_bags(docs), 3, max_terms=2)) == rows(bags.best_by_cosine(items, docs, 3))


def test_repeated_ids_are_items_of_their_own(spark):
    frame = spark.createDataFrame([(1, "a b a"), (1, "a"), (None, "b"), (2, None)], "id long, text string")
    got = sorted(((r["item"] or 0, r["dl"], r["term"], r["tf"]) for r in bags.bag(frame, "id", "text").collect()))
    assert got == [(0, 1, "b", 1), (1, 1, "a", 1), (1, 3, "a", 2), (1, 3, "b", 1)]
    assert bags.bags_by_item(frame, "id", "text").count() == 4 and bags.bag(frame.limit(0), "id", "text").count() == 0
