"""The pipeline against its stages by brute force, on a small corpus with every planted case."""

import math
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lemmaforge.llm import pieces, toxicity
from lemmaforge.session import cut as stored
from tests.llm.test_matching import brute_contamination, brute_join, corpus
from tests.llm.test_passages import brute_words
from tests.llm.test_scores import brute_matches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    random.seed(21)
    texts = corpus(5, 150)
    for i in range(30, 150, 4):
        texts[i] = (texts[i] or "") + " you idiot and scum of it"
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short item of words"), (3, None)]
    for i in range(31, 60, 6):
        texts[i] = items[0][1] + " and " + (texts[i] or "")[:40]
    texts[33] = "short ITEM of words, " + " ".join(f"z{i}" for i in range(200))
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in docs if i % 7 != 3]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def brute_toxicity(text, lexicon):
    found = brute_matches(text, lexicon)
    total, n = sum(lexicon.weights[t] for t in found), len(toxicity.fold(text).split())
    x = (math.log1p(total), math.log1p(100 * total / (n + 20)), math.log1p(len(set(found))))
    return 1 / (1 + math.exp(-(lexicon.curve[0] + sum(c * v for c, v in zip(lexicon.curve[1:], x)))))


def brute_groups(left, before):
    """The least id of every component, where texts link as they are now or as they were before. Ids are ascending."""
    views = [(i, t) for i, t in left] + [(i, before[i]) for i, t in left if (t or "").strip() and t != before[i]]
    up = {i: i for i, _ in left}

    def root(i):
        return i if up[i] == i else root(up[i])

    first = {}
    for (i, _), (_, part, _) in zip(views, brute_join([t for _, t in views], 5, 80, 100), strict=True):
        a, b = sorted((root(i), root(first.setdefault(part, i))))
        up[b] = a
    return [x for x in left if root(x[0]) == x[0]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    return at, *tables(spark, at)


def test_pipeline_against_brute_force(spark, folder):
    at, docs, items = folder
    got = {r["doc_id"]: (r["tokens"], r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.run(spark, at).collect()}
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    lexicon = toxicity.fit(read("documents"), read("labels"), ~toxicity.held_out(F.col("doc_id"), 5, 0))
    left = [(i, t) for i, t, *_ in docs if brute_toxicity(t, lexicon) < 0.5]
    assert len(left) < len(docs) and all("idiot" not in (t or "") for _, t in left)
    cut = brute_words(left, 50)
    left = [(i, cut[i][0]) for i, _ in left if cut[i][1] == 0 or cut[i][0].strip()]
    left = brute_groups(left, {i: t for i, t, *_ in docs})
    marks = [brute_contamination(t, items, 13) for _, t in left]
    left = [x for x, (n, hit, _) in zip(left, marks, strict=True) if not (hit > 0 and 20 * hit >= n)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert got == {i: (ids := library.encode(t or ""), len(ids), True) for i, t in left}
    assert 20 < len(left) < len(docs) - 20


def test_stages_keep_columns_and_clean_documents(spark, folder):
    at, docs, _ = folder
    clean = {i: (t, n) for i, t, _, _, n in docs if i in (2, 7)}
    frame = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, at)
        assert frame.columns == COLUMNS
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.filter(F.col("doc_id").isin(list(clean))).collect()}
    assert kept == clean


def test_repeated_rows_leave_one(spark, folder):
    at, *_ = folder
    text = " ".join(f"r{i}" for i in range(30))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, text + " x", "de", "s", 9), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (None, text, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, at).collect()
    assert len([r for r in got if r["text"]]) == 1 and len([r for r in got if r["text"] is None]) == 2


def test_near_copies_go_after_line_dedup(spark, tmp_path):
    """Copies of which one word in sixty, or a stretch at the end, differs: line dedup cuts them, the join still finds them."""
    random.seed(33)
    at, vocabulary = str(tmp_path), [f"n{i}" for i in range(5000)]
    rows, near = [], []
    for i in range(40):
        body = [random.choice(vocabulary) for _ in range(random.choice([120, 400]))]
        copy = list(body)
        if i % 2:
            for k in range(30, len(copy), 60):
                copy[k] = random.choice(vocabulary)
        else:
            copy[-len(copy) // 12 :] = [random.choice(vocabulary) for _ in range(len(copy) // 12)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(copy))]
        near.append(2 * i + 1)
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    frame = spark.read.parquet(f"{at}/documents.parquet")
    linked = [k for k, (_, part, _) in enumerate(brute_join([t for _, t in rows], 5, 80, 100)) if part != k]
    assert len(linked) >= 0.9 * len(near)
    cleaned = stored(corpus_pipeline.cut_repeated_lines(spark, frame, at), "cleaned")
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, cleaned, at).collect()}
    assert not kept & set(linked) and kept >= {2 * i for i in range(40)}


def test_stages_keep_columns_named_like_helpers(spark, folder):
    at, *_ = folder
    names = ("jj_row", "JJ_nth", "toxic_score", "words_removed", "words_removed_")
    text = " ".join(f"r{i}" for i in range(60))
    rows = [(1, text, "en", "s", 9), (2, text + " more " + text, "en", "s", 9), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.concat(F.lit(f"own {n} "), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:3]:
        done = stage(spark, docs, at)
        got = done.collect()
        assert done.columns == docs.columns and got, name
        assert all(r[n] == f"own {n} {r['doc_id']}" for r in got for n in names), name


@pytest.mark.parametrize("gone", [("documents", "labels", "benchmark"), ("documents",), ("labels", "benchmark")])
def test_empty_tables(spark, folder, tmp_path, gone):
    """Without documents nothing is left; without labels and benchmark the first and fourth stage keep everything."""
    at, docs, _ = folder
    for t in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{at}/{t}.parquet")
        (rows.limit(0) if t in gone else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    if "documents" in gone:
        assert got.count() == 0
        return
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stored(corpus_pipeline.one_of_each_group(spark, stored(corpus_pipeline.cut_repeated_lines(spark, frame, str(tmp_path)), "cut"), str(tmp_path)), "kept")
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in kept.collect()} and kept.count() > 0
