"""Numbers against NumPy, rules against loops, and options that the catalog does not reach."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaforge.functions import latex as L
from lemmaforge.functions.merger import code_of
from lemmaforge.operators import bags, bundles, corpus, dag, encoders, ordinals, similarity
from lemmaforge.plans import retrieval
from lemmaforge.sources import jsonl, shards


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(40, 8))
    y = 0.9 * x + 0.1 * rng.normal(size=(40, 8))
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(40)]
    return x, y, spark.createDataFrame(rows, "id long, x array<double>, y array<double>")


def test_tiled_loss_and_gradients(pairs):
    x, y, frame = pairs
    tau, n = 0.1, len(x)
    s = x @ y.T / tau
    a, b = np.log(np.exp(s).sum(1)), np.log(np.exp(s).sum(0))
    for block in (7, 64):
        got = similarity.symmetric_loss(frame, tau, block).first()
        assert got["n"] == n and abs(got["loss"] - (a.sum() + b.sum() - 2 * np.trace(s)) / (2 * n)) < 1e-9
    w = np.exp(s - a[:, None]) + np.exp(s - b[None, :]) - 2 * np.eye(n)
    gx, gy = w @ y / (2 * n * tau), w.T @ x / (2 * n * tau)
    for r in similarity.loss_gradients(frame, tau, 9).collect():
        assert abs(r["gx"] - gx[r["id"], r["dim"]]) < 1e-9 and abs(r["gy"] - gy[r["id"], r["dim"]]) < 1e-9


def test_log_sum_exp_of_large_scores(spark):
    x = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    y = spark.createDataFrame([(0, [1000.0]), (1, [1001.0])], "id long, vec array<double>")
    assert abs(similarity.log_normalisers(x, y, 1.0, 1).first()["lse"] - 1001.3132616875182) < 1e-9


def test_ranks_with_ties_and_without_positives(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 3, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, grp int, vec array<double>")
    assert {r["id"]: r["rank"] for r in similarity.first_positive_ranks(v, 2).collect()} == {0: 1, 1: 1, 2: None, 3: None}


def test_parity_comment_rule(spark):
    random.seed(5)
    lines = ["".join(random.choice("ab\\%") for _ in range(random.randrange(12))) for _ in range(500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    for r in frame.select("t", L.without_comments(F.col("t")).alias("c")).collect():
        assert r["c"] == code_of(r["t"]), r["t"]


def test_runs_restart(spark):
    keys = ["a", "a", "b", "a", None, None, "c"] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    got = {r["i"]: r["run"] for r in bundles.runs(rows, "k", "i").collect()}
    want, run = {}, 0
    for i, k in enumerate(keys):
        run += int(i > 0 and k != keys[i - 1])
        want[i] = run
    assert got == want


def test_percentile_rank_rule(spark):
    r = corpus.length_stats(spark.range(1, 101).select(F.col("id").alias("n")), "n").first()
    assert (r["p50"], r["p99"], r["fit128"], r["least"], r["most"]) == (51, 100, 100, 1, 100)


def test_pair_counts(spark):
    rows = spark.createDataFrame([(p, s) for p in (1, 2, 3) for s in range(p)], "paper long, stmt long")
    got = {r["paper"]: r["n"] for r in corpus.pair_up(rows, "paper", "stmt").groupBy("paper").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 1, 3: 2}


def test_bad_ids_raise(spark):
    with pytest.raises(Exception, match="not an item id"):
        spark.createDataFrame([("x",)], "id string").select(corpus.paper_of(F.col("id"))).collect()


def test_bad_lines_fail_the_strict_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path), "a int").collect()
    assert [r["error"] is None for r in jsonl.read_with_errors(spark, str(tmp_path), "a int").orderBy("index").collect()] == [True, False]


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = jsonl.raw_lines(spark, str(tmp_path / "n.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(int(r["line"]) == r["index"] for r in rows) and len(rows) == 5000


def test_uneven_shards_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<float>").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError):
        shards.read_shards(spark, str(tmp_path / "s"))


def record(spark, *texts):
    return spark.createDataFrame([(0, ["m.tex"] * len(texts), list(texts))], "index long, filenames array<string>, latex array<string>")


def edges(graph):
    return sorted((r["from"], r["to"]) for r in graph.edges.collect() if not r["from"].startswith("proof#"))


def test_header_beats_stack_and_remarks_cannot_be_proved(spark):
    text = r"\begin{lemma}\label{a}x\end{lemma}\begin{theorem}\label{b}y\end{theorem}\begin{remark}\label{r}z\end{remark}\begin{proof}[of \ref{a}] by \ref{b}\end{proof}\begin{proof} by \ref{a}\end{proof}"
    g = dag.build(record(spark, text))
    assert {(r["seq"], r["target"], r["method"]) for r in g.proofs.collect()} == {(3, 0, "direct"), (4, 1, "fallback")}
    assert edges(g) == [("a", "b"), ("b", "a")]
    assert not dag.topological(g.nodes, g.edges).first()["dag_valid"]
    older = dag.build(record(spark, text), dag.Options(direction="dependent_first"))
    assert {(r["seq"], r["target"]) for r in older.proofs.collect()} == {(3, 0), (4, 2)}
    assert edges(older) == [("a", "b"), ("r", "a")]


def test_fuzzy_threshold(spark):
    text = r"\begin{lemma}\label{lem:one-two-three}x\end{lemma}\begin{theorem}\label{t}y\end{theorem}\begin{proof} \ref{lem:one-two-three-four} \ref{lem:one-two}\ref{lem:one} \end{proof}"
    assert edges(dag.build(record(spark, text), dag.Options(threshold=0.66))) == [("lem:one-two-three", "t")]
    assert edges(dag.build(record(spark, text), dag.Options(fuzzy=False))) == []
    unknown = {r["label"] for r in dag.build(record(spark, text)).unknown.collect()}
    assert unknown == {"lem:one"}


def test_nested_layout_and_errors(spark):
    rows = [(0, ["m.tex"], [r"\begin{lemma}x\end{lemma}\begin{proof}\ref{q}\end{proof}"]), (1, ["a", "b"], ["x"]), (2, ["m"], [None])]
    records = spark.createDataFrame(rows, "index long, filenames array<string>, latex array<string>")
    got = {r["index"]: r for r in dag.nested(records, dag.build(records)).collect()}
    assert got[0]["unknown_refs"] == {"q": 1} and got[0]["topo_order"] == ["proof#2@m.tex:25", "lemma#1@m.tex"] and got[0]["dag_valid"]
    assert "length" in got[1]["error"] and got[1]["nodes"] is None and got[2]["error"] is None


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_tiles_run_once(spark, monkeypatch):
    """Two passes for ranks and for gradients, one for the loss."""
    passes, own = [], similarity.tiles

    def counted(left, right, compute, schema, size, block=similarity.BLOCK, *rest):
        passes.append(compute.__name__)
        seen = spark.sparkContext.accumulator(0)

        def run(l, r, s):
            seen.add(1)
            return compute(l, r, s)

        passes[-1] = (compute.__name__, seen)
        return own(left, right, run, schema, size, block, *rest)

    monkeypatch.setattr(similarity, "tiles", counted)
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, i % 3, rng.normal(size=4).tolist()) for i in range(30)], "id long, grp long, vec array<double>")
    pairs = spark.createDataFrame([(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(30)], "id long, x array<double>, y array<double>")
    for run, names in ((lambda: similarity.retrieval_metrics(vectors).collect(), ["best", "ahead"]), (lambda: similarity.symmetric_loss(pairs, 0.1).collect(), ["both"]), (lambda: similarity.loss_gradients(pairs, 0.1).collect(), ["both", "weighted"])):
        passes.clear()
        run()
        assert [(n, c.value) for n, c in passes] == [(n, 1) for n in names]  # 30 vectors are one tile


def test_top_k_needs_k_others(spark):
    vectors = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(4)], "id long, grp long, vec array<double>")
    got = similarity.retrieval_metrics(vectors, (1, 3, 4)).first()
    assert got["top1"] is not None and got["top3"] == 1.0 and got["top4"] is None


def test_encoders_by_name(spark):
    assert encoders.names() == ["bm25", "bm25_projected", "first_token", "jaccard", "jaccard_projected", "last_token", "minhash"]
    items = spark.createDataFrame([(1, "a b b c"), (2, "a"), (3, None)], "item long, text string")
    rows = {(r["item"], r["term"]): r["w"] for r in encoders.encoder("jaccard")(items).collect()}
    assert len(rows) == 4 and abs(rows[1, "b"] - 3**-0.5) < 1e-12 and rows[2, "a"] == 1.0
    unit = {}
    for r in encoders.encoder("bm25")(items).collect():
        unit[r["item"]] = unit.get(r["item"], 0) + r["w"] ** 2
    assert set(unit) == {1, 2} and all(abs(x - 1) < 1e-9 for x in unit.values())
    vectors = encoders.encoder("minhash")(items).collect()
    assert {r["item"] for r in vectors} == {1, 2} and all(len(r["vec"]) == 2048 and abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in vectors)
    states = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [1, 1, 0])], "item long, states array<array<double>>, mask array<int>")
    assert list(encoders.encoder("first_token")(states).first()["vec"]) == [1.0, 2.0] and list(encoders.encoder("last_token")(states).first()["vec"]) == [3.0, 4.0]
    with pytest.raises(KeyError, match="no encoder"):
        encoders.encoder("other")
    with pytest.raises(ValueError, match="there is"):
        encoders.register("bm25", encoders.minhash_vectors)


def test_nearest_between_two_tables(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(40, 3))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in similarity.nearest_between(frame(a), frame(b), 4, 9).orderBy("q", "rk").collect():
        got.setdefault(r["q"], []).append(r["c"])
    assert got == {i: np.argsort(-np.round(s, 6), kind="stable")[:4].tolist() for i, s in enumerate(a @ b.T)}


def test_few_queries_scan_candidates_where_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 9, (7, 3)), rng.integers(1, 9, (900, 3))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<int>")
    dots = (a @ b.T).astype(float)
    cosines = dots / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))
    for held in (21, 20):
        monkeypatch.setattr(similarity, "HELD_NUMBERS", held)
        for cosine, s in ((False, dots), (True, cosines)):
            got, found = {}, similarity.nearest_of_scan(frame(a), frame(b), 4, cosine)
            for r in found.orderBy("q", "rk").collect():
                got.setdefault(r["q"], []).append(r["c"])
            assert got == {i: np.argsort(-np.round(x, 6), kind="stable")[:4].tolist() for i, x in enumerate(s)}
            assert held < 21 or "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert similarity.nearest_of_scan(frame(a).filter("id < 0"), frame(b), 4).count() == 0


def test_one_search_writes_and_shuffles_no_documents(spark, sf, monkeypatch):
    from lemmaforge.plans import bags as plans

    def stored(*_):
        raise AssertionError("documents are stored")

    monkeypatch.setattr(plans, "_stored", stored)
    plan = plans.w5_lexical_search(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the best of each task


def test_edge_sink(spark, tmp_path):
    rows = [(1, 2, "c", "C", "a", None), (1, 1, "a", "\u00c4", "b", "say \"b\""), (None, 1, "x", "X", "y", "Y")]
    edges = spark.createDataFrame(rows, "index long, place int, `from` string, from_text string, `to` string, to_text string")
    records = spark.createDataFrame([(1,), (2,), (None,)], "index long")
    expected = [(None, [["x", "X", "y", "Y"]]), (1, [["a", "\u00c4", "b", 'say "b"'], ["c", "C", "a", None]]), (2, [])]
    for wrap in (False, True):
        path = str(tmp_path / str(wrap))
        jsonl.write_edges(edges, path, wrap, records)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            jsonl.write_edges(edges, path, wrap, records)
        got = [json.loads(r["value"]) for r in spark.read.text(path).orderBy("value").collect()]
        assert sorted(got, key=str) == sorted(({"index": i, "edges": e} if wrap else e for i, e in expected), key=str)
    assert jsonl.edge_array(edges).count() == 2 and jsonl.edge_array(edges.limit(0)).count() == 0


def test_dataset_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "d")
    jsonl.write_lines(spark.range(5), path)
    first = shards.dataset(spark, path, "id bigint")
    second = shards.dataset(spark, path, "id bigint")
    assert second.count() == 5 and second.storageLevel.useMemory and "InMemoryTableScan" in second._jdf.queryExecution().executedPlan().toString()
    first.unpersist()
    assert not shards.dataset(spark, path, "id bigint").unpersist().storageLevel.useMemory


def test_negatives_of_uneven_groups(spark):
    """One group of 95 %: every query gets 50 different vectors of other groups, and close places share no window."""
    rows = [(i, 0 if i < 1900 else 1 + i % 20) for i in range(2000)]
    v = spark.createDataFrame(rows, "id long, grp int")
    got = retrieval.sampled_negatives(v, v.select(F.col("id").alias("q"), "grp"), 50)
    found, grp = {}, dict(rows)
    for q, c in got.collect():
        found.setdefault(q, set()).add(c)
    assert len(found) == 2000 and got.count() == 50 * 2000
    assert all(len(c) == 50 and grp[q] not in {grp[x] for x in c} for q, c in found.items())
    assert len({frozenset(found[q]) for q in range(1900)}) == 1900
    drawn = [sum(c in found[q] for q in range(1900)) for c in range(1900, 2000)]
    assert 820 < min(drawn) and max(drawn) < 1080  # 950 expected, standard deviation 22


def test_negatives_where_few_exist(spark):
    v = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, None)], "id long, grp int")
    q = spark.createDataFrame([(0, 1), (2, 2)], "q long, grp int")
    got = retrieval.sampled_negatives(v, q, 50).collect()
    assert {tuple(r) for r in got} == {(0, 2), (0, 3), (2, 0), (2, 1), (2, 3)} and len(got) == 5
    alone = spark.createDataFrame([(0, 1), (1, 1)], "id long, grp int")
    assert retrieval.sampled_negatives(alone, q, 50).count() == 0


def test_orders_near_the_end_of_64_bits(spark):
    top = 2**63 - 1
    ids = [top - i for i in range(300)] + [-(2**63) + i for i in range(5)]
    frame = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in ids], "order long, key string")
    got = {r["order"]: r["place"] for r in corpus.positions(frame.withColumn("all", F.lit(0)), "order", "all", "place").collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
    keys = [("a" if i % 3 else "b") for i in sorted(ids)]
    breaks = [sum(a != b for a, b in zip(keys[: k + 1], keys[1 : k + 1], strict=False)) for k in range(len(keys))]
    assert {r["order"]: r["run"] for r in bundles.runs(frame, "key", "order").collect()} == dict(zip(sorted(ids), breaks, strict=True))
    cuts = ordinals.range_cuts(frame, "order", 8)
    assert len(cuts) == 7  # values that a double can't tell apart are


def test_ordinals_of_any_type(spark):
    rows = [(random.Random(i).choice(["x", "y", None, "é"]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "s string, i int").repartition(7)
    got = {r["i"]: r["at"] for r in ordinals.numbered(frame, [F.col("s").desc_nulls_last(), F.col("i")], "at").collect()}
    expected = sorted(rows, key=lambda r: (r[0] is None, [-b for b in (r[0] or "").encode()], r[1]))
    assert got == {i: k for k, (_, i) in enumerate(expected)}
    within = {r["i"]: r["at"] for r in ordinals.numbered_within(frame, "s", [F.col("i").desc()], "at").collect()}
    for s in ("x", "y", None, "é"):
        own = sorted((i for v, i in rows if v == s), reverse=True)
        assert [within[i] for i in own] == list(range(len(own)))
    assert ordinals.numbered(frame.limit(0), [F.col("i")], "at").count() == 0


def test_epochs_shuffle_all_pairs_and_batches_follow_that_order(spark):
    pairs = spark.createDataFrame([(f"p{i % 40}", i // 40) for i in range(205)], "paper string, pair int")
    first, second = ({(r["paper"], r["pair"]): r["place"] for r in corpus.shuffled(pairs, ["paper", "pair"], 1, e).collect()} for e in (0, 1))
    assert sorted(first.values()) == sorted(second.values()) == list(range(205)) and first != second
    assert first == {(r["paper"], r["pair"]): r["place"] for r in corpus.shuffled(pairs.repartition(5), ["paper", "pair"], 1, 0).collect()}
    batches = corpus.full_batches(corpus.shuffled(pairs, ["paper", "pair"], 1, 0), "place", 20).collect()
    assert len(batches) == 200 and all(first[r["paper"], r["pair"]] // 20 == r["batch"] for r in batches)


def test_grid_ships_few_rows():
    """Each side has its own number of super-blocks; a vector goes along once for each one of the other side."""
    plan = similarity.grid(4, 20_500, 100_000, 100_000, 16)
    assert (plan.left, plan.right) == (1, 11) and plan.shipped == 4 * 11 + 20_500
    wide = similarity.grid(10**8, 10**8, 125_000, 125_000, 8000)
    assert wide.left == wide.right == 800 and wide.shipped == 2 * 800 * 10**8  # one by one, tiles of 2,048 ship 48,829 times
    for n, m, tasks in ((50_000, 50_000, 16), (2_000, 2_000, 16), (1, 0, 4), (100_000, 3_000, 64)):
        p = similarity.grid(n, m, 30_000, 30_000, tasks)
        assert p.left * p.right >= min(tasks, -(-n // 2048) * max(1, -(-m // 2048))) and p.left * 30_000 >= n and p.right * 30_000 >= m


def test_shipped_rows(spark, monkeypatch):
    """4 queries and 500 candidates in tiles of 9: the queries go to every task, each candidate to one."""
    kind = type(spark.range(0))
    rows, own = [], kind.groupBy

    def counted(self, *cols):
        if "side" in self.columns:
            rows.append({r["side"]: r["count"] for r in own(self, "side").count().collect()})
        return own(self, *cols)

    monkeypatch.setattr(kind, "groupBy", counted)
    rng = np.random.default_rng(8)
    frame = lambda n: spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n)], "id long, vec array<double>")
    similarity.nearest_between(frame(4), frame(500), 2, 9)
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert rows == [{0: 4 * tasks, 1: 500}]


def test_tiles_of_a_super_block_add_up(spark, monkeypatch):
    """Small limits: many tiles a task, folded on the way, give what one tile gives."""
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, i % 5, np.round(rng.normal(size=3), 1).tolist()) for i in range(150)], "id long, grp long, vec array<double>")
    expected = {r["id"]: r["rank"] for r in similarity.first_positive_ranks(vectors).collect()}
    best = {tuple(r) for r in similarity.ranking(vectors, 7).collect()}
    every = {tuple(r) for r in similarity.ranking(vectors).collect()}
    assert len(every) == 150 * 149 and best == {r for r in every if r[3] <= 7}
    monkeypatch.setattr(similarity, "HELD_ROWS", 50)
    monkeypatch.setattr(similarity, "HELD_NUMBERS", 120)
    assert {r["id"]: r["rank"] for r in similarity.first_positive_ranks(vectors, 11).collect()} == expected
    near = similarity.nearest(vectors, 7, 11)
    assert {(r["q"], r["c"]) for r in similarity.ranking(vectors, 7).collect()} <= {(r["q"], r["c"]) for r in near.collect()}
    plan = similarity.ranking(vectors)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_ranks(ids, grp, x):
    """Order of all others of each, and the place of its first positive."""
    s = np.round(x @ x.T, 6)
    order = {i: sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[i, j], ids[j])) for i in range(len(ids))}
    return {ids[i]: [ids[j] for j in o] for i, o in order.items()}, {ids[i]: next((k + 1 for k, j in enumerate(o) if grp[i] == grp[j]), None) for i, o in order.items()}


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e16])
def test_screened_scores_are_decided_in_double_precision(spark, monkeypatch, scale):
    """Scores that differ in the sixth digit or are equal, copies, several tiles, groups of one; numbers too large to screen."""
    monkeypatch.setattr(similarity, "TILE_ROWS", 16)
    monkeypatch.setattr(similarity, "TILE_PLACES", 30)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(130, 5)), 2) * scale
    x[40:80] = x[0] + np.round(rng.normal(size=(40, 5)) * 3, 0) * 1e-6 / scale
    x[100:110] = x[3]
    ids, grp = rng.permutation(130).tolist(), [int(g) for g in rng.integers(0, 4, 129)] + [9]
    v = spark.createDataFrame([(i, g, r.tolist()) for i, g, r in zip(ids, grp, x, strict=True)], "id long, grp long, vec array<double>")
    order, first = brute_ranks(ids, grp, x)
    for block in (2048, 20):
        assert {r["id"]: r["rank"] for r in similarity.first_positive_ranks(v, block).collect()} == first
    got = {}
    for r in similarity.ranking(v, 7).orderBy("q", "rk").collect():
        got.setdefault(r["q"], []).append(r["c"])
    assert got == {i: o[:7] for i, o in order.items()}
    totals = {r["q"]: (r["n"], r["total"]) for r in similarity.score_totals(v).collect()}
    exact = x @ x.T
    assert all(totals[i][0] == 129 and abs(totals[i][1] - (exact[k].sum() - exact[k, k])) <= 1e-9 * np.abs(exact[k]).sum() for k, i in enumerate(ids))


def test_whole_rankings_shuffle_no_pairs(spark, monkeypatch):
    """The same ranks by blocks and by sorted pairs, for scores of any size; blocks exchange vectors only."""
    rng = np.random.default_rng(6)
    for scale in (0.5, 2.0**40):  # products are exact
        x = rng.integers(-9, 10, (90, 3)) * scale
        x[7] = x[8] = x[9]
        v = spark.createDataFrame([(89 - i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
        monkeypatch.setattr(similarity, "RANKED_NUMBERS", 90 * 3)
        monkeypatch.setattr(similarity, "RANKED_SCORES", 300)
        blocks = similarity.ranking(v)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning(q" not in plan
        monkeypatch.setattr(similarity, "RANKED_NUMBERS", 90 * 3 - 1)
        pairs = similarity.ranking(v)
        assert "Window" in pairs._jdf.queryExecution().executedPlan().toString()
        got, want = ({(r["q"], r["c"]): (r["rk"], r["score"]) for r in t.collect()} for t in (blocks, pairs))
        assert got == want and len(got) == 90 * 89


def test_whole_rankings_by_ranges_of_candidates(spark, monkeypatch):
    """Small limits: several steps, stretches of ranks and ranges; ids that repeat rank all vectors of other ids."""
    monkeypatch.setattr(similarity, "RANKED_SCORES", 300)
    monkeypatch.setattr(similarity, "RANKED_PLACES", 700)
    monkeypatch.setattr(similarity, "RANKED_RANGE", 30)
    monkeypatch.setattr(similarity, "RETURNED_SCORES", 90)
    monkeypatch.setattr(similarity, "RETURNED_ROWS", 7)
    rng = np.random.default_rng(12)
    for scale in (1.0, 2.0**40):  # products are exact
        x = rng.integers(-9, 10, (110, 3)) * scale
        ids = [*range(-50, 54), 7, 7, -50, 53, 53, 20]
        v = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "id long, vec array<double>")
        want = []
        for k, i in enumerate(ids):
            others = sorted((-float(x[k] @ x[j]), ids[j]) for j in range(110) if ids[j] != i)
            want += [(i, c, -s, rk) for rk, (s, c) in enumerate(others, 1)]
        assert sorted(map(tuple, similarity.ranking(v).collect())) == sorted(want)
        assert sorted(map(tuple, similarity.ranking(v, scores=False).collect())) == sorted((q, c, rk) for q, c, _, rk in want)


def test_whole_rankings_take_little_disk(spark, tmp_path):
    """A file of them has little more than the bits of a candidate's place a row, and each block of queries gets the vectors once."""
    n = 2000
    x = np.random.default_rng(13).normal(size=(n, 4)).round(3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    out = similarity.ranking(v).select("q", "c", "rk")
    out.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2.2 * n * (n - 1)
    blocks = 2 * spark.sparkContext.defaultParallelism
    assert f"sequence(0, {blocks - 1}," in out._jdf.queryExecution().analyzed().toString()


def test_ids_repeat_among_rows_that_lie_together():
    """20,000 rows of a page, of 60 queries and 100,000 candidates: their ids, taken once, and the numbers of these are smaller than all ids."""
    rng = np.random.default_rng(14)
    places = np.stack([rng.permutation(100_000) for _ in range(60)]).astype(np.int32)
    batches = list(similarity._by_rank(np.arange(60), np.arange(100_000) * 3, places, None))
    c, rk = (np.concatenate([np.asarray(b.column(name)) for b in batches]) for name in ("c", "rk"))
    assert len(c) == 60 * 100_000 and len(np.unique(c)) == 100_000
    distinct = [len(np.unique(c[k : k + 20_000])) for k in range(0, len(c), 20_000)]
    assert np.mean([d * 8 + 20_000 * 14 / 8 < 20_000 * 8 for d in distinct]) > 0.95
    assert np.mean(np.diff(rk) != 0) < 0.1


def test_a_tile_holds_little(spark):
    """All pairs of 4,000 vectors in one task: scores are never held whole, nor a tile of 2,048 by 2,048."""
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(4000, 8)).astype(np.float32)
    t = pa.table({"id": np.arange(4000), "vec": pa.array(list(x), pa.list_(pa.float32()))})
    screen = similarity.Screen(t, t)
    tracemalloc.start()
    screen.best(np.arange(4000), np.arange(4000), 5)
    screen.ahead(np.zeros(4000), np.zeros(4000, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6


def test_lengths_are_computed_once_a_vector(spark, sf):
    """Above the rows of single numbers nothing is left to compute but their rounding, and a vector enters its scaling once."""
    from lemmaforge.functions.vectors import normalised
    from lemmaforge.plans import retrieval

    plan = retrieval.v2_normalise(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "aggregate(" not in plan.split("Generate posexplode")[0]
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    scaled = rows.select("id", normalised(F.transform("v", lambda x: x * 2)).alias("u"))
    assert {r["id"]: list(r["u"]) for r in scaled.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    assert scaled._jdf.queryExecution().optimizedPlan().toString().count("* 2") == 1


def test_signatures_by_their_definition(spark):
    texts = spark.createDataFrame([(1, "a b c a"), (2, "d"), (3, "")], "item long, text string")
    got = {r["item"]: list(r["sig"]) for r in bags.minhash(bags.bags_by_item(texts, "item", "text"), 40).collect()}
    numbers = {w: bags.number_of(w) for w in "abcd"}
    assert got == {i: [min((numbers[w] * a + b) % bags.PRIME for w in words) for a, b in bags.hash_functions(40)] for i, words in ((1, "abc"), (2, "d"))}
    assert len(set(bags.hash_functions(bags.WIDTH))) == bags.WIDTH


def test_tables_of_terms_are_held_in_parts(spark, monkeypatch):
    """Signatures and projections are the same by any number of columns at once, and no table is wider."""
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 40 + 3 * i))) for i in range(9)], "item long, text string")
    frame = bags.bags_by_item(texts, "item", "text")
    of = lambda t, field: {r["item"]: list(r[field]) for r in t.collect()}
    want = of(bags.minhash(frame, 50), "sig"), of(bags.projected(bags.binary_bags(frame), 50), "vec")
    monkeypatch.setattr(bags, "COLUMNS", 7)
    seen, own = spark.sparkContext.accumulator(0), bags._by_number

    def counted(rows, values, table, *rest):
        def part(x, columns):
            got = table(x, columns)
            seen.add(got.shape[1] > 7)
            return got

        return own(rows, values, part, *rest)

    monkeypatch.setattr(bags, "_by_number", counted)
    got = of(bags.minhash(frame, 50), "sig"), of(bags.projected(bags.binary_bags(frame), 50), "vec")
    assert got[0] == want[0] and all(np.allclose(got[1][i], v, atol=1e-12) for i, v in want[1].items()) and set(got[1]) == set(want[1]) and seen.value == 0


def test_projections_keep_norms_and_cosines(spark):
    """2,048 dimensions: unit vectors keep their length and their cosines within 0.1."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(pool[: 60 if i % 2 else 3000], k=rng.randint(5, 120)))) for i in range(60)] + [(99, None)]
    frame = bags.bags_by_item(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    for weigh in (bags.encoder_bags, bags.binary_bags):
        sparse = {}
        for r in weigh(frame).collect():
            for x in r["bag"]:
                of = sparse.setdefault(r["item"], {})
                of[bags.number_of(x["term"])] = of.get(bags.number_of(x["term"]), 0.0) + x["w"]
        dense = {r["item"]: np.array(r["vec"]) for r in bags.projected(weigh(frame)).collect()}
        assert set(dense) == set(sparse) and all(len(v) == 2048 for v in dense.values())
        apart = [abs(float(dense[i] @ dense[j]) - sum(w * sparse[j].get(t, 0.0) for t, w in sparse[i].items())) for i in dense for j in dense]
        assert max(apart) < 0.1 and sum(apart) / len(apart) < 0.03
    assert len(set(bags.mixed_rows(1 << 15).tolist())) == 1 << 15


def test_labels_fold_like_casefold(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(every[i : i + 50]),) for i in range(0, len(every), 50)] + [("ΛΟΓΟΣ-ﬁt",), ("Straße",), ("plain",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", L.folded_label(F.col("t")).alias("f")).collect()
    assert all(r["f"] == (r["t"].casefold() if r["t"] is not None else None) for r in got)
