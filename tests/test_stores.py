"""Stored embeddings by partition, totals that survive a restart, and levels of graphs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lemmaforge.operators import dag
from lemmaforge.sources import shards
from lemmaforge.streaming import totals


def test_one_partition_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda n, x: spark.createDataFrame([(f"v{i}", [float(x)] * 3, f"p{i % 2}") for i in range(n)], "id string, embedding array<float>, paper_id string")
    shards.write_embeddings(rows(4, 1), path, "m", "toy", "eval")
    shards.write_embeddings(rows(5, 2), path, "m", "toy", "train")
    with pytest.raises(FileExistsError, match="split=eval"):
        shards.write_embeddings(rows(1, 3), path, "m", "toy", "eval")
    before = {f: os.path.getmtime(f) for f in shards.store(spark, path).inputFiles() if "split=train" in f for f in [f.removeprefix("file://")]}
    shards.write_embeddings(rows(2, 9), path, "m", "toy", "eval", overwrite=True)
    got = {(r["id"], r["embedding"][0]) for r in shards.precomputed(spark, path, "m", "toy", "eval").collect()}
    assert got == {("v0", 9.0), ("v1", 9.0)} and shards.precomputed(spark, path, "m", "toy", "train").count() == 5
    assert before and all(os.path.getmtime(f) == t for f, t in before.items())
    assert shards.precomputed(spark, path, "m", "full", "eval") is None
    info = {r["split"]: (r["n"], r["dim"]) for r in shards.store(spark, path, "info").collect()}
    assert info == {"eval": (2, 3), "train": (5, 3)}
    plan = shards.store(spark, path, model="m", size="toy", split="eval").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "split" in plan.split("PartitionFilters")[1].split("]")[0] and "embedding:" not in plan.split("ReadSchema")[1]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_totals_survive_a_restart_and_a_replayed_batch_counts_once(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "totals"), str(tmp_path / "progress")
    record = lambda i, kind: {"index": i, "latex": ["\\begin{%s}x %d\\end{%s}" % (kind, i, kind)]}
    put(folder, "a.json", [record(1, "lemma"), record(2, "theorem")])
    put(folder, "b.json", [record(3, "lemma")])
    run = lambda: totals.start(totals.arriving(spark, str(folder), files_a_trigger=1), totals.statement_totals, path, checkpoint, once=True).awaitTermination()
    run()
    batch = lambda: {r["kind"]: r["n"] for r in totals.statement_totals(spark.read.schema(totals.RECORD).json(str(folder))).collect()}
    found = lambda at=path: {r["kind"]: r["n"] for r in totals.stored(spark, at, ("kind",)).collect()}
    before = found()
    assert before == batch() and set(before) == {"lemma", "theorem"}
    put(folder, "c.json", [record(4, "lemma"), record(5, "lemma")])
    (tmp_path / "progress/commits/1").unlink()  # the driver died when batch 1 was stored, but not yet noted as done
    for crc in (tmp_path / "progress/commits").glob(".1.crc"):
        crc.unlink()
    run()
    assert found() == batch() and found()["lemma"] == 2 * before["lemma"] and found()["theorem"] == before["theorem"]
    totals.compact(spark, path, str(tmp_path / "compact"), ("kind",))
    assert found(str(tmp_path / "compact")) == found()


def brute_levels(ids, edges):
    before = {i: {u for u, v in edges if v == i} for i in ids}
    level, more = {}, True
    while more:
        ready = [i for i in ids if i not in level and all(u in level for u in before[i])]
        more = bool(ready)
        level |= {i: 1 + max((level[u] for u in before[i]), default=-1) for i in ready}
    return level


def test_levels_of_random_graphs_and_a_long_chain(spark):
    rng, nodes, edges, want = random.Random(8), [], [], {}
    for g in range(12):
        ids = [f"n{i}" for i in range(rng.randint(1, 14))]
        own = {(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randint(0, 16))}
        if g % 2:
            own = {(u, v) for u, v in own if ids.index(u) < ids.index(v)}
        nodes += [(g, i) for i in ids] + [(g, ids[0])]
        edges += [(g, u, v) for u, v in own] + [(g, "nobody", ids[0]), (g, None, ids[0])]
        level = brute_levels(ids, own)
        want |= {(g, i): level.get(i) for i in ids}
    nodes += [(100, f"c{i}") for i in range(1000)]
    edges += [(100, f"c{i}", f"c{i + 1}") for i in range(999)]
    want |= {(100, f"c{i}"): i for i in range(1000)}
    got = dag.levels(spark.createDataFrame(nodes, "index long, id string"), spark.createDataFrame(edges, "index long, `from` string, `to` string"))
    assert {(r["index"], r["id"]): r["level"] for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "index long, id string")
    assert dag.levels(none, spark.createDataFrame([], "index long, `from` string, `to` string")).count() == 0
    assert got.filter(F.col("level") == 999).count() == 1


def test_a_dataset_of_many_files_is_listed_once(spark, tmp_path):
    """Below a folder whose own name has the ending, too."""
    root = tmp_path / "all.parquet"
    spark.range(40).repartition(3).write.parquet(str(root / "many.parquet"))
    spark.range(4).selectExpr("id", "id % 2 as k").write.partitionBy("k").parquet(str(root / "by key.parquet"))
    (root / "one.parquet").write_bytes(b"x" * 2**20)
    (root / "notes.txt").write_text("x")
    for path in (str(root), f"file://{root}/"):
        got = {r["name"]: r["mb"] for r in shards.datasets(spark, path).collect()}
        assert set(got) == {"many.parquet", "by key.parquet", "one.parquet"} and got["one.parquet"] == 1 and min(got.values()) > 0
