"""Input columns that have the names of outputs or helpers, and empty tables, for every operator that appends columns."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lemmaforge.llm import decontaminate, jaccard, passages, pieces, quality, syncmers, tokencount, toxicity
from lemmaforge.llm.columns import Plain

NAMES = ("score", "Score2", "tox_features", "tree", "hits", "ld_k", "ld_runs", "ps_k", "ps_marks", "dc_hits", "dc_at", "tokens", "row", "stats", "_t", "jj_id", "node", "c0", "x1")
TEXT = " ".join(f"w{i}" for i in range(70))
ROWS = [(1, TEXT), (2, "x " + TEXT), (3, None), (3, ""), (None, "you idiot")]


def run(name, docs):
    bench = docs.sparkSession.createDataFrame([(1, TEXT)], "item_id long, text string")
    return {
        "quality": lambda: (quality.score(docs, quality.RuleModel(0.3, ())), ["score"]),
        "toxicity": lambda: (toxicity.score(docs, toxicity.Lexicon({"idiot ": 3.0}, (), (-2.0, 1.0, 0.5, 1.0))), ["score"]),
        "trees": lambda: (tokencount.with_trees(docs, tokencount.Counter.load()), ["tree"]),
        "hits": lambda: (decontaminate.contamination(docs, bench), ["hits"]),
        "joined hits": lambda: (decontaminate.contamination(docs, bench, max_broadcast_words=0), ["hits"]),
        "clean": lambda: (decontaminate.decontaminate(docs, bench, remove="spans"), []),
        "passages": lambda: (passages.dedup_passages(docs, removed="score"), ["score"]),
        "pieces": lambda: (pieces.encode(docs, pieces.PieceTable.load(), decoded="hits"), ["tokens", "hits"]),
    }[name]()


@pytest.mark.parametrize("name", ["quality", "toxicity", "trees", "hits", "joined hits", "clean", "passages", "pieces"])
def test_clashing_columns(spark, name):
    bare = spark.createDataFrame(ROWS, "doc_id long, text string")
    crowded = bare.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    got, outputs = run(name, crowded)
    assert got.columns == ["doc_id", "text", *[n for n in NAMES if n not in outputs], *outputs]
    want, _ = run(name, bare)
    key = lambda rows: sorted((str((r["doc_id"], r["text"], *[r[o] for o in outputs])) for r in rows))
    rows = got.collect()
    assert key(rows) == key(want.collect()) and len(rows) == len(ROWS)
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES if n not in outputs)
    assert run(name, crowded.limit(0))[0].count() == 0


def test_an_output_can_not_be_what_is_read(spark):
    with pytest.raises(ValueError, match="is read"):
        Plain(spark.createDataFrame(ROWS, "doc_id long, text string"), ["TEXT"], ["text"])


def test_extra_columns_of_the_join_are_ignored(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in NAMES])
    assert sorted(r["n_shingles"] for r in jaccard.jaccard_join(docs).collect()) == [0, 0, 1, 66, 67]


def spark_hash(values):
    """Spark's xxhash64 of strings and longs in turn."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little"), h)
    return h - 2**64 if h >= 2**63 else h


def brute_anchors(text):
    """Closed syncmers by their definition: the K words at a place are chosen when the least of their inner hashes stands first or last."""
    words = [x for p in (text or "").lower().split() for x in [*p[:-16], p[-16:]]]
    k, s = syncmers.K, syncmers.S
    if len(words) < 2 * k:
        return [(spark_hash([w]) & 0xFFFFFFFF, i) for i, w in enumerate(words)]
    out = []
    inner = [spark_hash(words[i : i + s]) for i in range(len(words) - s + 1)]
    for i in range(len(words) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append((spark_hash([own[j] for j in sorted({*range(0, k - s + 1, s), k - s})]) & 0xFFFFFFFF, i))
    return out


def test_fingerprints_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = {i: " ".join(rng.choice(["Ab", "cd", "efg", "über", "z" * 40, "x1"], size=n).tolist()) for i, n in enumerate([0, 1, 4, 9, 10, 11, 30, 200, 2000])} | {20: None, 21: "one two", 22: "ab " * 40}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(texts)
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in syncmers.op9_syncmers(spark, str(tmp_path)).collect():
        own, after = texts[r["doc_id"]] or "", texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        half = len(own) // 2
        f, g, h = (brute_anchors(t) for t in (own, own[: len(own) - half] + after[:half], after))
        assert r["fingerprint"] == "".join(f"{x:08x}" for x, _ in f) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x, _ in g), r["doc_id"]
        assert abs(r["near_edited"] - likeness({x for x, _ in f}, {x for x, _ in g})) < 1e-12 and abs(r["near_next"] - likeness({x for x, _ in f}, {x for x, _ in h})) < 1e-12


def test_statistics_by_brute_force(spark):
    rows = [None, "", " ", "One two two. Three!", "A|B|c\nA|B|c\n\nÜbel 12 3", "tab\tand  space !!! ###", "Same same\nlines\nlines"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    for r in quality.statistics(frame).select("row.i", "stats").collect():
        t = rows[r["i"]] or ""
        body = t.strip(" ")
        import regex

        words, parts = regex.split(r"[ \t\r\n]+", body), body.split("\n")
        p, n = regex.sub(r"[\p{L}\p{N}\s]+", "", t), max(1, len(t))
        want = (
            np.log1p(len(words)), len(t) / len(words), len(p) / n, len(regex.sub(r"[.,;:!?|'\"()\-]+", "", p)) / n, p.count("|") / len(words), p.count("!") / len(words),
            len(regex.findall(r"\p{Lu}", t)) / n, len(regex.findall("[0-9]", t)) / n, len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words),  # noqa: B905
            np.log1p(len(words) / len(parts)), len(set(parts)) / len(parts),
        )
        assert np.allclose(tuple(r["stats"]), want), (t, tuple(r["stats"]), want)
