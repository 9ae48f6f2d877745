"""Whole fingerprints against sets of anchors."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lemmaforge.llm import syncmers
from tests.llm.test_columns import spark_hash


def test_all_anchors_are_compared(spark, tmp_path):
    random.seed(31)
    long = [f"k{random.randrange(900)}" for _ in range(1500)]
    texts = [" ".join(long), " ".join(["one", "two"] + long[:700] + ["new"] + long[701:]), " ".join(long[900:]), "", None, "a b", "z " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own = {r["doc_id"]: [(x["hash"], x["at"]) for x in r["a"]] for r in docs.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    for r in syncmers.op9_syncmers(spark, str(tmp_path)).collect():
        a, b = own[r["doc_id"]], own[(r["doc_id"] + 1) % len(texts)]
        x, y = {h for h, _ in a}, {h for h, _ in b}
        assert r["fingerprint"] == "".join(f"{h:08x}" for h, _ in a)
        assert r["near_next"] == (len(x & y) / len(x | y) if x | y else 1.0)
        once = [{h: p for h, p in t if n[h] == 1} for t, n in ((a, Counter(h for h, _ in a)), (b, Counter(h for h, _ in b)))]
        votes = Counter(once[1][h] - p for h, p in once[0].items() if h in once[1])
        best = min(votes.items(), key=lambda v: (-v[1], v[0])) if votes else (None, 0)
        assert (r["next_match"]["offset"], r["next_match"]["n"]) == best


def test_rows_of_one_id_are_dealt_and_ordered(spark, tmp_path):
    rows = [(None, f"null {i} " + "x" * (i % 7)) for i in range(400)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"own {i}") for i in range(-50, 250)] + [(7, "seven 1"), (None, None)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    low = lambda r: -(2**63) if r[0] is None else r[0]
    order = sorted(((low(r), spark_hash([r[1] or ""]), r[1] or "") for r in rows))
    want = Counter()
    for (k, _, body), (_, _, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(body) // 2
        want[k, len(body), hashlib.sha256((body[: len(body) - half] + after[:half]).encode()).hexdigest()] += 1
    got = syncmers.op9_syncmers(spark, str(tmp_path)).collect()
    assert Counter((low(r), r["n_chars"], r["edited_sha256"]) for r in got) == want
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.coalesce("text", F.lit("")).alias("body"))
    for ranges, most in ((8, 200), (1000, 20)):
        check_ranges(syncmers._dealt(keyed, "k", "body", ranges), most)


def check_ranges(dealt, most):
    """Ranges stand in order and none has more than `most` rows."""
    parts = sorted((r["part"], r["a"], r["b"], r["n"]) for r in dealt.groupBy("part").agg(F.min(F.struct("k", "place")).alias("a"), F.max(F.struct("k", "place")).alias("b"), F.count("*").alias("n")).collect())
    assert max(n for *_, n in parts) <= most
    assert all(tuple(x[2]) < tuple(y[1]) for x, y in zip(parts, parts[1:], strict=False))
