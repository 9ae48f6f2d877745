"""Resampling, divergence audit and language identification: brute force on odd tables, and held-out accuracy."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lemmaforge.llm import divergence, language, resample
from lemmaforge.llm.registry import oracle_sql, queries
from tests.oracle import by_spark, by_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n", "Ünï çödé ☃ x", "a", "A a a-b 7 seven\x007", "É é", "tail " * 700, "same words here", "same words here"]


def odd_docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta7", "é", "x"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s3", None][i % 4], 1.0, 2) for i, t in enumerate(texts)]
    rows += [(None, texts[20], "en", "s1", 0.0, 0), (3, texts[21], "en", "s2", 0.0, 0), (3, texts[21], "en", "s2", 0.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, place int"), rows


def test_queries_against_sql(spark, sf):
    for name in ("op11_resampling", "op12_divergence"):
        assert by_spark(queries()[name](spark, sf)) == by_sql(oracle_sql()[name], sf)


def brute_resample(rows, target, n, buckets, min_words, percent, seed):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]

    own, aim = [features(t) for _, t in rows], Counter(b for t in target for b in features(t)[1])
    corpus = Counter(b for _, f in own for b in f)
    s, t = sum(corpus.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets))))
    out = []
    for (i, _), (words, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= min_words))
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, drawn[: percent * len(drawn) // 100]


def test_resampling_against_brute_force(spark):
    docs, rows = odd_docs(spark)
    target = spark.createDataFrame([("alpha beta x",), (None,), ("Gamma",)], "text string")
    for n, percent in ((1, 10), (3, 60), (2, 100)):
        expected, drawn = brute_resample([r[:2] for r in rows], ["alpha beta x", None, "Gamma"], n, 50, 5, percent, 7)
        got = resample.resample(docs, target, n=n, buckets=50, min_words=5, percent=percent, seed=7).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted([tuple(r)[:4] for r in got], key=key) == sorted([r[:4] for r in expected], key=key)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [tuple(r)[:4] for r in ranked] == [r[:4] for r in drawn]


def test_ring_across_slices(monkeypatch):
    text = b"one two three four five six seven"
    whole = resample.Ring(3, 1000).extended(text.split())
    monkeypatch.setattr(resample, "SLICE", 5)
    ring = resample.Ring(3, 1000)
    pieces = list(resample.words_in_slices(text))
    assert len(pieces) > 3 and np.concatenate([ring.extended(p) for p in pieces]).tolist() == whole.tolist()


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert resample.resample(docs, docs).count() == 0
    one = spark.createDataFrame([("a", "few words"), ("b", None)], "doc_id string, text string")
    assert [r["rank"] for r in resample.resample(one, docs).collect()] == [None, None]


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t in df if df[t] >= least)
        groups = {s: Counter() for _, s, _ in own}
        for _, s, c in own:
            groups[s].update({t: c[t] for t in kept if c[t]})
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)}
    return out


def test_audit_against_brute_force(spark, monkeypatch):
    docs, rows = odd_docs(spark)
    for least, top, groups in ((3, 2, 100), (1, 50, 0), (10_000, 5, 100)):
        got = divergence.audit(docs, least=least, top=top, max_broadcast_groups=groups).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(rows, least, top)
    small = divergence.term_counts(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]), held=3)
    sums = small.groupBy("term").agg(F.sum("n").alias("n")).collect()
    assert {r["term"]: r["n"] for r in sums} == dict(Counter(t for r in rows for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_findings_passed_on_early(spark, monkeypatch):
    """What a task passes on when it is full adds up to the same result."""
    state = divergence.Language("en", ["a", "b", "c"], [10, 20, 0], 3)
    terms = [("x", ["a", "b"], [7, 5]), ("y", ["b"], [15]), ("z", ["a"], [3])]
    whole, parts = Counter(), Counter()
    for t in terms:
        state.add(*t, 50)
    for row in state.passed():
        whole[row[:4]] += row[4]
    for t in terms:
        state.add(*t, 50)
        for row in state.passed():
            parts[row[:4]] += row[4]
    assert whole == parts and whole[("en", "a", "pair", "b")] == whole[("en", "b", "pair", "a")]


def test_shares_of_large_counts():
    big = 10**12
    assert divergence.shares([big], [7 * big], 3).tolist() == [1 + 10**9 * (big + 5) // (7 * big + 15)]


def brute_profile(text, length):
    t = (text or "").lower()
    inside = [unicodedata.category(c)[0] in "LM" for c in t]
    words = "".join(c if k else " " for c, k in zip(t, inside, strict=True)).split(" ")
    counts = Counter()
    for w in filter(None, words):
        p = f"_{w}_"
        counts.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k] != "_")
    return counts, sorted(counts, key=lambda g: (-counts[g], len(g), g))[:length]


def test_language_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25)))
    alphabets = {"aa": "abcdé", "bb": "bcdef", "cc": "cdefǅ"}
    rows = [(i, make(alphabets[k]), k, 1.0) for i, k in enumerate(sorted(alphabets) * 12)]
    rows += [(100 + i, t, "aa", 1.0) for i, t in enumerate([None, "", "123 ...", "Ж", "́", "x" * 3000, "áb", "İ"])] + [(None, "abc", None, 0.0), (5, "abc", "bb", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    train = ~language.held_out(F.col("doc_id"), 4, 2)
    length = 40
    sums = defaultdict(Counter)
    for i, text, lang, _ in rows:
        if lang is not None and text is not None and (i is None or crc32(str(i).encode()) % 4 != 2):
            sums[lang].update(brute_profile(text, 0)[0])
    ranks = {k: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], len(g), g))[:length])} for k, c in sums.items()}
    expected = []
    for i, text, *_ in rows:
        own = brute_profile(text, length)[1]
        d = sorted((sum(abs(r - ranks[k][g]) if g in ranks[k] else length for r, g in enumerate(own)), k) for k in ranks)
        letters = any(unicodedata.category(c)[0] == "L" for c in (text or "").lower())
        expected.append((i, d[0][1] if letters else "und", round((d[1][0] - d[0][0]) / d[1][0], 9) if letters and d[1][0] else 0.0))
    profiles = language.fit(docs, train, length=length)
    for at_once in (200, 1, 2):
        got = language.identify(docs.select("doc_id", "text", "score"), profiles, length=length, langs_at_once=at_once).select("doc_id", "lang_pred", F.round("score", 9)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_grams_across_slices(monkeypatch):
    row = language.characters("one två three 4 four")[0]
    whole = [x.tolist() for x in language.gram_counts(row)]
    monkeypatch.setattr(language, "SLICE", 3)
    assert [x.tolist() for x in language.gram_counts(row)] == whole


def test_language_of_tables_without_anything_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    profiles = language.fit(docs, F.lit(True))
    assert [tuple(r) for r in language.identify(docs.select("doc_id", "text"), profiles, keep_text=False).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    one = language.fit(spark.createDataFrame([("abc", "xx")], "text string, lang string"), F.lit(True))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs, one).orderBy("doc_id").collect()] == [("xx", 1.0), ("und", 0.0)]
    assert language.identify(docs.limit(0), one).count() == 0


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.1"
    found = queries()["op13_language"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert right["a"] >= 0.99 and 0 <= right["lo"] <= right["hi"] <= 1


def test_long_texts_stay_in_slices():
    text = ("word " * 600_000).encode()
    assert sum(len(p) for p in resample.words_in_slices(text)) == 600_000 and divergence.counted(text) == {b"word": 600_000}
    assert isinstance(pa.array(language.profile(language.characters(text.decode())[0], 5)), pa.Array)
