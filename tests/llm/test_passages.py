"""Repeated passages by words against all windows compared."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lemmaforge.llm import jaccard, passages


def brute_words(docs, least):
    """Text and words gone by id, by comparing every window of `least` words. Ids are unique."""
    split, first = {i: (t or "").split() for i, t in docs}, {}
    for i in sorted(split):
        for a in range(len(split[i]) - least + 1):
            first.setdefault(tuple(split[i][a : a + least]), (i, a))
    kept = {}
    for i, text in docs:
        w, gone = split[i], set()
        for a in range(len(w) - least + 1):
            if first[tuple(w[a : a + least])] != (i, a):
                gone.update(range(a, a + least))
        if gone:
            pieces = re.findall(r"^\s*\S+\s*|\S+\s*", text)
            text = "".join(x for j, x in enumerate(pieces) if j not in gone)
            text = text.rstrip() if len(w) - 1 in gone else text
        kept[i] = (text, len(gone))
    return kept


@pytest.mark.parametrize("least", [1, 2, 7, 50])
def test_passages_against_all_windows(spark, least):
    random.seed(21)
    pool = [f"v{i}" for i in range(4000)]
    long = [random.choice(pool) for _ in range(900)]
    docs = []
    for i in range(90):
        body = []
        for _ in range(random.choice([0, 1, 3, 6])):
            a = random.randrange(len(long))
            body += long[a : a + random.choice([3, 30, 49, 50, 51, 70, 160])] + [random.choice(pool) for _ in range(random.randrange(12))]
        docs.append((i, random.choice(["", " ", "\n"]).join(["", ""]) + "".join(x + random.choice([" ", "\n", "  ", ". "]) for x in body)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "word " * 300), (104, "word " * 200), (105, "a b c " * 60), (106, "x " + "b c a " * 50)]
    got = passages.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string"), least=least, removed="gone").collect()
    want = brute_words(docs, least)
    assert len(got) == len(docs) and any(r["gone"] for r in got)
    for r in got:
        assert (r["text"], r["gone"]) == want[r["doc_id"]], r["doc_id"]


def test_a_passage_that_starts_and_ends_inside_sentences_goes(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"One begins {passage} and goes on."), (2, f"another one has {passage} as well."), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["n_chars"]) for r in passages.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, len(rows[0][1])), 2: (60, len("another one has as well.")), 3: (0, None)}


def test_equal_rows_are_one_document(spark):
    text = " ".join(f"q{i}" for i in range(60))
    rows = [(4, text), (4, text), (None, "x " + text), (9, text + " end")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", ""), ("4", ""), ("9", "end"), ("None", "x " + text)]
    assert passages.dedup_passages(spark.createDataFrame([(4, text), (4, text)], "doc_id long, text string"), removed="n").agg({"n": "sum"}).first()[0] == 0
    assert passages.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sentences(rng, n):
    """Words with sentence ends at some, none or all places, and repeated ones."""
    kind = rng.choice([0.0, 0.02, 0.1, 1.0])
    pool = rng.choice([2, 30, 5000])
    return [f"w{rng.randrange(pool)}" + ("." if rng.random() < kind else "") for _ in range(n)]


@pytest.mark.parametrize("least", [1, 3, 8, 20, 50])
def test_every_window_has_a_seed_that_its_words_decide(least):
    """The winnowing guarantee: equal windows get equal seeds at equal offsets, whatever stands around them."""
    rng = random.Random(least)
    for _ in range(60):
        body = sentences(rng, rng.randrange(least, 4 * least + 1))
        texts = [sentences(rng, 30) + body + sentences(rng, 30), body, ["x."] + body + ["y"], sentences(rng, 3)]
        found = {}
        words = passages.Words([" ".join(t) for t in texts])
        seed, first, count, doc = words.spans(least)
        for s, a, n, d in zip(seed.tolist(), first.tolist(), count.tolist(), doc.tolist(), strict=True):
            for at in range(a, a + n):
                i = at - words.starts[d]
                found.setdefault(tuple(texts[d][i : i + least]), set()).add(s)
        assert len([1 for t in texts for i in range(len(t) - least + 1)]) == count.sum()
        assert all(len(s) == 1 for s in found.values())


def test_lines_end_at_sentences_and_long_ones_are_cut():
    words = passages.Words(["One two three. Four five six seven! " + " ".join(f"v{i}" for i in range(100)) + " end. Last"])
    starts = passages.Words.line_starts(words, 6)
    assert 3 in starts and 7 in starts and 108 in starts and not {1, 2, 4, 5, 6, 8, 9, 10, 11, 12} & set(starts.tolist())
    assert np.diff(starts).max() <= 3 * 6 - 2 and len(starts) < 40


def test_ids_that_are_no_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for run in (passages.dedup_passages, jaccard.jaccard_join):
        with pytest.raises(TypeError, match="doc_id is string"):
            run(docs)


BLANKS = [chr(i) for i in range(0x110000) if chr(i).isspace()]


def odd_texts(rng, n):
    """Texts of all white space there is and of what resembles it in UTF-8, with short, long and very long words."""
    parts = [*BLANKS, *"ab.!?\0\x80\xe9\u200b\u2040\u205e\u2060\u1681\u3001\u4e2d\U0001f600", "abcdefgh", "x" * 63, "x" * 64, "x" * 65, "\xe9" * 40, "y" * 200]
    return [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_words_are_those_of_split_and_equal_ones_have_equal_hashes():
    rng, hashes = random.Random(5), {}
    for _ in range(400):
        texts = odd_texts(rng, rng.randrange(9))
        split = [(t or "").split() for t in texts]
        column = pa.array([None, "before it ", *texts, "behind"], pa.string())[2:-1]
        for words in passages.Words(texts), passages.Words(column):
            assert words.starts.tolist() == [0, *np.cumsum([len(w) for w in split]).tolist()]
            flat = [w for s in split for w in s]
            assert words.closes.tolist() == [w.endswith((".", "!", "?")) for w in flat]
            assert all(hashes.setdefault(w, h) == h for w, h in zip(flat, words.hashes.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) > 1000


def test_marked_words_go_whatever_white_space_there_is():
    rng = random.Random(6)
    for text in filter(None, odd_texts(rng, 400)):
        if n := len(text.split()):
            a, b = sorted(rng.sample(range(n + 1), 2))
            kept, gone = passages.without_words(text, np.array([a << 32 | b]))
            assert gone == b - a and kept.split() == [*text.split()[:a], *text.split()[b:]]


def test_words_cost_less_than_a_call_for_each():
    """CPU seconds a GB are mostly the words': they are found and hashed a batch at a time."""
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(50000)}" for _ in range(500)) for _ in range(400)]

    def seconds(work):
        took = []
        for _ in range(5):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    one_by_one = seconds(lambda: [xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()])
    together = seconds(lambda: passages.Words(texts))
    assert together < one_by_one * 0.9, (together, one_by_one)
