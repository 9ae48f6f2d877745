"""Quality, toxicity, token counts and encoding: brute force, round trips and held-out accuracy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaforge.llm import pieces, quality, tokencount, toxicity

ODD = [None, "", " ", "\n\n", "a", "x" * 5000, "Ünï çödé ☃ \U0001f600", "1d10t idiot", "a\x00b"]


def auc(frame, label):
    rows = [(r["score"], r[label]) for r in frame.collect()]
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op1_quality, "quality", 0.97), (toxicity.op3_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    scored = query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = scored.join(labels, "doc_id").filter("held_out").select("score", label)
    assert auc(held, label) >= least


def odd_docs(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(ODD)] + [(None, "n", "y", 2.0), (1, "", "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, stats string, score double")


def test_rules_compile_to_what_they_predict(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS)).select(F.struct(*quality.STATS).alias("stats"))
    got = np.array([r[0] for r in frame.select(model.column()).collect()])
    assert np.allclose(got, model.predict(x)) and ((got >= 0.5) == y).mean() > 0.97


def test_quality_of_odd_rows(spark):
    model = quality.RuleModel(0.3, (((quality.Test(0, 1.0, True),), -1.0),))
    rows = odd_docs(spark).select("doc_id", "text", "stats")
    got = quality.score(rows, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 < r["score"] < 1 for r in got)
    assert quality.score(rows.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, none, F.lit(True))).first()["score"] == 0.5


def lexicon():
    return toxicity.Lexicon({"idiot ": 3.0, "lowei": 2.0, "trash ": 1.0}, ("trash can",), (-2.0, 1.0, 0.5, 1.0))


def brute_matches(text, lex):
    folded = toxicity.fold(text)
    safe = [(i, i + len(p)) for q in lex.exceptions for p in [toxicity.fold(q)] for i in range(len(folded)) if folded.startswith(p, i)]
    found = []
    for term in lex.weights:
        for i in range(len(folded)):
            if folded.startswith(" " + term, i) and not any(a <= i and i + 1 + len(term) <= b for a, b in safe):
                found.append(term)
    return sorted(found)


def test_matches_against_brute_force():
    random.seed(2)
    words = ["idiot", "1d10t", "ІDІОТ", "trash", "can", "loweiend", "blowei", "idiots", "i​diot", "ｉｄｉｏｔ", "the", "trash-can", "id!ot"]
    for _ in range(300):
        text = " ".join(random.choice(words) for _ in range(random.randrange(12)))
        assert sorted(t for t, _ in lexicon().matches(text)[0]) == brute_matches(text, lexicon()), text


def test_folding_and_exceptions():
    lex = lexicon()
    assert [t for t, _ in lex.matches("You 1D10T, ідіот!")[0]] == ["idiot ", "idiot "]
    assert lex.matches("a trash can here")[0] == [] and len(lex.matches("a trash bag")[0]) == 1


def test_toxicity_of_odd_rows(spark):
    rows = odd_docs(spark).select("doc_id", "text", "stats")
    got = {(r["doc_id"], r["text"]): r["tox"] for r in toxicity.score(rows, lexicon(), out="tox").collect()}
    assert got[0, None] == got[1, ""] and got[7, "1d10t idiot"] > got[4, "a"]
    assert toxicity.score(rows.limit(0), lexicon(), out="tox").count() == 0


def test_terms_of_one_class_only(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, "more words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, None)], "doc_id long, toxic int")
    lex = toxicity.fit(docs, labels, F.lit(True))
    assert lex.weights == {} and abs(toxicity.score(docs, lex).first()["score"] - 0.5 / 3) < 1e-9


def test_edits_equal_a_full_count():
    random.seed(3)
    c = tokencount.Counter.load()
    alphabet = ["the ", "a", " ", "  ", "\n", "'s", "12", "é", "don't ", "!!", "\t"]
    for _ in range(150):
        text = "".join(random.choice(alphabet) for _ in range(random.choice([0, 1, 5, 800])))
        tree = tokencount.build(text, c)
        assert tree.tokens == len(c.encoding.encode_ordinary(text))
        for _ in range(4):
            a = random.randrange(len(text) + 1)
            b = min(len(text), a + random.choice([0, 1, 30, 900]))
            text, tree, again = tokencount.edit(text, tree, a, b, "".join(random.choice(alphabet) for _ in range(random.randrange(4))), c)
            full = tokencount.build(text, c)
            assert tree.tokens == full.tokens and tree.sum_chars[1] == len(text)
            k = random.randrange(len(tree.leaf_tokens) + 1) if tree.leaf_tokens else 0
            assert k == 0 or tree.tokens_before(k if k < len(tree.leaf_tokens) else k - 1) == sum(tree.leaf_tokens[: k if k < len(tree.leaf_tokens) else k - 1])


def test_an_edit_in_a_long_text_encodes_little_again():
    c = tokencount.Counter.load()
    text = "some words here and there. " * 4000
    tree = tokencount.build(text, c)
    _, after, again = tokencount.edit(text, tree, 50_000, 50_010, "changed", c)
    assert again < 2000 and after.tokens == tokencount.build(text[:50_000] + "changed" + text[50_010:], c).tokens


def test_inserts_touch_paths_only():
    c = tokencount.Counter.load()
    random.seed(31)
    words = ["alpha", "beta", "gamma", "delta", "über", "x1"]
    text = " ".join(random.choice(words) for _ in range(20_000))
    tree, touched, coded = tokencount.build(text, c), [], 0
    for _ in range(200):
        a = random.randrange(len(text) + 1)
        text, tree, again, nodes = tokencount.edited(text, tree, a, a, " one two three four ", c)
        touched.append(nodes)
        coded += again
    assert tree.tokens == tokencount.build(text, c).tokens and sum(tree.leaf_chars) == len(text)
    depth = math.log2(len(tree.sum_chars))
    assert max(touched) < 4 * depth and coded < 200 * 6 * 5 * tokencount.LEAF
    for _ in range(300):  # all in one place: leaves fill up and the tree grows now and then
        text, tree, again, nodes = tokencount.edited(text, tree, 50_000, 50_000, " one two three four ", c)
        touched.append(nodes)
    assert tree.tokens == tokencount.build(text, c).tokens and sum(touched) < 500 * 10 * depth
    for a in (len(text), len(text) - 3, 0):
        text, tree, _, _ = tokencount.edited(text, tree, a, a + 3, "end", c)
        assert tree.tokens == tokencount.build(text, c).tokens


def test_token_trees_of_odd_rows(spark):
    c = tokencount.Counter.load()
    rows = odd_docs(spark).select("doc_id", "text", "stats").withColumn("edits", tokencount.sample_edits(F.col("text")))
    out = tokencount.apply_edits(tokencount.with_trees(rows, c), c)
    for r in out.withColumn("n", tokencount.token_count()).collect():
        assert r["n"] == len(c.encoding.encode_ordinary(r["text"] or "")) and r["stats"] in ("x", "y")
    none = tokencount.apply_edits(tokencount.with_trees(rows.withColumn("edits", F.lit(None).cast(tokencount.EDITS)), c), c)
    assert {r["recoded"] for r in none.collect()} == {0}
    assert tokencount.apply_edits(tokencount.with_trees(rows.limit(0), c), c).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece

    library, table = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.PieceTable.load()
    random.seed(4)
    texts = [t for t in ODD if t is not None and "\x00" not in t] + ["  a  b ", "<s> <0x0A>", "ab" * 500, " ", "日本語 text", "http://a.b/c?d=" + "e1" * 60]
    texts += ["".join(random.choice("aeiou tnrs  \n.,ß日1%") for _ in range(random.randrange(200))) for _ in range(200)]
    for text, ids in zip(texts, table.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert table.decode(ids.tolist()) == text == library.decode(ids.tolist())


def test_unigram_fold_is_the_best_path():
    random.seed(6)
    words = ["<unk>", "a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁ab"]
    scores = [0.0] + [-random.random() * 3 for _ in words[1:]]
    table = pieces.PieceTable(words, scores, [pieces.UNKNOWN] + [pieces.NORMAL] * 9, pieces.UNIGRAM)

    def best(s):
        if not s:
            return 0.0
        return max((table.scores[table.id_of[s[:k]]] if s[:k] in table.id_of else table.worst if k == 1 else float("-inf")) + best(s[k:]) for k in range(1, min(3, len(s)) + 1))

    for n in (1, 5, 9, 60):
        text = "".join(random.choice("abc") for _ in range(n))
        ids = table.encode([text])[0].tolist()
        total = sum(table.scores[i] if i else table.worst for i in ids)
        if n < 20:
            assert abs(total - best(" " + text)) < 1e-9
        long = np.frombuffer(table._long(" " + text), np.int32) if isinstance(table._long(" " + text), bytes) else table._long(" " + text)
        assert abs(sum(table.scores[i] if i else table.worst for i in long.tolist()) - total) < 1e-9


def test_encoding_of_odd_rows(spark):
    table = pieces.PieceTable.load()
    rows = odd_docs(spark).select("doc_id", "text", "stats")
    back = pieces.decode(pieces.encode(rows, table), table)
    for r in back.collect():
        assert r["decoded"] == (r["text"] or "")
    at_once = pieces.encode(rows, table, decoded="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in at_once) and len(at_once) == len(ODD) + 2
    assert pieces.encode(rows.limit(0), table).count() == 0
    assert table.decode(table.encode(["a▁b"])[0]) == "a b"


def test_exceptions_are_learned_from_clean_documents(spark):
    clean = ["put it in the trash can today", "a trash can stood there", "the Trash can is full", "nothing here", "more trash talk"] + ["plain text"] * 20
    toxic = ["you are trash", "trash talk again", "pure trash you", "trash all of you", "such trash here", "trash, trash!"] * 2
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    flat = toxicity.Lexicon({"trash ": 2.0})
    sums = docs.join(labels, "doc_id").select(F.col("toxic").alias("y"), "text")
    assert toxicity.learned_exceptions(sums, flat) == ("trash can", "the trash", "the trash can")
    assert flat.contexts("Oh, tr4sh-can!  ok") == {"oh trash", "trash can", "oh trash can"} and flat.contexts("trash") == set() and flat.contexts(None) == set()
    learned = toxicity.Lexicon(flat.weights, ("trash can",))
    assert not learned.matches("a trash can")[0] and learned.matches("a trash bin")[0]


def test_learned_exceptions_flip_matches_of_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id"), 5, 0))
    bare = toxicity.Lexicon(lexicon.weights, (), lexicon.curve)
    assert lexicon.exceptions
    rows = docs.join(labels, "doc_id").select("text", "toxic").collect()
    flipped = [r["toxic"] for r in rows if len(bare.matches(r["text"])[0]) != len(lexicon.matches(r["text"])[0])]
    assert flipped and not any(flipped)
