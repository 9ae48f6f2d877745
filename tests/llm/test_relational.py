"""The relational lattice against the Arrow form and the library."""

import random

import pytest
import sentencepiece

from lemmaforge.llm import pieces, relational

ODD = [None, "", " ", "\n", "▁a▁", "a  b   c", "naïve Ω 日本語 \U0001f600 x", "tab\tand\r\nline", "w" * 60 + " end", "  lead", "the the the", "supercalifragilistic expialidocious"]


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_relational_bpe_equals_the_library(spark, sf, scope):
    texts = ODD + [r["text"][:400] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").limit(12).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    frame = spark.createDataFrame([(i % 20, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = sorted(((r["doc_id"], list(r["tokens"])) for r in relational.encode(frame, pieces.PieceTable.load(), scope=scope).collect()), key=repr)
    assert got == sorted(((i % 20, library.encode((t or "").replace("▁", " "))) for i, t in enumerate(texts)), key=repr)


def test_relational_viterbi_equals_the_arrow_form(spark):
    random.seed(41)
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "aa"]
    table = pieces.PieceTable(names, [0.0] + [-random.random() * 5 for _ in names[1:]], [2] + [1] * (len(names) - 1), pieces.UNIGRAM)
    texts = ["".join(random.choice("abc d") for _ in range(random.randrange(30))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["tokens"]) for r in relational.encode(frame, table).collect()}
    assert got == {i: x.tolist() for i, x in enumerate(table.encode(texts))}


def test_relational_empty_table(spark):
    assert relational.encode(spark.createDataFrame([], "doc_id long, text string"), pieces.PieceTable.load()).count() == 0
