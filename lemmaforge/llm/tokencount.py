"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens (the stretches that the tokenizer's pattern cuts, inside which
merges happen): leaves are blocks of LEAF pre-tokens with their characters and tokens, inner nodes hold sums, in heap
order. An edit finds its leaves by descending on characters. Scanning restarts a few pre-tokens before the edit, as a
pre-token may depend on what follows it, and goes on until a cut falls on an old leaf's start behind the edit: from
there the old cuts hold. Only that stretch is encoded again. Its leaves take up what it holds now, up to FULL pre-tokens
each (or none), and only the sums on their paths change; where they can't, they share with neighbours, ever more of them
until half of the room is free. The tree gets more leaves only when it is full as a whole.

Tokens of a pre-token come from the tokenizer itself; a bounded cache keeps frequent ones.

Defined cases: null text counts as empty and has an empty tree of 0 tokens; null or empty edits change nothing; edits
are ranges of code points of the text before any of them, clipped to it, applied from the last to the first, and must not
overlap; null replacement deletes; extra columns pass through, one with the output's name is replaced; the specials' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.llm.columns import Plain
from lemmaforge.session import workers_see_package

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 16
FULL = 4 * LEAF
BACK = 2
CACHE = 400_000
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TREE = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("leaf_chars", "leaf_tokens", "sum_chars", "sum_tokens")])
_TREE = pa.struct([(n, pa.list_(pa.int32())) for n in ("leaf_chars", "leaf_tokens", "sum_chars", "sum_tokens")])
EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Pre-tokens and their numbers of tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.pattern = ranks, pattern
        self._start()

    @classmethod
    def load(cls, path: str = RANKS) -> Counter:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})

    def _start(self) -> None:
        self.cut = regex.compile(self.pattern)
        self.encoding = tiktoken.Encoding("counter", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.cache: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.ranks, self.pattern = state["ranks"], state["pattern"]
        self._start()

    def counts(self, parts: list[str]) -> list[int]:
        got = list(map(self.cache.get, parts))
        if None in got:
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = [*dict.fromkeys(p for p, n in zip(parts, got, strict=True) if n is None)]
            fresh = {p: len(self.encoding.encode_ordinary(p)) for p in new}
            self.cache.update(fresh)
            got = [fresh[p] if n is None else n for p, n in zip(parts, got, strict=True)]
        return got


@dataclass
class Tree:
    """Leaves and the sums above them. sums[1] is the root, sums[i] covers sums[2 i] and sums[2 i + 1]."""

    leaf_chars: list[int]
    leaf_tokens: list[int]
    sum_chars: list[int]
    sum_tokens: list[int]

    @classmethod
    def over(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1
        while width < len(chars):
            width *= 2
        sums = []
        for leaves in (chars, tokens):
            s = [0] * width + leaves + [0] * (width - len(leaves))
            for i in range(width - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]
            sums.append(s)
        return cls(chars, tokens, *sums)

    @property
    def tokens(self) -> int:
        return self.sum_tokens[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        i, before, width = 1, 0, len(self.sum_chars) // 2
        while i < width:
            i *= 2
            if char - before >= self.sum_chars[i] and self.sum_chars[i + 1]:
                before += self.sum_chars[i]
                i += 1
        return min(i - width, max(0, len(self.leaf_chars) - 1)), before

    def tokens_before(self, leaf: int) -> int:
        """Tokens of the leaves before one, from subtree sums."""
        i, out = leaf + len(self.sum_tokens) // 2, 0
        while i > 1:
            if i % 2:
                out += self.sum_tokens[i - 1]
            i //= 2
        return out

    def replaced(self, first: int, last: int, chars: list[int], tokens: list[int]) -> tuple[Tree, int]:
        """Leaves first to last (exclusive) replaced, and the nodes written. As many leaves as before: only those on their paths."""
        if len(chars) != last - first:
            tree = Tree.over(self.leaf_chars[:first] + chars + self.leaf_chars[last:], self.leaf_tokens[:first] + tokens + self.leaf_tokens[last:])
            return tree, len(tree.sum_chars)
        touched = 0
        for leaves, sums, new in ((self.leaf_chars, self.sum_chars, chars), (self.leaf_tokens, self.sum_tokens, tokens)):
            leaves[first:last] = new
            width = len(sums) // 2
            sums[width + first : width + last] = new
            a, b = (width + first) // 2, (width + last - 1) // 2
            touched = last - first
            while a >= 1 and last > first:
                for i in range(a, b + 1):
                    sums[i] = sums[2 * i] + sums[2 * i + 1]
                touched += b + 1 - a
                a, b = a // 2, b // 2
        return self, touched


def _leaves(parts: list[str], counts: list[int], leaves: int = 0) -> tuple[list[int], list[int]]:
    """Characters and tokens of leaves: of `leaves` even ones where they can hold the parts, else of as many as fill up."""
    n = len(parts)
    if leaves and n <= FULL * leaves:
        at = [i * n // leaves for i in range(leaves + 1)]
    else:
        at = [*range(0, n, LEAF), n]
    return [sum(map(len, parts[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], [sum(counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def build(text: str | None, counter: Counter) -> Tree:
    parts = counter.cut.findall(text or "")
    return Tree.over(*_leaves(parts, counter.counts(parts)))


def edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
    """Text and tree after one replacement, and the characters that were encoded again."""
    return edited(text, tree, start, end, new, counter)[:3]


def edited(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int, int]:
    """What `edit` returns, and the nodes of the tree that were written."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    after, shift, n = text[:start] + new + text[end:], len(new) - (end - start), len(tree.leaf_chars)
    first, at = tree.leaf_at(start)
    while first > 0:  # whole pre-tokens of context before the edit
        cuts = [m.end() for m in counter.cut.finditer(text, at, start)]
        if len(cuts) > BACK:
            break
        first -= 1
        at -= tree.leaf_chars[first]
    parts, pos, last = [], at, n
    old, where = first, at  # the next old leaf that may go on, and its start
    for m in counter.cut.finditer(after, at):
        if m.start() > at and m.start() >= start + len(new):
            while old < n and (where < end or where + shift < m.start()):
                where += tree.leaf_chars[old]
                old += 1
            if old < n and where + shift == m.start():
                last = old
                break
        parts.append(m[0])
        pos = m.end()
    full = FULL
    while len(parts) > full * (last - first) and (first > 0 or last < n):  # share with as many neighbours again, until half is free
        more, full = max(1, last - first), FULL // 2
        low, high = max(0, first - more), min(n, last + more)
        at -= sum(tree.leaf_chars[low:first])
        pos += sum(tree.leaf_chars[last:high])
        first, last = low, high
        parts = [m[0] for m in takewhile(lambda m: m.start() < pos, counter.cut.finditer(after, at))]
    changed, touched = tree.replaced(first, last, *_leaves(parts, counter.counts(parts), last - first))
    return after, changed, pos - at, touched


def with_trees(docs: DataFrame, counter: Counter, text: str = "text", out: str = "tree") -> DataFrame:
    """`docs` with the segment tree of every text."""
    shared = workers_see_package(docs.sparkSession).sparkContext.broadcast(counter)
    plain = Plain(docs, [out], [text])
    docs, text = plain.docs, plain(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                trees = [vars(build(x.as_py(), shared.value)) for x in batch.column(text)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, _TREE)], names=[*batch.schema.names, out])

    return plain.back(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, TREE)])))


def token_count(tree: str = "tree") -> Column:
    """The root's sum."""
    return F.col(f"{tree}.sum_tokens")[1].cast("long")


def apply_edits(docs: DataFrame, counter: Counter, edits: str = "edits", text: str = "text", tree: str = "tree", out: str = "recoded") -> DataFrame:
    """`docs` with texts and trees after the edits of each row; `out` counts the characters encoded again."""
    shared = workers_see_package(docs.sparkSession).sparkContext.broadcast(counter)
    plain = Plain(docs, [out], [edits, text, tree])
    docs, edits, text, tree = plain.docs, plain(edits), plain(text), plain(tree)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, trees, coded = [], [], []
                for body, kept, changes in zip(batch.column(names.index(text)), batch.column(names.index(tree)), batch.column(names.index(edits)), strict=True):
                    body, kept, n = body.as_py(), Tree(**kept.as_py()), 0
                    for e in sorted((x for x in changes.as_py() or [] if x), key=lambda x: -x["start"]):
                        body, kept, more = edit(body or "", kept, e["start"], e["end"], e["text"] or "", shared.value)
                        n += more
                    texts.append(body)
                    trees.append(vars(kept))
                    coded.append(n)
                columns = [*batch.columns]
                columns[names.index(text)] = pa.array(texts, pa.string())
                columns[names.index(tree)] = pa.array(trees, _TREE)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.int64())], names=[*names, out])

    return plain.back(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])))


def sample_edits(text: Column) -> Column:
    """The query's edits: words put in after a quarter, sixteen characters cut out at the middle."""
    n = F.coalesce(F.length(text), F.lit(0))
    quarter, middle = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    put = F.struct(quarter.alias("start"), quarter.alias("end"), F.lit(" words put in ").alias("text"))
    cut = F.struct(middle.alias("start"), (middle + 16).alias("end"), F.lit("").alias("text"))
    return F.when(n >= 4, F.array(put, cut)).otherwise(F.array(put)).cast(EDITS)


def op2_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Tokens of every whole document, and again after two edits, with the characters that had to be encoded anew."""
    counter = Counter.load(ranks)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = with_trees(docs, counter).withColumns({"n_tokens": token_count(), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "edits": sample_edits(F.col("text"))})
    done = apply_edits(held, counter)
    return done.select("doc_id", "n_chars", "n_tokens", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("edited_chars"), token_count().alias("edited_tokens"), F.col("recoded").alias("recoded_chars"))
