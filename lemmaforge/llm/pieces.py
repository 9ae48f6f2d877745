"""SentencePiece encoding and decoding over a relational lattice.

Texts split into words at spaces and line breaks, which no piece of a fitting model crosses. For the distinct words of a
block: all substrings up to the longest piece are exploded, joined to the piece table on a 64-bit hash (and then
compared), the edges are grouped by word, and a fold over each word's edges picks the segmentation:

* unigram models: Viterbi, the path of the greatest score;
* BPE models: Viterbi over scores gives other pieces than the model's own encoder, since a merge's score only ranks it.
  The fold therefore applies merges: of the edges that join two neighbouring pieces the best score, leftmost first.

The join and the folds run as whole-array operations in Arrow batches. Exploding the lattice through shuffles and
folding with higher-order functions moves each word's edges over the network; the README has the figures.

Defined cases: null text counts as empty; empty text has no tokens; the mark U+2581 in a text is a space; characters
without a piece become byte pieces, or the unknown piece where the model has none; decoding replaces bytes that are
not UTF-8 by U+FFFD; ids outside the table raise; extra columns pass through, one with an output's name is replaced; equal texts have equal tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.llm.columns import Plain
from lemmaforge.session import workers_see_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 48
CACHE = 300_000
_SPLIT = re.compile(r" *[^ \n]+| +|\n")
_PRIME = np.uint64(0x100000001B3)
# Model types and piece types of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, raw[at : at + size]
            at += size


class PieceTable:
    """Pieces with scores and types, and the model's settings."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], kind: int = BPE, prefix: bool = True) -> None:
        self.pieces, self.kind, self.prefix = pieces, kind, prefix
        self.scores = np.array(scores, np.float64)
        if any(t in (USER_DEFINED, UNUSED) for t in types):
            raise ValueError("user-defined and unused pieces are not supported")
        plain = [p.replace(MARK, " ") for p in pieces]
        normal = [i for i, t in enumerate(types) if t == NORMAL]
        if any("\n" in plain[i] and len(plain[i]) > 1 or " " in plain[i].lstrip(" ") for i in normal):
            raise ValueError("a piece crosses a space or a line break")
        self.longest = max((len(plain[i]) for i in normal), default=1)
        self.id_of = {plain[i]: i for i in normal}
        self.bytes_of = {int(pieces[i][3:5], 16): i for i, t in enumerate(types) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(types) if t == UNKNOWN), 0)
        self.worst = float(self.scores[normal].min()) - 10.0 if normal else -10.0
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else plain[i].encode() for i, (p, t) in enumerate(zip(pieces, types, strict=True))]
        ids = np.array(normal, np.int64)
        hashes = np.array([self._hash(plain[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.sieve = np.zeros(1 << 19, bool)  # low bits of the hashes that occur
        self.sieve[self.hashes & np.uint64(len(self.sieve) - 1)] = True
        self._clear()

    @classmethod
    def load(cls, path: str = MODEL) -> PieceTable:
        """Read a model file."""
        pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
        with open(path, "rb") as f:
            model = f.read()
        for field, _, value in _fields(model):
            if field == 1:
                got = {k: v for k, _, v in _fields(value)}
                pieces.append(got.get(1, b"").decode())
                scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                types.append(got.get(3, NORMAL))
            elif field == 2:
                kind = next((v for k, _, v in _fields(value) if k == 3), UNIGRAM)
            elif field == 3:
                spec = {k: v for k, _, v in _fields(value)}
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("the model changes characters or drops spaces; only models that keep texts are supported")
                prefix = bool(spec.get(3, 1))
        return cls(pieces, scores, types, kind, prefix)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "begin", "count", "ids_of", "used")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._clear()

    @staticmethod
    def _hash(s: str) -> int:
        h = 1469598103934665603
        for c in s:
            h = (h * 0x100000001B3 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, chars: np.ndarray) -> np.ndarray:
        """For words of one length, an array of code points each: [word, begin, length - 1] -> piece or -1."""
        m, n = chars.shape
        top = min(self.longest, n)
        edges = np.full((m, n, top), -1, np.int32)
        rolled = np.full((m, n), np.uint64(1469598103934665603))
        for k in range(top):
            width = n - k
            rolled = rolled[:, :width] * _PRIME + chars[:, k : k + width] + np.uint64(1)
            w, i = np.nonzero(self.sieve[rolled & np.uint64(len(self.sieve) - 1)])
            found = rolled[w, i]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[at] == found
            edges[w[hit], i[hit], k] = self.ids[at[hit]]
        return edges

    def _folded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words of one length, one word after the other, and how many each word has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)
        edges = self.lattice(chars)
        starts = (self._merged if self.kind == BPE else self._best_path)(edges)
        m, n = chars.shape
        word, begin = np.nonzero(starts)
        end = np.append(begin[1:], n)
        end[np.append(word[1:] != word[:-1], True)] = n
        ids = edges[word, begin, end - begin - 1]
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # characters without a piece
            spare = [self._fallback(words[word[i]][begin[i]]) for i in bare.tolist()]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(f) for f in spare]
            word, ids = np.repeat(word, times), np.repeat(ids, times)
            ids[ids < 0] = [i for f in spare for i in f]
        return ids, np.bincount(word, minlength=m)

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_of else [self.unknown]

    def _merged(self, edges: np.ndarray) -> np.ndarray:
        """Fold by merges: where pieces start, for each word."""
        m, n, top = edges.shape
        starts = np.ones((m, n), bool)
        if n == 1:
            return starts
        cost = np.where(edges >= 0, self.scores[edges], -np.inf)
        left, right = np.tile(np.arange(-1, n), (m, 1)), np.tile(np.arange(1, n + 2), (m, 1))
        # gain[w, k]: score of joining the pieces on both sides of the boundary before character k
        gain = np.full((m, n + 1), -np.inf)
        gain[:, 1:n] = cost[:, : n - 1, 1] if top > 1 else -np.inf
        live = np.arange(m)
        while len(live):
            k = gain[live].argmax(1)
            going = gain[live, k] > -np.inf
            live, k = live[going], k[going]
            if not len(live):
                break
            a, b = left[live, k], right[live, k]
            starts[live, k] = False
            gain[live, k] = -np.inf
            right[live, a], left[live, b] = b, a
            for at in (a, b):
                p, q = left[live, at], right[live, at]
                ok = (at > 0) & (at < n) & (q - p <= top)
                score = cost[live, np.where(ok, p, 0), np.where(ok, q - p - 1, 0)]
                inner = (at > 0) & (at < n)
                gain[live[inner], at[inner]] = np.where(ok, score, -np.inf)[inner]
        return starts

    def _best_path(self, edges: np.ndarray) -> np.ndarray:
        """Fold by Viterbi: where pieces start, for each word. The longest piece wins a tie."""
        m, n, top = edges.shape
        cost = np.where(edges >= 0, self.scores[edges], -np.inf)
        cost[:, :, 0] = np.where(edges[:, :, 0] >= 0, cost[:, :, 0], self.worst)
        best, back = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int64)
        best[:, 0] = 0
        for q in range(1, n + 1):
            ways = np.stack([best[:, q - k] + cost[:, q - k, k - 1] for k in range(min(top, q), 0, -1)], 1)
            k = ways.argmax(1)
            best[:, q], back[:, q] = ways[np.arange(m), k], q - (min(top, q) - k)
        starts = np.zeros((m, n), bool)
        at = np.full(m, n)
        while (at > 0).any():
            live = at > 0
            at[live] = back[live, at[live]]
            starts[np.flatnonzero(live), at[live]] = True
        return starts

    def _long(self, word: str) -> np.ndarray:
        """One very long word: the same folds with a heap, or a rolling Viterbi row, over the same edges."""
        n = len(word)
        piece = lambda a, b: self.id_of.get(word[a:b], -1) if b - a <= self.longest else -1
        if self.kind == BPE:
            left, right, alive = list(range(-1, n)), list(range(1, n + 2)), [True] * (n + 1)
            heap: list[tuple[float, int, int, int]] = []

            def offer(k: int) -> None:
                if 0 < k < n and (i := piece(left[k], right[k])) >= 0:
                    heapq.heappush(heap, (-self.scores[i], k, left[k], right[k]))

            for k in range(1, n):
                offer(k)
            while heap:
                _, k, a, b = heapq.heappop(heap)
                if alive[k] and left[k] == a and right[k] == b:
                    alive[k] = False
                    right[a], left[b] = b, a
                    offer(a)
                    offer(b)
            cuts = [k for k in range(n + 1) if alive[k]]
        else:
            best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for q in range(1, n + 1):
                for p in range(max(0, q - self.longest), q):
                    i = piece(p, q)
                    score = self.scores[i] if i >= 0 else self.worst if q - p == 1 else float("-inf")
                    if best[p] + score > best[q]:
                        best[q], back[q] = best[p] + score, p
            cuts = [n]
            while cuts[-1]:
                cuts.append(back[cuts[-1]])
            cuts.reverse()
        ids: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = piece(a, b)
            ids += [i] if i >= 0 else self._fallback(word[a:b])
        return np.array(ids, np.int32)

    def _clear(self) -> None:
        """No words known: a word's place in `begin` and `count`, which point into the token ids of all known words."""
        self.known: dict[str, int] = {}
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids_of, self.used = np.zeros(1 << 18, np.int32), 0

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(words)
        while last > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.ids_of):
            self.ids_of = np.resize(self.ids_of, 2 * len(self.ids_of))
        self.known.update(zip(words, range(first, last), strict=True))
        self.count[first:last] = counts
        self.begin[first:last] = self.used + np.cumsum(counts) - counts
        self.ids_of[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, each given once."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for n, group in by_size.items():
            if n > LONG:
                for w in group:
                    ids = self._long(w)
                    self._keep([w], ids, np.array([len(ids)]))
                continue
            step = max(1, (1 << 18) // n)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self._keep(part, *self._folded(part))

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        return _SPLIT.findall(" " + text if self.prefix else text)

    def encode_words(self, words: list[str]) -> np.ndarray:
        """Token ids of words, one after the other, without the cache."""
        return np.concatenate([np.zeros(0, np.int32), *[self._long(w) if len(w) > LONG else self._folded([w])[0] for w in words]])

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and where each text's begin (with the total at the end)."""
        if len(self.known) > CACHE:
            self._clear()
        split = [self.words(t) for t in texts]
        words = list(chain.from_iterable(split))
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0).tolist()
        if new:
            fresh = [words[i] for i in new]
            self.learn(list(dict.fromkeys(fresh)))
            place[new] = [self.known[w] for w in fresh]
        count = self.count[place]
        upto = np.concatenate(([0], np.cumsum(count)))
        tokens = self.ids_of[np.repeat(self.begin[place] - upto[:-1], count) + np.arange(upto[-1])]
        return tokens, upto[np.concatenate(([0], np.cumsum([len(ws) for ws in split])))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        tokens, at = self.encode_block(texts)
        return [tokens[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, table: PieceTable, text: str = "text", out: str = "tokens", decoded: str | None = None) -> DataFrame:
    """`docs` with the token ids of every text; `decoded` names a column for the text that they give back."""
    plain = Plain(docs, [out, *([decoded] if decoded else [])], [text])
    docs, text = plain.docs, plain(text)
    shared = workers_see_package(docs.sparkSession).sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                tokens, begins = known.encode_block(batch.column(text).to_pylist())
                columns = [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(tokens))]
                if decoded:
                    ends = begins.tolist()
                    columns.append(pa.array([known.decode(tokens[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, out, *filter(None, [decoded])])

    extra = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return plain.back(docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra])))


def decode(rows: DataFrame, table: PieceTable, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """`rows` with the text of their token ids."""
    plain = Plain(rows, [out], [tokens])
    rows, tokens = plain.docs, plain(tokens)
    shared = workers_see_package(rows.sparkSession).sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(tokens)
                values, begins = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
                got = [known.decode(values[a:b].tolist()) for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, out])

    return plain.back(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document encoded and decoded again: token count, a digest of the ids and of the text they give back."""
    table = PieceTable.load(model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = encode(docs, table, decoded="decoded")
    return back.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce(F.replace("text", F.lit(MARK), F.lit(" ")), F.lit(""))).alias("round_trip"),
    )
