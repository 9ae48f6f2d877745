"""Line dedup: winnowing over line hashes finds repeated passages, and later repeats are deleted word by word.

Words are runs without white space; what stands between them doesn't count, nor do line breaks, which copies often lose. A line
ends behind a word that ends in one of . ! ? and, where no such end is near, before a word whose hash is the least of some `reach`
words around it; so lines are decided by the words about them alone, and long ones are cut. Every stretch of `least` words that
stands at an earlier place is deleted. A window is `least` consecutive words, wherever it starts. Its seed is the smallest hash
among the shortest runs of lines of at least least / 6 words that lie inside it, with the words that decide their ends (the last
one of equals). `reach` is chosen so that every window holds such a run: the seed is a guaranteed fingerprint, and equal windows
have equal seeds at equal offsets. Steps:

1. neighbouring windows with one seed form a span; each span gives one row of seed, content hash and place;
2. of spans with equal content (128 bits of hash) all but the first place (least id, then text hash, then position) are
   marked whole;
3. where a seed has spans of different content, matches end inside them: the first places of those spans are keyed window by
   window, and all but the first place of each window are marked, which extends matches word by word at both ends;
4. marked words are deleted.

Any other occurrence of a window stands in a span that step 2 marked and whose first place takes part in step 3, so the marks
are those of comparing all windows. A deleted word always has an earlier copy, so one copy of it stays.

Defined cases: null and empty texts stay as they are; rows with equal id and equal text are one document, and are edited alike;
a null id sorts first; ids are whole numbers, others are refused; a text that consists only of repeats becomes empty; white space
before a deleted stretch stays, white space behind it goes; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.llm.columns import Plain, whole_numbers
from lemmaforge.session import cut, release, workers_see_package

MIN_WORDS = 50
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 64
_SPAN = "ps_s long, ps_h long, ps_g long, ps_k long, ps_t long, ps_a int, ps_n int"
_KEYED = "ps_w long, ps_v long, ps_k long, ps_t long, ps_a int"
_OTHER = np.uint64(0xD6E8FEB86659FD93)
#: White space of str.split, by code point: the last and those above are none.
_BLANK = np.array([chr(i).isspace() for i in range(0x3002)])
_WIDE = [chr(i).encode() for i in np.flatnonzero(_BLANK).tolist() if i >= 128]
_WIDE_2, _WIDE_3 = (np.array([int.from_bytes(c, "big") for c in _WIDE if len(c) == n]) for n in (2, 3))
_PAIRS = np.isin(np.arange(1 << 16), [int.from_bytes(c[:2], "big") for c in _WIDE])
#: Bytes of UTF-8: 1 is white space, 2 may begin white space of several bytes, 0 is neither.
_KIND = bytes(2 if i in {c[0] for c in _WIDE} else int(i < 128 and chr(i).isspace()) for i in range(256))
_ENDS = np.isin(np.arange(256), list(b".!?"))
#: Words of more bytes are hashed one by one, others eight bytes at a time for all words at once.
_LONG = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sizes(least: int) -> tuple[int, int]:
    """Words that a run of lines has at least, and the reach: how many words on either side may decide where a line ends.

    Two ends are at most 3 reach - 2 words apart, so the first one that a window decides stands within its first 4 reach - 2
    words, and the run behind it ends 3 reach - 3 + run words later at most; both fit while 8 reach + run - 6 <= least.
    """
    run = max(1, least // 6)
    return run, (least - run + 6) // 8


def _least_of(value: np.ndarray, wide: int) -> np.ndarray:
    """Where the least of each `wide` neighbours stands, the last of equals."""
    low, best, reach = value, np.arange(len(value)), 1
    while reach < wide:
        step = min(reach, wide - reach)
        later = low[step:] <= low[:-step]
        low, best = np.where(later, low[step:], low[:-step]), np.where(later, best[step:], best[:-step])
        reach += step
    return best


def _utf8(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one text behind the other and then eight zeros, and where each text starts; null is empty."""
    column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in bytes, as str.split finds them in each text."""
    kind = np.frombuffer(data[: offsets[-1] + 2].tobytes().translate(_KIND), np.uint8)
    blank = kind == 1
    lead = np.flatnonzero(kind == 2)
    if len(lead):
        code = data[lead].astype(np.int64) << 8 | data[lead + 1]
        lead, code = lead[_PAIRS[code]], code[_PAIRS[code]]
        for wide, size in (lead[np.isin(code, _WIDE_2)], 2), (lead[np.isin(code << 8 | data[lead + 2], _WIDE_3)], 3):
            for i in range(size):
                blank[wide + i] = True
    word = ~blank[:-2]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= blank[:-3]
    ends[:-1] &= blank[1:-2]
    begins[edges] = word[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    ends[edges] = word[edges]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x *= _OTHER
    x ^= x >> np.uint64(32)
    x *= np.uint64(_BASE)
    x ^= x >> np.uint64(29)
    return x


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes and their number; equal words have equal ones."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each byte on
    size = ends - begins
    value = _mix(size.astype(np.uint64) * np.uint64(_BASE) ^ eights[begins] & _LOW_BYTES[np.minimum(size, 8)])
    rest = np.flatnonzero((size > 8) & (size <= _LONG))
    for at in range(8, _LONG, 8):
        value[rest] = _mix(value[rest] ^ eights[begins[rest] + at] & _LOW_BYTES[np.minimum(size[rest] - at, 8)])
        rest = rest[size[rest] > at + 8]
    if len(long := np.flatnonzero(size > _LONG)):
        raw = memoryview(data)
        value[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True)]
    return value


class Words:
    """Hashes of the words of several texts, one text behind the other, and where each text's words start."""

    def __init__(self, texts: pa.Array | list[str | None]) -> None:
        data, offsets = _utf8(texts)
        begins, ends = _bounds(data, offsets)
        self.starts = np.searchsorted(begins, offsets)
        self.n = len(begins)
        self.closes = _ENDS[data[ends - 1]]  # words behind which a line ends
        self.hashes = hashes = _hashes(data, begins, ends)
        up, self.down = _powers(self.n)
        zero = np.zeros(1, np.uint64)
        self.poly = np.concatenate((zero, np.cumsum(hashes * up[: self.n], dtype=np.uint64)))
        mixed = (hashes ^ (hashes >> np.uint64(32))) * _OTHER
        self.more = np.concatenate((zero, np.cumsum((mixed ^ (mixed >> np.uint64(29))) * up[: self.n], dtype=np.uint64)))

    def keys(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Content hashes of stretches, alike wherever they stand."""
        return (self.poly[end] - self.poly[begin]) * self.down[begin]

    def both_keys(self, begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
        """Content hashes of 128 bits: the second sum runs over other hashes of the words."""
        return [_signed(self.keys(begin, end)), _signed((self.more[end] - self.more[begin]) * self.down[begin])]

    def line_starts(self, reach: int) -> np.ndarray:
        """The words at which a line starts. Whether one does is decided by the `reach` words before it and from it on."""
        if not reach:
            return np.arange(self.n)
        start = np.concatenate(([False], self.closes[:-1]))
        if self.n >= reach:
            doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
            best = _least_of(self.hashes, reach)[doc[: self.n - reach + 1] == doc[reach - 1 :]]
            upto = np.concatenate((np.zeros(reach, np.int64), np.cumsum(start), np.full(reach, start.sum())))
            free = upto[2 * reach - 1 + np.arange(self.n)] == upto[np.arange(self.n)]  # no line ends within the reach
            chosen = np.zeros(self.n, bool)
            chosen[best] = True
            start |= chosen & free
        return np.flatnonzero(start)

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seed, first window and number of windows of each span, and the text that holds it."""
        run, reach = sizes(least)
        none = np.zeros(0, np.int64)
        empty = none.astype(np.uint64), none, none, none
        if self.n < least:
            return empty
        doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        at = np.flatnonzero(doc[: self.n - least + 1] == doc[least - 1 :])
        if not len(at):
            return empty
        cuts = np.append(self.line_starts(reach), self.n)
        until = np.searchsorted(cuts, cuts + run)
        begin = cuts[until < len(cuts)]
        end = cuts[until[until < len(cuts)]]
        value = self.keys(begin, end)
        under = lambda x: np.concatenate(([0], np.cumsum(np.bincount(x, minlength=self.n + 1))))  # noqa: E731  how many are less, by place
        low = under(begin)[at + reach]  # the first run of lines whose start the window decides
        count = under(end)[at + (least - reach + 1)] - low
        seed = np.arange(len(value))
        chosen = seed[low]
        for k in range(1, int(count.max()).bit_length()):  # seed: the least of 2 ** k neighbours
            half = 1 << (k - 1)
            a, b = seed[:-half], seed[half:]
            seed = np.where(value[b] <= value[a], b, a)
            wide = count >= 1 << k
            first, last = seed[low[wide]], seed[low[wide] + count[wide] - (1 << k)]
            chosen[wide] = np.where(value[last] <= value[first], last, first)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        return value[chosen[first]], at[first], np.diff(np.append(first, len(at))), doc[at[first]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _CHUNK):
            yield whole.slice(at, _CHUNK)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _spans(keyed: DataFrame, text: str, least: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            words = Words(batch.column(2))
            seed, a, n, doc = words.spans(least)
            take = pa.array(doc)
            columns = [_signed(seed), *words.both_keys(a, a + n - 1 + least), batch.column(0).take(take), batch.column(1).take(take), pa.array((a - words.starts[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["ps_s", "ps_h", "ps_g", "ps_k", "ps_t", "ps_a", "ps_n"])

    return keyed.select("ps_k", "ps_t", F.col(text)).mapInArrow(emit, _SPAN)


def _windows(joined: DataFrame, text: str, least: int) -> DataFrame:
    """The windows of the listed spans, by content."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            words = Words(batch.column(text))
            spans = batch.column("ps_spans")
            count = spans.value_lengths().to_numpy(zero_copy_only=False)
            doc, pair = np.repeat(np.arange(len(count)), count), spans.flatten().to_numpy(zero_copy_only=False)
            n = pair & 0xFFFFFFFF
            doc, inside = np.repeat(doc, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = np.repeat(pair >> 32, n) + inside
            at, take = a + words.starts[doc], pa.array(doc)
            columns = [*words.both_keys(at, at + least), batch.column("ps_k").take(take), batch.column("ps_t").take(take), pa.array(a.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["ps_w", "ps_v", "ps_k", "ps_t", "ps_a"])

    return joined.mapInArrow(emit, _KEYED)


def _packed(a, b):
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def repeated_words(keyed: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(ps_k, ps_t, ps_marks): stretches of words that repeat an earlier place, as begin * 2^32 + end, by document.

    `keyed` has the document's id as ps_k and its text's hash as ps_t. Rows with equal ones are one document: equal rows
    repeat each other's places, which are not later ones. First places come from partial minima, and rows meet them in
    joins of stored tables, whose large partitions Spark may split; no task gathers the rows of a common seed or window.
    """
    place = F.struct("ps_k", "ps_t", "ps_a")
    spans = cut(_spans(keyed, text, least), "spans")
    mixed = (F.min("ps_h") != F.max("ps_h")) | (F.min("ps_g") != F.max("ps_g"))
    seeds = cut(spans.groupBy("ps_s").agg(F.count("*").alias("n"), mixed.alias("mixed")).filter("n > 1").select("ps_s", "mixed"), "seeds")
    live = cut(spans.join(seeds, "ps_s").drop("ps_s"), "live-spans")
    release(spans, seeds)
    firsts = cut(live.groupBy("ps_h", "ps_g").agg(F.min(place).alias("first"), F.max("ps_n").alias("width"), F.max("mixed").alias("mixed"), F.count("*").alias("n")), "first-spans")
    again = firsts.filter("n > 1").select("ps_h", "ps_g", "first")
    later = live.join(again, ["ps_h", "ps_g"]).filter(place != F.col("first")).select("ps_k", "ps_t", "ps_a", "ps_n")
    open_ = firsts.filter("mixed").groupBy(F.col("first.ps_k"), F.col("first.ps_t")).agg(F.collect_set(_packed(F.col("first.ps_a"), F.col("width"))).alias("ps_spans"))
    windows = cut(_windows(keyed.select("ps_k", "ps_t", text).join(open_, ["ps_k", "ps_t"]), text, least), "windows")
    held = cut(windows.groupBy("ps_w", "ps_v").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("ps_w", "ps_v", "first"), "first-windows")
    fine = windows.join(held, ["ps_w", "ps_v"]).filter(place != F.col("first")).select("ps_k", "ps_t", "ps_a", F.lit(1).alias("ps_n"))
    found = later.unionByName(fine).groupBy("ps_k", "ps_t").agg(F.collect_set(_packed(F.col("ps_a"), F.col("ps_a") + F.col("ps_n") + (least - 1))).alias("ps_marks"))
    marks = cut(found, "marks")
    release(live, firsts, windows, held)
    return marks


def _merged(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """The union of ranges, sorted by begin, as begin, end, begin, end and so on."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return np.column_stack((begin[new], reach[np.append(new[1:], len(begin)) - 1])).ravel().tolist()


def without_runs(text: str, runs: list[list[int]]) -> tuple[str, int]:
    """The text without the stretches, and the words that went."""
    ranges = np.array([x for r in runs for x in r], np.int64).reshape(-1, 2)
    bounds = _merged(*ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].T)
    kept, removed, at = [], 0, 0
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        kept.append(text[at:a])
        removed += len(text[a:b].split())
        at = b
    kept.append(text[at:])
    whole = "".join(kept)
    return (whole.rstrip() if bounds and bounds[-1] == len(text) else whole), removed


def without_words(text: str, marks: np.ndarray) -> tuple[str, int]:
    """The text without the marked words, and their number."""
    blank = _BLANK.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    begins = np.concatenate(([0], begins[1:], [len(text)]))
    return without_runs(text, np.column_stack((begins[marks >> 32], begins[marks & 0xFFFFFFFF])).tolist())


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """`docs` without later repeats of `least` words or more; `removed` names a column for the words that went."""
    workers_see_package(docs.sparkSession)
    plain = Plain(docs, [removed] if removed else [], [key, text])
    docs, key, text = plain.docs, whole_numbers(plain.docs, plain(key), key), plain(text)
    keyed = docs.withColumns({"ps_k": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "ps_t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    joined = keyed.join(repeated_words(keyed, text, least), ["ps_k", "ps_t"], "left").select(*docs.columns, "ps_marks")
    place = docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            column, marked = batch.column(place), batch.column(batch.num_columns - 1)
            marks, texts, counts = marked.is_valid(), [], np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(marks.to_numpy(zero_copy_only=False)).tolist():  # texts without marks stay in Arrow
                body, counts[i] = without_words(column[i].as_py() or "", marked[i].values.to_numpy(zero_copy_only=False))
                texts.append(body)
            columns, names = [*batch.columns[:-1]], batch.schema.names[:-1]
            columns[place] = pc.replace_with_mask(column, marks, pa.array(texts, column.type)) if texts else column
            if removed:
                columns, names = [*columns, pa.array(counts, pa.int64())], [*names, removed]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = [T.StructField(removed, T.LongType())] if removed else []
    return plain.back(joined.mapInArrow(rewrite, T.StructType([*docs.schema.fields, *extra])))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: words removed as later repeats of 50 words or more, and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_passages(docs, removed="n_removed").select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
