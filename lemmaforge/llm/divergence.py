"""Source divergence audit: how differently the sources of a language use its terms.

Terms are runs of a-z and everything beyond ASCII, after A-Z is lower-cased. A language keeps the terms that occur in at
least `least` of its documents. Every source, and the language as a whole, gives each kept term a smoothed share in
billionths; two sources differ by the sum of the absolute differences over all kept terms, and a source's own terms are
those that it uses more than its language does.

Sort-based and streaming. Each task counts the documents that it reads by (lang, source, term), so that a frequent term leaves it
as one row a source and not as one a document; a full table of counts is passed on and begun anew. These rows are dealt by
(lang, term) and sorted by (lang, term, source, block), the block being the part of the documents that they come from. One scan
adds up each run: its end gives a source's count, and the end of the term its document frequency, and a term that
is frequent enough leaves as one row with its sources and their counts. A second scan over those rows, which are few
beside the texts, emits for every term the partial distances of the pairs that it tells apart and the candidates for
each source's own terms; what a task holds is passed on when it is full, and summed or ranked in the end.

For terms that neither of two sources has, both shares are the smoothed zero. Their difference is taken once for the whole
vocabulary, and a term adds only how far it departs from that, so that work follows the counts, not terms times pairs.

All arithmetic is in whole numbers: products of counts and a billion are taken in 64 bits where they fit, else exactly in Python.
A language's sources go with each of its terms to the second scan, as a table of a row for each language; it is broadcast only while the
groups are at most MAX_BROADCAST_GROUPS, and joined by a shuffle beyond. A term's sources are held together: the result has
their square in rows.

Defined cases: null text, lang and source count as empty; empty texts give no terms, but their group is there; repeated rows are
documents of their own; a language without kept terms has distances of 0 and no terms; one with a single source has no
pairs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.session import cut, workers_see_package

LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
MAX_BROADCAST_GROUPS = 20_000
HELD_TERMS = 400_000  # counts that a task holds
HELD_CELLS = 1_000_000  # partial distances that a task holds
HELD_OWN = 200_000  # candidates that a task holds
SLICE = 1 << 20
_KEPT = {*range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
COUNTS = "lang string, term string, source string, block long, docs long, n long"
KEPT = "lang string, term string, docs long, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"


def counted(raw: bytes) -> Counter:
    """The terms of a UTF-8 text and how often it has each."""
    folded, at, found = raw.translate(_FOLD), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """COUNTS of `docs` (lang, source, text): partial sums over the documents of a block."""

    def passed(tables: dict[tuple[str, str], dict[bytes, list[int]]], block: int) -> Iterator[pa.RecordBatch]:
        for (lang, source), table in tables.items():
            k = len(table)
            columns = [pa.array([lang] * k, pa.string()), pa.array(list(table), pa.binary()).cast(pa.string()), pa.array([source] * k, pa.string()), pa.array(np.full(k, block, np.int64)), *(pa.array([v[i] for v in table.values()], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "block", "docs", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size, block = {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                table = tables.setdefault((lang, source), {})
                before = len(table)
                for term, n in counted(raw.as_py()).items():
                    got = table.get(term)
                    if got is None:
                        table[term] = [1, n]
                    else:
                        got[0] += 1
                        got[1] += n
                size += len(table) - before
                if size > held:
                    yield from passed(tables, block)
                    tables, size, block = {}, 0, block + 1
        yield from passed(tables, block)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(scan, COUNTS)


def _begins(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in some column; the first row begins."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
    return out


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """KEPT of every term of enough documents: the runs of `counts` dealt by (lang, term) and sorted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term: tuple[str, str] | None = None
        docs, sources, sums = 0, [], []
        done: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new_term = _begins(batch.column("lang"), batch.column("term"))
            starts = np.flatnonzero(new_term | _begins(batch.column("source")))
            run_docs, run_n = (np.add.reduceat(np.asarray(batch.column(c)), starts) for c in ("docs", "n"))
            heads = batch.select(["lang", "term", "source"]).take(pa.array(starts)).to_pydict()
            for lang, word, source, d, n in zip(heads["lang"], heads["term"], heads["source"], run_docs.tolist(), run_n.tolist(), strict=True):
                if (lang, word) != term:
                    if docs >= least:
                        done.append((*term, docs, sources, sums))
                    term, docs, sources, sums = (lang, word), 0, [], []
                docs += d
                if sources and sources[-1] == source:  # the run goes on from the batch before
                    sums[-1] += n
                else:
                    sources.append(source)
                    sums.append(n)
            yield _rows(done)
            done = []
        if docs >= least:
            done.append((*term, docs, sources, sums))
        yield _rows(done)

    sorted_runs = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    return sorted_runs.mapInArrow(scan, KEPT)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["lang", "term", "docs", "sources", "counts"])


def shares(counts: list[int], totals: list[int], terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exactly."""
    if max(counts, default=0) < (2**63 - 1) // SCALE - SMOOTH:
        c, n = np.array(counts, np.int64), np.array(totals, np.int64)
        return 1 + SCALE * (c + SMOOTH) // (n + SMOOTH * terms)
    return np.array([1 + SCALE * (c + SMOOTH) // (n + SMOOTH * terms) for c, n in zip(counts, totals, strict=True)], np.int64)


class Language:
    """The sources of a language, and what a task has found about them so far."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], terms: int) -> None:
        self.lang, self.sources, self.totals, self.terms, self.whole = lang, sources, totals, terms, sum(totals)
        self.at = {s: i for i, s in enumerate(sources)}
        self.zero = shares([0] * len(sources), totals, terms)
        self.cells: dict[int, np.ndarray] = {}
        self.own: dict[int, list[tuple[int, tuple[int, ...], str]]] = {}

    def add(self, term: str, sources: list[str], counts: list[int], top: int) -> None:
        has = np.array([self.at[s] for s in sources])
        p = self.zero.copy()
        p[has] = shares(counts, [self.totals[i] for i in has], self.terms)
        apart = np.abs(p[has][:, None] - p[None, :]) - np.abs(self.zero[has][:, None] - self.zero[None, :])
        apart[:, has] = np.triu(apart[:, has])  # of two that have the term, the first has their difference; sources are in order
        for i, row in zip(has.tolist(), apart, strict=True):
            if i in self.cells:
                self.cells[i] += row
            else:
                self.cells[i] = row.copy()
        q = int(shares([sum(counts)], [self.whole], self.terms)[0])
        order = tuple(-ord(c) for c in term) + (1,)  # of equal values the least term is wanted, so it ranks highest
        for i in has.tolist():
            if p[i] > q:
                heap = self.own.setdefault(i, [])
                (heapq.heappush if len(heap) < top else heapq.heappushpop)(heap, (int(p[i]) - q, order, term))

    def passed(self) -> Iterator[tuple]:
        """Rows of FOUND, for either direction of a pair."""
        for i, row in self.cells.items():
            for j in np.flatnonzero(row).tolist():
                yield self.lang, self.sources[i], "pair", self.sources[j], int(row[j])
                yield self.lang, self.sources[j], "pair", self.sources[i], int(row[j])
        for i, heap in self.own.items():
            for value, _, term in heap:
                yield self.lang, self.sources[i], "term", term, value
        self.cells, self.own = {}, {}


def partial_findings(terms: DataFrame, top: int = TOP) -> DataFrame:
    """FOUND of kept terms that carry their language's sources, totals and number of terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, Language] = {}
        cells = own = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for k, (lang, term, sources, counts) in enumerate(zip(langs, *(batch.column(c).to_pylist() for c in ("term", "sources", "counts")), strict=True)):
                if lang not in languages:
                    languages[lang] = Language(lang, *(batch.column(c)[k].as_py() for c in ("every", "totals", "terms")))
                now = languages[lang]
                cells, own = cells - len(now.cells) * len(now.sources), own - sum(map(len, now.own.values()))
                now.add(term, sources, counts, top)
                cells, own = cells + len(now.cells) * len(now.sources), own + sum(map(len, now.own.values()))
                if cells > HELD_CELLS or own > HELD_OWN:
                    yield from _found(languages)
                    cells, own, languages = 0, 0, {}
        yield from _found(languages)

    return terms.mapInArrow(scan, FOUND)


def _found(languages: dict[str, Language], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    names, rows = ["lang", "source", "part", "item", "value"], []
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    for language in languages.values():
        for row in language.passed():
            rows.append(row)
            if len(rows) >= size:
                yield batch(rows)
                rows = []
    yield batch(rows)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, max_broadcast_groups: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of each source to the others of its language (part `pair`), and its
    `top` terms beyond the language's share (part `term`)."""
    workers_see_package(docs.sparkSession)
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    plain = docs.select(blank(lang, "lang"), blank(source, "source"), blank(text, "text"))
    terms = cut(kept_terms(term_counts(plain), least), "kept-terms")
    sums = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    groups = cut(plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    profile = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("x")).join(vocabulary, "lang")
    profile = profile.select("lang", F.col("x.source").alias("every"), F.col("x.total").alias("totals"), "terms")
    small = groups.limit(max_broadcast_groups + 1).count() <= max_broadcast_groups
    found = cut(partial_findings(terms.join(F.broadcast(profile) if small else profile, "lang"), top), "findings")
    at = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(at)
    own = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    done = pairs_of(groups, vocabulary).join(found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("apart")), ["lang", "source", "item"], "left")
    pairs = done.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("apart", F.lit(0))).alias("value")).withColumn("rank", rank)
    return pairs.unionByName(own)


def pairs_of(groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, item, base): all pairs of a language, which are the result's rows, with the distance of their zero shares
    over its whole vocabulary."""
    zero = F.expr(f"1 + cast({SCALE * SMOOTH}L div (total + {SMOOTH} * terms) as long)")
    with_zero = groups.join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.when(F.col("terms") > 0, zero).otherwise(F.lit(0)).alias("zero"))
    other = with_zero.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    both = with_zero.join(other, "lang").filter(F.col("source") != F.col("item"))
    return both.select("lang", "source", "item", (F.abs(F.col("zero") - F.col("item_zero")) * F.col("terms")).alias("base"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all `documents`."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p FROM cell JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS q
      FROM (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)) JOIN v USING (lang)),
ab AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT ab.lang, ab.source, 'pair' AS part, ab.item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM ab LEFT JOIN pr ON pr.lang = ab.lang AND pr.source = ab.source AND pr.item = ab.item
      UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
