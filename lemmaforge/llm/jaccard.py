"""N-gram Jaccard join: a grouped prefix join with exact verification.

A document's set holds its distinct shingles of `n` words (words end at ASCII white space, A-Z is lower-cased); with
fewer words the whole sequence is the one shingle, without words the set is empty. Two sets link when
`den` * intersection >= `num` * union. Steps:

1. hash shingles; documents with equal sets become one class, which is all that later steps see of them;
2. order shingles: very frequent ones (found by partial counts, a bounded list) last, the others by hash. Any order
   that all documents share is exact for prefix filtering; this one keeps posting lists short;
3. classes with the same size and the same prefix become one group (held in at most GROUP_ROWS rows); groups whose
   prefixes share a shingle meet in that shingle's posting; of shingles that list the same groups (by count and 128
   bits of hash) one is enough. A long posting is cut into blocks and block pairs, cells
   of bounded size. In a cell, pairs of groups pass on the length filter and on the shared shingle's places in both
   prefixes; only members of groups in a pair that passed are expanded, and pass on a parity bitmap, whose Hamming
   distance never exceeds the sets' symmetric difference. A cell returns one edge for each member, not its pairs;
4. candidate edges give clusters; the sets of a cluster's classes meet, again in cells of bounded size, and all their
   pairs are verified exactly. A cell returns each class's links and one edge within its verified part;
5. those edges give the components.

No step emits pairs within a group, so all tables stay linear in the input, times the cells that a very long posting
or cluster is cut into. Links are counted over documents, copies included.

Defined cases: null text has an empty set, linked with nothing; repeated rows are separate documents with equal sets,
also when ids repeat; a null id is never the smallest of its component unless all are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm.columns import whole_numbers
from lemmaforge.llm.components import components
from lemmaforge.session import cut, release, workers_see_package

HOT_LEAST = 32
HOT_MOST = 100_000
GROUP_ROWS = 16
POSTING_BLOCK = 1024
CELL_BYTES = 8 << 20
CELL_SETS = 1500
SIEVE_LEAST, SIEVE_MOST = 1 << 23, 1 << 29
WIDTHS = (512, 4096, 32768, 262144)
_LOW = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 128


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [(t or b"").translate(_LOW).split() for t in texts]
    counts = np.array([len(w) for w in split])
    flat = np.fromiter((h for w in split for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(counts.sum()))
    rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + len(rolled)]
    rolled, out, at = _mixed(rolled), [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + c].tobytes(), c + 1)] if c else [], np.uint64))
        at += c
    return out


def prefix_size(size: int, num: int, den: int) -> int:
    """Sets that link share a shingle among so many first ones of each."""
    return size - -(-num * size // den) + 1 if size else 0


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), 7) - (1 << 63)


def width_of(size: int, num: int, den: int) -> int:
    """Bits of a set's bitmap: four times the difference that a link to a set of its size allows."""
    most = 2 * size * (den - num) // (den + num)
    return next((w for w in WIDTHS if w >= 4 * most), WIDTHS[-1])


def parity(s: np.ndarray, width: int) -> bytes:
    """Parity of the shingles that fall on each bit."""
    place = ((s >> np.uint64(17)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width // 64), axis=0)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _sets_of(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for at in range(0, batch.num_rows, _CHUNK):
        part = batch.slice(at, _CHUNK)
        yield part, shingle_sets(part.column("jj_text").cast(pa.binary()).to_pylist(), n)


def _classed(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Class, size and the lowest hashes, half as many again as a prefix, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, sets in _sets_of(whole, n):
                low = [s[: -(-3 * prefix_size(len(s), num, den) // 2)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("jj_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(low, pa.binary())], names=["jj_id", "n", "node", "low"])

    return rows.mapInArrow(run, "jj_id long, n long, node long, low binary")


def hot_shingles(classed: DataFrame, most: int = HOT_MOST) -> np.ndarray:
    """Shingles that are frequent among the lowest hashes: at most `most`. Which ones are in it steers cost only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([_longs(u[c > 1]), _longs(c[c > 1].astype(np.int64))], names=["t", "c"])

        for batch in batches:
            for x in batch.column("low").to_pylist():
                held.append(np.frombuffer(x, np.uint64))
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counted = classed.select("low").mapInArrow(count, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).filter(F.col("c") >= HOT_LEAST)
    got = counted.orderBy(F.desc("c"), "t").limit(most).select("t").toArrow().column("t").to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


def _prefixed(rows: DataFrame, hot: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Prefix under the shared order, and bitmap, of every class that a task meets, once a task."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, met = shared.value, set()
        for whole in batches:
            for _, sets in _sets_of(whole, n):
                out = []
                for s in sets:
                    node = class_of(s)
                    if not len(s) or node in met:
                        continue
                    met.add(node)
                    p = prefix_size(len(s), num, den)
                    if len(often):
                        is_hot = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                        first = s[~is_hot][:p]
                        first = np.concatenate((first, s[is_hot][: p - len(first)]))
                    else:
                        first = s[:p]
                    out.append((node, len(s), first.view(np.int64), parity(s, width_of(len(s), num, den))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.binary())], names=["node", "n", "prefix", "bits"])

    return rows.mapInArrow(run, "node long, n long, prefix array<long>, bits binary")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if held and (i > 0 or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over positions, the least node as root."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def group_pairs(n: np.ndarray, place: np.ndarray, block: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Which groups of a cell may hold a link: [i, j], by sizes and by the shared shingle's place in both prefixes.

    Before it, no more can be shared than the smaller number of shingles before it; the same holds behind it. A place of
    -1 is unknown. With blocks only pairs across are looked at.
    """
    may = np.zeros((len(n), len(n)), bool)
    for at in range(0, len(n), 128):
        m, p = n[at : at + 128, None], place[at : at + 128, None]
        least = np.minimum(n, m)
        most = np.where((place < 0) | (p < 0), least, np.minimum(place, p) + np.minimum(n - place, m - p))
        may[at : at + 128] = (most * (den + num) >= num * (n + m)) & (least * den >= num * np.maximum(n, m))
        if block is not None:
            may[at : at + 128] &= block != block[at : at + 128, None]
    return may


def may_link(node: np.ndarray, n: np.ndarray, bits: list[bytes], left: np.ndarray | None, num: int, den: int, group: np.ndarray | None = None, may: np.ndarray | None = None) -> Forest:
    """Joins members of a cell (sorted by node) whose length and bitmap allow a link; left: the block on one side of a
    cell of two blocks, only pairs across are looked at. group and may: each member's group, and the pairs of groups to
    look at."""
    m = len(node)
    order = np.argsort(n, kind="stable")
    sizes = n[order].astype(np.int64)
    held = [np.frombuffer(bits[i], np.uint64) for i in order.tolist()]
    widths = np.array([64 * len(h) for h in held])
    levels = []  # bitmaps of one width of the sets that have it or more, and their rows
    for w in WIDTHS:
        own = np.flatnonzero(widths >= w)
        if len(own) > 1:
            row = np.full(m, -1)
            row[own] = np.arange(len(own))
            levels.append((w, row, np.array([folded(held[k], w) for k in own.tolist()])))
    side = left[order] if left is not None else None
    owner = group[order] if group is not None else None
    forest, at = Forest(m), order.tolist()
    ends = np.searchsorted(sizes, sizes * den // num, side="right")
    for k in range(m - 1):
        near = np.arange(k + 1, int(ends[k]))
        if side is not None:
            near = near[side[near] != side[k]]
        if owner is not None:
            near = near[may[owner[k], owner[near]]]
        for w, row, maps in levels:
            if not len(near) or widths[k] < w:
                break
            wide = widths[near] >= w
            seen = near[wide]
            apart = np.bitwise_count(maps[row[seen]] ^ maps[row[k]]).sum(1).astype(np.int64)
            keep = np.ones(len(near), bool)
            keep[wide] = apart * (den + num) <= (sizes[seen] + sizes[k]) * (den - num)
            near = near[keep]
        for j in near.tolist():
            forest.join(at[k], at[j])
    return forest


def _edges(node: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    root = np.array([forest.root(i) for i in range(len(node))], np.int64)
    own = np.flatnonzero(root != np.arange(len(node)))
    return node[own], node[root[own]]


def _candidates(prefixed: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) whose components hold all links, and the stored groups that they are computed from."""
    member = F.struct("node", "bits")
    groups = prefixed.groupBy("n", "prefix", F.pmod("node", F.lit(GROUP_ROWS)).alias("part")).agg(F.collect_list(member).alias("members"))
    groups = cut(groups.withColumn("gid", F.xxhash64("n", "prefix", "part")), "groups")
    slim = groups.select(F.posexplode("prefix").alias("place", "t"), "gid")
    listed = slim.groupBy("t").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("gid", F.lit(i))).alias(f"h{i}") for i in (1, 2)]).filter("c > 1")
    often = listed.groupBy("c", "h1", "h2").agg(F.min("t").alias("t"))  # of shingles with one and the same posting, one
    blocks = F.ceil(F.col("c") / POSTING_BLOCK).cast("int")
    live = slim.join(often, "t").select("t", "gid", "place", blocks.alias("k"), F.pmod("gid", blocks).cast("int").alias("b"))
    cells = live.select("t", "gid", "place", "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).select("t", "gid", "place", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    alone = groups.filter(F.size("members") > 1).select(F.col("gid").alias("t"), "gid", F.lit(-1).alias("place"), F.lit(0).alias("b"), F.lit(0).alias("x"), F.lit(0).alias("y"))  # members of one row meet in a cell of their own
    full = cells.unionByName(alone).join(groups.select("gid", "n", "members"), "gid")
    dealt = full.repartition("t", "x", "y").sortWithinPartitions("t", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for cell in _by_key(batches, ["t", "x", "y"]):
            two = cell.column("x")[0].as_py() != cell.column("y")[0].as_py()
            may = group_pairs(cell.column("n").to_numpy(), cell.column("place").to_numpy(), cell.column("b").to_numpy() if two else None, num, den)
            alone = cell.column("members").combine_chunks().value_lengths().to_numpy() < 2
            np.fill_diagonal(may, np.diag(may) & ~alone)
            some = np.flatnonzero(may.any(1))
            if not len(some):
                continue
            if len(some) < len(may):
                cell, may = cell.take(pa.array(some)), may[np.ix_(some, some)]
            members = cell.column("members").combine_chunks()
            flat = members.flatten()
            count = members.value_lengths().to_numpy()
            node, group = flat.field("node").to_numpy(), np.repeat(np.arange(len(count)), count)
            n = np.repeat(cell.column("n").to_numpy(), count)
            b = np.repeat(cell.column("b").to_numpy(), count)
            node, keep = np.unique(node, return_index=True)
            bits = flat.field("bits").take(pa.array(keep)).to_pylist()
            a, r = _edges(node, may_link(node, n[keep], bits, b[keep] if two else None, num, den, group[keep], may))
            if len(a):
                u.append(a)
                v.append(r)
            if len(u) > 1000:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(u)), _longs(np.concatenate(v))], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([_longs(np.concatenate([np.zeros(0, np.int64), *u])), _longs(np.concatenate([np.zeros(0, np.int64), *v]))], names=["u", "v"])

    return dealt.select("t", "x", "y", "place", "b", "n", "members").mapInArrow(run, "u long, v long"), groups


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all rows with all columns (positions in sets), by products of incidence blocks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[inverse] > 1
    rank = np.cumsum(df > 1) - 1
    where, owner = rank[inverse[shared]], owner[shared]
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    width = max(256, min(4096, (16 << 20) // (4 * len(sets))))
    for start in range(0, int((df > 1).sum()), width):
        a, b = np.searchsorted(where, (start, start + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], where[a:b] - start] = 1
        out += x[rows] @ x[columns].T
    return out.astype(np.int64)


def sieve_size(classes: int) -> int:
    """Bits of the sieve of wanted documents: sixteen a class, within bounds."""
    return min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (16 * classes).bit_length())) - 9


def _verified(rows: DataFrame, clusters: DataFrame, sizes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, links, root), stored: links to other classes by documents, and the root of the node's verified part, by cell."""
    spark = rows.sparkSession
    chosen = clusters.join(sizes, "node").select("node", "root", "first", "copies")
    size = sieve_size(chosen.count())
    place = (F.pmod(F.coalesce("first", F.lit(-1)), F.lit(size)) + 1).cast("long")
    found = chosen.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # SIEVE_MOST bits at most
    bits = np.zeros((size // 32768 + 2) * 4096, np.uint8)
    for r in found:
        got = np.frombuffer(bytes(r["m"]), np.uint8)
        bits[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(got)] = got
    shared = spark.sparkContext.broadcast(bits)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for whole in batches:
            at = np.mod(whole.column("jj_id").fill_null(-1).to_numpy(), size)
            whole = whole.filter(pa.array((sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for _, sets in _sets_of(whole, n):
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    # The sieve lets one document of each class pass, and few others; those go before sets are compared.
    sets = rows.mapInArrow(wanted, "node long, set binary").join(chosen, "node").dropDuplicates(["node"]).select("root", "node", "copies", "set")
    sets = cut(sets, "sets")
    load = sets.groupBy("root").agg(F.greatest(F.ceil(F.sum(F.octet_length("set")) / CELL_BYTES), F.ceil(F.count("*") / CELL_SETS)).cast("int").alias("k"))
    placed = sets.join(load, "root").withColumn("b", F.pmod("node", F.col("k")).cast("int"))
    cells = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("root", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "node", "copies", "set")
    dealt = cells.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_key(batches, ["root", "x", "y"]):
            node = cell.column("node").to_numpy()
            order = np.argsort(node)
            node, b, copies = node[order], cell.column("b").to_numpy()[order], cell.column("copies").to_numpy()[order]
            raw = cell.column("set").take(pa.array(order)).to_pylist()
            held = [np.frombuffer(s, np.uint64) for s in raw]
            size = np.array([len(s) for s in held], np.int64)
            x, y = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
            r, c = (np.flatnonzero(b == x), np.flatnonzero(b == y)) if x != y else (np.arange(len(node)),) * 2
            if len(r) and len(c) and len(node) > 1:
                common = intersections(held, r, c)
                linked = common * den >= num * (size[r][:, None] + size[c][None, :] - common)
                if x == y:
                    np.fill_diagonal(linked, False)
                links = np.zeros(len(node), np.int64)
                np.add.at(links, r, linked @ copies[c])
                if x != y:
                    np.add.at(links, c, linked.T @ copies[r])
                forest = Forest(len(node))
                for i in range(len(r)):
                    for j in c[np.flatnonzero(linked[i])].tolist():
                        forest.join(int(r[i]), j)
                root = node[[forest.root(i) for i in range(len(node))]]
                yield pa.RecordBatch.from_arrays([_longs(node), _longs(links), _longs(root)], names=["node", "links", "root"])

    verified = cut(dealt.mapInArrow(run, "node long, links long, root long"), "verified")
    release(sets)
    return verified


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each document: `key`, n_shingles, component_id (the least key it reaches by links) and n_links."""
    workers_see_package(docs.sparkSession)
    rows = docs.select(F.col(whole_numbers(docs, key, key)).cast("long").alias("jj_id"), F.col(text).alias("jj_text"))
    classed = cut(_classed(rows, n, num, den), "classes")
    hot = hot_shingles(classed)
    sizes = classed.filter("n > 0").groupBy("node").agg(F.min("jj_id").alias("first"), F.count("*").alias("copies"))
    prefixed = _prefixed(rows, hot, n, num, den).dropDuplicates(["node"])
    edges, groups = _candidates(prefixed, num, den)
    clusters = components(edges, "clusters")
    release(groups)
    verified = _verified(rows, clusters, sizes, n, num, den)
    release(clusters)
    parts = components(verified.filter("links > 0 and root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")), "parts")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = sizes.join(parts, "node", "left").join(links, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("part"), F.coalesce("links", F.lit(0)).alias("links"))
    least = known.groupBy("part").agg(F.min("first").alias("component_id"))
    known = known.join(least, "part").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    all_ids = classed.select("jj_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    done = all_ids.join(known, "node", "left").select(
        F.col("jj_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("jj_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    stored = cut(done, "joined")
    release(classed, verified, parts)
    return stored


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, links from nine tenths on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs, n=3, num=90, den=100)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""
