"""Near-duplicates, repeated lines, decontamination, fingerprints, shards and archives against brute force."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lemmaforge.llm import components, decontaminate, jaccard, shard, syncmers, warc

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=160):
    """Texts with copies, near copies, a passage that many share, and odd ones."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choice(vocabulary) for _ in range(60)).capitalize() + "."
    texts = []
    for i in range(n):
        body = [random.choice(vocabulary) for _ in range(random.choice([0, 1, 2, 4, 12, 80, 200]))]
        if i > 20 and i % 3 == 0:
            body = (texts[random.randrange(len(texts))] or "").split()
            for _ in range(random.choice([0, 1, 2, 9])):
                if body:
                    body[random.randrange(len(body))] = random.choice(vocabulary)
        text = " ".join(body)
        texts.append(text + " " + passage if i % 5 == 0 else text)
    return texts + [None, "", "  ", "A b", "a B", "Die Straße", "die straße"]


def brute_join(texts, n, num, den):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), root(i), links[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "num", "small"), [(3, 90, False), (5, 80, False), (2, 60, True)])
def test_join_against_brute_force(spark, monkeypatch, n, num, small):
    if small:  # many blocks and cells
        monkeypatch.setattr(jaccard, "POSTING_BLOCK", 3)
        monkeypatch.setattr(jaccard, "CELL_SETS", 2)
        monkeypatch.setattr(jaccard, "GROUP_ROWS", 2)
        monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(docs, n=n, num=num).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, n, num, 100)


def test_join_of_repeated_and_null_ids(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(5, long), (5, long), (None, long), (3, "other words here"), (3, long + " y"), (None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()), key=repr)
    assert got == sorted([(5, 38, 3, 3), (5, 38, 3, 3), (None, 38, 3, 3), (3, 1, 3, 0), (3, 39, 3, 3), (None, 0, None, 0)], key=repr)
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_hide_a_link():
    random.seed(8)
    import numpy as np

    for size in (3, 50, 570, 600, 3000, 20000):
        base = np.unique(np.array([random.getrandbits(64) for _ in range(size)], np.uint64))
        other = np.unique(np.concatenate((base[: size - size // 12], np.array([random.getrandbits(64) for _ in range(size // 12)], np.uint64))))
        order = np.array([0, 1])
        forest = jaccard.may_link(order, np.array([len(base), len(other)]), [jaccard.parity(x, jaccard.width_of(len(x), 80, 100)) for x in (base, other)], None, 80, 100)
        linked = 100 * len(np.intersect1d(base, other)) >= 80 * len(np.union1d(base, other))
        assert forest.root(0) == forest.root(1) or not linked


def test_group_pairs_never_hide_a_link():
    random.seed(18)
    import numpy as np

    for num in (60, 80, 90):
        sets = [sorted(random.sample(range(60), random.randrange(1, 40))) for _ in range(60)]
        sets += [sorted({*s[: len(s) - len(s) // 12], 70 + k}) for k, s in enumerate(sets)]
        for t in range(60):
            own = [s for s in sets if t in s[: jaccard.prefix_size(len(s), num, 100)]]
            may = jaccard.group_pairs(np.array([len(s) for s in own]), np.array([s.index(t) for s in own], np.int64), None, num, 100)
            for i, a in enumerate(own):
                for j, b in enumerate(own):
                    both = len({*a} & {*b})
                    assert may[i, j] or 100 * both < num * (len(a) + len(b) - both)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in (100, 101, 102, 200))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_contamination(text, items, n):
    words = [w for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))]
    hit, found = set(), set()
    for item, body in items:
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (body or "").translate(LOW))
        size = min(n, len(own))
        for g in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == g:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_contamination_against_brute_force(spark, limit):
    random.seed(10)
    pick = lambda k: [random.choice(["ab", "Cd", "ef", "GH", "über", "x1", "日本", "i-j"]) for _ in range(k)]
    items = [(i, " ".join(pick(random.choice([0, 1, 3, 5, 9])))) for i in range(12)] + [(90, None), (3, "ab cd")]
    docs = [(i, " ".join(pick(random.choice([0, 2, 10, 40])))) for i in range(60)] + [(100, None), (101, ""), (102, "ab " * 2000), (103, "Cd, EF; gh.")]
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, at string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(frame, bench, n=4, max_broadcast_words=limit).collect():
        assert (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) == brute_contamination(r["text"], items, 4), r["text"]
        assert r["at"] == "z"


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_contamination_of_empty_tables(spark, limit):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), bench, n=4, max_broadcast_words=limit).count() == 0
    for items in (bench.limit(0), bench.withColumn("text", F.lit(None).cast("string"))):
        got = {r["doc_id"]: (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) for r in decontaminate.contamination(docs, items, n=4, max_broadcast_words=limit).collect()}
        assert got == {1: (4, 0, []), 2: (0, 0, [])}


def test_documents_or_spans_go(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say: One, two three FOUR! end"), (2, "one two three"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, n=4).collect()} == {2, 3}
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, n=4, remove="spans").collect()}
    assert spans == {1: "Say: ! end", 2: "one two three", 3: None}



def test_fingerprints(spark):
    random.seed(11)
    texts = [" ".join(random.choice(["a", "bb", "ccc", "dd", "e"]) for _ in range(k)) for k in (0, 1, 3, 9, 10, 40, 400)] + [None, "Same Text here", "same text here", "z" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r["i"]: r for r in frame.select("i", syncmers.sketch(F.col("text")).alias("s"), syncmers.anchors(F.col("text")).alias("a")).collect()}
    assert rows[0]["s"] == rows[7]["s"] == [] and rows[8]["s"] == rows[9]["s"] and rows[1]["s"]
    for r in rows.values():
        assert r["s"] == sorted({a["hash"] for a in r["a"]})[: syncmers.SKETCH]


def test_anchors_do_not_depend_on_context(spark):
    random.seed(12)
    inside = " ".join(f"k{random.randrange(50)}" for _ in range(60))
    frame = spark.createDataFrame([(0, inside), (1, "some words before " + inside + " and after it")], "i int, text string")
    a, b = [r["a"] for r in frame.orderBy("i").select(syncmers.anchors(F.col("text")).alias("a")).collect()]
    moved = {(x["hash"], x["at"] + 3) for x in a}
    assert moved <= {(x["hash"], x["at"]) for x in b} and len(a) > 10
    offsets = frame.agg(F.max_by("text", -F.col("i")).alias("x"), F.max_by("text", "i").alias("y")).select(syncmers.matched_offsets(syncmers.anchors(F.col("x")), syncmers.anchors(F.col("y"))).alias("o")).first()["o"]
    assert offsets[0]["offset"] == 3


def test_edited_texts_and_successors(spark, tmp_path):
    texts = {7: "abcdef", 2: None, 9: "xyz", 4: "日本語テキスト", 11: "", 30: "q" * 999}
    rows = [(i, t) for i, t in texts.items()] + [(9, "xyz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in syncmers.op9_syncmers(spark, str(tmp_path)).collect())
    order = sorted((i, t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(order):
        h, after = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprints_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert syncmers.op9_syncmers(spark, str(tmp_path)).count() == 0


def test_shards_are_level_and_gapless(spark, sf):
    rows = shard.op8_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    load, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(load) - min(load) <= max(len(t.encode()) + 1 for t in docs.values())
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_maps_are_edited_not_recomputed(spark, tmp_path):
    random.seed(13)
    sizes = [random.randrange(1, 500) for _ in range(shard.SLOTS)]
    first = shard.deal(sizes, [1] * shard.SLOTS, 16)
    grown = shard.grow(first)
    moved = [i for i in range(shard.SLOTS) if grown.shard[i] != first.shard[i]]
    assert grown.version == 2 and all(grown.shard[i] == 16 for i in moved)
    assert max(grown.loads()) < 1.05 * sum(sizes) / 17
    sizes[:200] = [5000] * 200
    level = shard.rebalance(grown, sizes, [1] * shard.SLOTS)
    assert max(level.loads()) <= 1.03 * sum(sizes) / 17
    assert sum(a != b for a, b in zip(level.shard, grown.shard, strict=True)) < shard.SLOTS / 4
    for m in (first, grown, level):
        m.save(spark, str(tmp_path / "map"))
    assert shard.SlotMap.load(spark, str(tmp_path / "map")) == level and shard.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_sizes_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "é", 7), (2, "x", 7)], "doc_id long, text string, size int")
    records = shard.sized(rows)
    placed = shard.place(records, shard.deal(*shard.slot_sums(records), 2))
    assert sorted(r["size"] for r in placed.collect()) == [1, 1, 2, 3]
    assert placed.filter("doc_id is null").first()["text_crc32"] == zlib.crc32("é".encode())


@pytest.mark.parametrize("rows", [[(None, "some text")] * 3000, [(None, f"text {i}") for i in range(3000)], [(5, "x" * 90)] * 2000 + [(i, "y" * (i % 7)) for i in range(1000)], [(i, "t") for i in range(3000)]])
def test_shards_by_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = shard.op8_sharding(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    places, load = defaultdict(list), Counter()
    for r in got:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(places) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) < 1.05 * sum(load.values()) / 16 and min(load.values()) > 0.95 * sum(load.values()) / 16


def test_shards_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert shard.op8_sharding(spark, str(tmp_path)).count() == 0


def test_a_stored_map_is_edited_for_new_records(spark, tmp_path):
    texts = {i: "x" * (i % 300) for i in range(4000)}
    for name, ids in (("one", range(3000)), ("two", range(4000))):
        spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
    at = str(tmp_path / "map")
    first = {r["doc_id"]: r for r in shard.op8_sharding(spark, str(tmp_path / "one"), map_path=at).collect()}
    second = {r["doc_id"]: r for r in shard.op8_sharding(spark, str(tmp_path / "two"), map_path=at).collect()}
    assert {r["map_version"] for r in first.values()} == {2} and {r["map_version"] for r in second.values()} == {3}
    assert all(first[i]["virtual_slot"] == second[i]["virtual_slot"] for i in first)
    assert sum(first[i]["shard"] != second[i]["shard"] for i in first) < 0.15 * len(first)
    assert shard.SlotMap.load(spark, at, 1).shard == tuple(i % 16 for i in range(shard.SLOTS))


def pages(spark):
    big, other = "<html>" + "é" * 200, "<p>" + "y" * 150
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (1, "u1", "short"), (3, "u3", "short"), (4, "u\n4", None), (7, "u7", other), (8, "u8", "x" * 300_000), (2, "u2", big), (None, "n", other)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    manifest = warc.write_archives(pages(spark))
    got = warc.read_archives(manifest).collect()
    assert len(got) == 10 == sum(r["records"] for r in manifest.collect())
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got)
    assert [k for k in kinds if k[0] in (5, 9)] == [(5, "revisit", 2), (9, "revisit", 2)]
    assert sorted((k[1], k[2]) for k in kinds if k[0] == 2) == [("response", None), ("revisit", 2)]
    assert all(k[1] == "response" for k in kinds if k[0] in (1, 3, 4, 7, 8)) and (-1, "revisit", 7) in kinds
    for r in got:
        if r["page_id"] == 5:
            body = ("<html>" + "é" * 200).encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())


def test_archives_are_gzip_members(spark):
    for r in warc.write_archives(pages(spark)).collect():
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            raw = f.read()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == r["records"]
        for block in (1, 7, 1 << 16):
            assert len(list(warc.WarcReader(io.BytesIO(raw), block))) == r["records"]


def test_damage_is_noticed():
    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    with pytest.raises(EOFError):
        list(warc.WarcReader(io.BytesIO(record[:-9])))
    text = gzip.decompress(record)
    with pytest.raises(ValueError, match="digest"):
        list(warc.WarcReader(io.BytesIO(gzip.compress(text.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")))))
    with pytest.raises(ValueError, match="long"):
        list(warc.WarcReader(io.BytesIO(gzip.compress(text + b"more"))))
    with pytest.raises(ValueError, match="no record"):
        list(warc.WarcReader(io.BytesIO(gzip.compress(b"junk"))))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def member(head, block, version="WARC/1.0"):
    lines = [version, *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def base32(name, body):
    return f"{name}:" + base64.b32encode(hashlib.new(name.replace("-", ""), body).digest()).decode()


def test_records_that_others_wrote(spark, tmp_path):
    body, http = b"<html>hello</html>", b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<html>hello</html>"
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n6\r\n<html>\r\nc;x=1\r\nhello</html>\r\n0\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    records = [
        member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        member([("WARC-Block-Digest", base32("sha1", http)), kind, ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", base32("sha1", body)), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Type", "response")], http),
        member([("warc-type", "response"), ("content-type", "application/http;msgtype=response"), ("warc-record-id", "<urn:uuid:3>"), ("warc-target-uri", "http://b/")], http),
        member([("WARC-Type", "response"), kind, ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest().upper()), ("WARC-Record-ID", "<urn:page:17>")], chunks),
        member([("WARC-Type", "request"), ("Content-Type", "application/http; msgtype=request"), ("WARC-Record-ID", "<urn:uuid:5>")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member([("WARC-Type", "metadata"), ("X-Long", "one\r\n two"), ("WARC-Payload-Digest", "crc9:77")], b"fetchTimeMs: 3"),
        member([("WARC-Type", "revisit"), kind, ("WARC-Payload-Digest", base32("sha-1", body)), ("WARC-Refers-To", "<urn:uuid:2>")], b"HTTP/1.1 200 OK\r\n\r\n"),
        member([("WARC-Type", "response"), kind, ("WARC-Truncated", "length")], b"HTTP/1.1 200 OK\r\nContent-Length: 900\r\n\r\ncut"),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(records))
    got = warc.read_archives(spark.createDataFrame([(f"file://{path}", len(records))], "archive string, records long")).orderBy("at").collect()
    sha = hashlib.sha256(body).hexdigest()
    assert [r["record_type"] for r in got] == ["warcinfo", "response", "response", "response", "request", "metadata", "revisit", "response"]
    assert [got[i]["payload_digest"] for i in (1, 2)] == [sha, sha] and got[1]["payload_bytes"] == len(body)
    assert (got[3]["page_id"], got[1]["page_id"], got[6]["refers_to"], got[6]["payload_digest"]) == (17, None, None, base32("sha-1", body))
    assert got[7]["payload_bytes"] == 3 and got[5]["record_id"] is None
    for head in ([("WARC-Type", "response"), kind, ("WARC-Payload-Digest", base32("sha1", b"else"))], [("WARC-Type", "metadata"), ("WARC-Block-Digest", base32("md5", b"else"))]):
        with pytest.raises(ValueError, match="digest"):
            [warc.parsed(h, b) for _, h, b in warc.WarcReader(io.BytesIO(member(head, http)))]
