"""Dependency graphs of statements and proofs.

A scanner turns each record into events; labels, references, proof targets, edges and statistics are joins, windows
and folds over them. Everything is keyed by record, so a graph never meets another record's rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions import latex
from lemmaforge.functions.scanner import events as scan_record
from lemmaforge.session import cut, release, workers_see_package

EVENT = "index bigint, seq int, proof boolean, file_index int, start int, file string, env_raw string, kind string, text string, label string, labels array<string>, header_refs array<string>, body_refs array<string>, error string"


@dataclass(frozen=True)
class Options:
    """envs: further environments. direction: edges run from the dependency ("dependency_first", with proof nodes) or from
    the dependent statement ("dependent_first", without them; labels are then first labels and every kind can be proved)."""

    envs: tuple[str, ...] = latex.GRAPH_NAMES
    extra_refs: tuple[str, ...] = ()
    label_map: dict[str, str] = field(default_factory=dict)
    lowercase: bool = False
    fuzzy: bool = True
    threshold: float = 0.66
    include_forward: bool = False
    emit_forward: bool = False
    statement_refs: bool = False
    direction: str = "dependency_first"

    @property
    def older(self) -> bool:
        return self.direction == "dependent_first"


@dataclass
class Graph:
    """Tables of a build: nodes, edges and forward edges with their first place, unknown references with counts, skipped
    forward references by record, failed records, and proofs with target and method."""

    nodes: DataFrame
    edges: DataFrame
    forward: DataFrame
    unknown: DataFrame
    skipped: DataFrame
    errors: DataFrame
    proofs: DataFrame


def scan(records: DataFrame, options: Options) -> DataFrame:
    """Events of records (index, filenames, latex). A record whose arrays differ in length, or whose scan fails, is one
    row with an error."""
    workers_see_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("index", pa.int64()), ("seq", pa.int32()), ("proof", pa.bool_()), ("file_index", pa.int32()), ("start", pa.int32()), *[(n, pa.string()) for n in ("file", "env_raw", "kind", "text", "label")], *[(n, pa.list_(pa.string())) for n in ("labels", "header_refs", "body_refs")], ("error", pa.string())])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = []
                for r in whole.slice(at, 64).to_pylist():
                    try:
                        names, texts = r["filenames"] or [], r["latex"] or []
                        if len(names) != len(texts):
                            raise ValueError("filenames and latex differ in length")
                        found = scan_record(list(zip(names, texts, strict=True)), options.envs, options.extra_refs, not options.older, options.older)
                        rows += [{"index": r["index"], "seq": i} | asdict(e) for i, e in enumerate(found)]
                    except Exception as e:  # noqa: BLE001  a bad record does not stop the others
                        rows.append({"index": r["index"], "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return records.select("index", "filenames", "latex").mapInArrow(run, EVENT)


def _base(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def statement_nodes(found: DataFrame) -> DataFrame:
    """Statements with idx (from 0), ordinal and id: the primary label, or one made of name, ordinal and file."""
    w = Window.partitionBy("index").orderBy("seq")
    own = found.filter(~F.col("proof")).withColumn("ordinal", F.row_number().over(w))
    return own.withColumn("idx", F.col("ordinal") - 1).withColumn("id", F.coalesce("label", F.format_string("%s#%d@%s", "env_raw", "ordinal", _base(F.col("file")))))


def proof_nodes(found: DataFrame, statements: DataFrame) -> DataFrame:
    """Proofs numbered after the record's statements."""
    w = Window.partitionBy("index").orderBy("seq")
    counts = statements.groupBy("index").agg(F.count("*").alias("n"))
    own = found.filter("proof").withColumn("nth", F.row_number().over(w)).join(counts, "index", "left")
    own = own.withColumn("ordinal", (F.col("nth") + F.coalesce("n", F.lit(0))).cast("int")).drop("n", "nth")
    return own.withColumn("id", F.format_string("proof#%d@%s:%d", "ordinal", _base(F.col("file")), "start"))


def label_index(statements: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, norm, idx) of every label's first owner, (index, canonical, idx) where only one statement has the form,
    and (index, idx, tokens) of every labelled statement. Aliases of existing labels are entered in all three."""
    owned = statements.select("index", "idx", F.posexplode("labels").alias("nth", "raw")).withColumn("norm", latex.folded_label(F.col("raw"), options.lowercase))
    direct = owned.groupBy("index", "norm").agg(F.min("idx").alias("idx"))
    spoken = owned.select("index", "norm", "idx")
    if options.label_map:
        pairs = statements.sparkSession.createDataFrame(list(options.label_map.items()), "alias string, target string")  # options, held by the driver
        pairs = pairs.select(*[latex.folded_label(F.col(c), options.lowercase).alias(c) for c in ("alias", "target")]).distinct()
        added = direct.join(F.broadcast(pairs), direct["norm"] == pairs["target"]).select("index", F.col("alias").alias("norm"), "idx").join(direct.select("index", "norm"), ["index", "norm"], "left_anti")
        direct, spoken = direct.unionByName(added), spoken.unionByName(added)
    forms = spoken.select("index", latex.canonical_label(F.col("norm")).alias("canonical"), "idx").distinct()
    unique = forms.groupBy("index", "canonical").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).filter("n = 1").drop("n")
    tokens = spoken.groupBy("index", "idx").agg(F.array_distinct(F.flatten(F.collect_list(latex.label_tokens(F.col("norm"))))).alias("tokens"))
    return direct, unique, tokens


def best_overlaps(refs: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """(index, raw, idx): the statement whose label tokens overlap most with a reference's, the first of equals."""
    met = refs.withColumn("own", latex.label_tokens(F.col("norm"))).join(tokens.filter(F.size("tokens") > 0), "index")
    score = F.size(F.array_intersect("own", "tokens")) / F.size(F.array_union("own", "tokens"))
    best = met.select("index", "raw", "idx", score.alias("score")).groupBy("index", "raw").agg(F.min(F.struct((-F.col("score")).alias("s"), "idx")).alias("b"))
    return best.filter((-F.col("b.s") >= threshold) & (F.col("b.s") < 0)).select("index", "raw", F.col("b.idx").alias("idx"))


def resolve(refs: DataFrame, statements: DataFrame, options: Options) -> DataFrame:
    """(index, raw, idx, method) of distinct references: direct, canonical, fuzzy or unknown, whichever comes first."""
    direct, unique, tokens = label_index(statements, options)
    raw = refs.select("index", "raw").distinct()
    mapped = F.col("raw")
    if options.label_map:
        m = F.create_map(*[F.lit(x) for kv in options.label_map.items() for x in kv])
        mapped = F.coalesce(F.element_at(m, mapped), mapped)
    keyed = raw.withColumn("norm", latex.folded_label(mapped, options.lowercase))
    first = keyed.join(direct, ["index", "norm"], "left")
    known = first.filter("idx is not null").select("index", "raw", "idx", F.lit("direct").alias("method"))
    rest = first.filter("idx is null").drop("idx")
    if not options.fuzzy:
        return known.unionByName(rest.select("index", "raw", F.lit(None).cast("int").alias("idx"), F.lit("unknown").alias("method")))
    second = rest.withColumn("canonical", latex.canonical_label(F.col("norm"))).join(unique, ["index", "canonical"], "left")
    like = best_overlaps(second.filter("idx is null").select("index", "raw", "norm"), tokens, options.threshold).withColumnRenamed("idx", "fuzzy_idx")
    third = second.join(like, ["index", "raw"], "left")
    method = F.when(F.col("idx").isNotNull(), "canonical").when(F.col("fuzzy_idx").isNotNull(), "fuzzy").otherwise("unknown")
    return known.unionByName(third.select("index", "raw", F.coalesce("idx", "fuzzy_idx").alias("idx"), method.alias("method")))


def proof_targets(found: DataFrame, statements: DataFrame, header: DataFrame, options: Options) -> DataFrame:
    """(index, seq, target, method): the first resolved reference in the proof's header, or else the latest statement
    before the proof that no proof has taken.

    The fallback is a fold over a record's events: a statement is put on a stack, a proof takes the top one off; a proof
    with a header takes its target out of the stack, or keeps it from being put there.
    """
    named = header.filter("idx is not null").groupBy("index", "seq").agg(F.min_by(F.struct("idx", "method"), "nth").alias("h"))
    own = statements.select("index", "seq", "idx", (F.lit(options.older) | F.col("kind").isin(*latex.PROOF_TARGETS)).alias("open"))
    steps = found.filter("error is null").select("index", "seq", "proof").join(own, ["index", "seq"], "left").join(named, ["index", "seq"], "left")
    line = steps.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("seq", "proof", "idx", "open", F.col("h.idx").alias("named"), F.col("h.method").alias("how")))).alias("steps"))
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(none.alias("stack"), none.alias("taken"), F.expr("cast(array() as array<struct<seq:int,target:int,method:string>>)").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        top = F.array_max(acc["stack"])
        target = F.coalesce(e["named"], top)
        method = F.when(e["named"].isNotNull(), e["how"]).when(top.isNotNull(), F.lit("fallback"))
        below = F.when(target.isNotNull(), F.array_remove(acc["stack"], target)).otherwise(acc["stack"])
        ahead = e["named"].isNotNull() & ~F.array_contains(acc["stack"], e["named"])
        taken = F.when(ahead, F.array_append(acc["taken"], e["named"])).otherwise(acc["taken"])
        result = F.array_append(acc["out"], F.struct(e["seq"].alias("seq"), target.alias("target"), method.alias("method")))
        open_ = F.coalesce(e["open"], F.lit(False)) & ~F.array_contains(acc["taken"], e["idx"])
        pushed = F.when(open_, F.array_append(acc["stack"], e["idx"])).otherwise(acc["stack"])
        return F.when(e["proof"], F.struct(below.alias("stack"), taken.alias("taken"), result.alias("out"))).otherwise(F.struct(pushed.alias("stack"), acc["taken"].alias("taken"), acc["out"].alias("out")))

    return line.select("index", F.inline(F.aggregate("steps", start, step, lambda a: a["out"])))


def build(records: DataFrame, options: Options = Options()) -> Graph:  # noqa: B008  frozen
    """Graphs of all records (index, filenames, latex)."""
    found = cut(scan(records, options), "events")
    errors = found.filter("error is not null").select("index", "error")
    good = found.filter("error is null")
    statements = cut(statement_nodes(good), "statements")
    proofs = proof_nodes(good, statements)
    listed = lambda c, where: good.filter(where).select("index", "seq", F.posexplode(c).alias("nth", "raw"))
    head, body, said = listed("header_refs", "proof"), listed("body_refs", "proof"), listed("body_refs", "not proof")
    used = head.unionByName(body).unionByName(said) if options.statement_refs else head.unionByName(body)
    known = cut(resolve(used, statements, options), "references")
    header = head.join(known, ["index", "raw"])
    targets = cut(proof_targets(good, statements, header, options), "targets")
    place = good.filter("proof").select("index", "seq", "file_index", "start")
    owner = statements.select("index", F.col("idx").alias("target"), F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    attached = targets.filter("target is not null").drop("method").join(place, ["index", "seq"]).join(owner, ["index", "target"])
    dep = statements.select("index", "idx", F.col("id").alias("dep_id"), F.col("label").alias("dep_label"), F.col("file_index").alias("dep_file"), F.col("start").alias("dep_start"))
    step = lambda rows, part: rows.join(known, ["index", "raw"]).join(attached, ["index", "seq"]).withColumn("part", F.lit(part))
    cited = step(head, 1).unionByName(step(body, 2))
    unknown_uses = cited.filter("idx is null").select("index", "raw").unionByName(head.join(known, ["index", "raw"]).filter("idx is null").join(targets.filter("target is null").select("index", "seq"), ["index", "seq"]).select("index", "raw"))
    linked = cited.filter("idx is not null").join(dep, ["index", "idx"])
    same_label = F.coalesce(latex.folded_label(F.col("target_label"), options.lowercase) == latex.folded_label(F.col("dep_label"), options.lowercase), F.lit(False))
    itself = F.when(F.col("part") == 2, same_label).otherwise(F.col("idx") == F.col("target")) if options.older else F.col("idx") == F.col("target")
    once = Window.partitionBy("index", "seq", "part", "dep_id").orderBy("nth")
    linked = linked.withColumn("again", F.row_number().over(once))
    linked = linked.filter(~itself & ((F.col("part") == 1) | (F.col("again") == 1)))
    earlier = F.struct("dep_file", "dep_start") < F.struct("file_index", "start")
    rows = linked.select("index", F.struct("seq", "part", "nth").alias("ord"), F.col("dep_id").alias("dep"), F.col("target_id").alias("stmt"), earlier.alias("earlier"), F.lit(True).alias("from_proof"))
    if options.statement_refs:
        own = said.join(known, ["index", "raw"]).join(statements.select("index", "seq", F.col("idx").alias("target"), F.col("id").alias("target_id"), "file_index", "start"), ["index", "seq"])
        unknown_uses = unknown_uses.unionByName(own.filter("idx is null").select("index", "raw"))
        own = own.filter("idx is not null and idx <> target").join(dep, ["index", "idx"])
        late = F.struct((F.col("seq") + 1_000_000_000).alias("seq"), F.lit(3).alias("part"), F.col("nth"))  # after all proofs
        rows = rows.unionByName(own.select("index", late.alias("ord"), F.col("dep_id").alias("dep"), F.col("target_id").alias("stmt"), earlier.alias("earlier"), F.lit(False).alias("from_proof")))
    ends = ("stmt", "dep") if options.older else ("dep", "stmt")
    edge = rows.select("index", "ord", F.col(ends[0]).alias("from"), F.col(ends[1]).alias("to"), "earlier", "from_proof")
    kept = edge.filter(F.col("earlier") | F.lit(options.include_forward)).select("index", "ord", "from", "to")
    if not options.older:
        proved = attached.join(proofs.select("index", "seq", F.col("id").alias("proof_id")), ["index", "seq"]).select("index", F.struct("seq", F.lit(0).alias("part"), F.lit(0).alias("nth")).alias("ord"), F.col("proof_id").alias("from"), F.col("target_id").alias("to"))
        kept = kept.unionByName(proved)
    forward = edge.filter(~F.col("earlier") & F.lit(options.emit_forward) & (F.col("from_proof") | F.lit(not options.include_forward)))
    skipped = edge.filter(~F.col("earlier") & F.lit(not options.include_forward)).groupBy("index").agg(F.count("*").alias("skipped_forward"))
    columns = ["index", "seq", "id", "kind", "env_raw", "label", "file", "ordinal", "text", "file_index", "start"]
    nodes = statements.select(*columns) if options.older else statements.select(*columns).unionByName(proofs.select(*columns))
    return Graph(nodes, deduped(kept), deduped(forward), unknown_uses.groupBy("index", F.col("raw").alias("label")).agg(F.count("*").alias("uses")), skipped, errors, targets.join(place, ["index", "seq"]))


def deduped(edges: DataFrame) -> DataFrame:
    """Each edge once, with its first place in the record as ord."""
    return edges.groupBy("index", "from", "to").agg(F.min("ord").alias("ord"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, id, next): successors in order of edge; nodes without any have an empty array."""
    out = edges.groupBy("index", F.col("from").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "to"))), lambda x: x["to"]).alias("next"))
    return nodes.select("index", "id").distinct().join(out, ["index", "id"], "left").select("index", "id", F.coalesce("next", F.expr("cast(array() as array<string>)")).alias("next"))


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    got = edges.groupBy("index", F.col("to").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("index", "id").distinct().join(got, ["index", "id"], "left").select("index", "id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, topo_order, dag_valid, duplicate_ids): nodes without open predecessors in order, first come first out. Equal
    ids are one node, and counted."""
    workers_see_package(nodes.sparkSession)
    n = nodes.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("ids"))
    e = edges.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "from", "to"))), lambda x: F.array(x["from"], x["to"])).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = list(dict.fromkeys(r["ids"]))
                after, open_ = {i: [] for i in ids}, dict.fromkeys(ids, 0)
                for u, v in r["pairs"] or []:
                    after.setdefault(u, []).append(v)
                    open_[v] = open_.get(v, 0) + 1
                ready, order = deque(i for i in ids if not open_[i]), []
                while ready:
                    order.append(ready.popleft())
                    for v in after.get(order[-1], []):
                        open_[v] -= 1
                        if not open_[v]:
                            ready.append(v)
                rows.append({"index": r["index"], "topo_order": order, "dag_valid": len(order) == len(ids), "duplicate_ids": len(r["ids"]) - len(ids)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("index", pa.int64()), ("topo_order", pa.list_(pa.string())), ("dag_valid", pa.bool_()), ("duplicate_ids", pa.int32())]))

    return n.join(e, "index", "left").select("index", "ids", "pairs").mapInArrow(run, "index bigint, topo_order array<string>, dag_valid boolean, duplicate_ids int")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, id, level) of every node: the most edges on a path that ends there, null for nodes on or behind a cycle, which never
    come free. Equal ids are one node; edges with an end that no node has are left out.

    No record is gathered. Nodes with one predecessor are contracted first, by doubling pointers, so that a chain takes as many
    steps as its length has digits in base 2; of the rest, those whose predecessors are known are peeled off, a round a depth.
    """
    at = ["index", "id"]
    known = cut(nodes.select(*at).distinct(), "levels-nodes")
    pairs = edges.select("index", "from", "to").distinct()
    pairs = pairs.join(known.select("index", F.col("id").alias("from")), ["index", "from"]).join(known.select("index", F.col("id").alias("to")), ["index", "to"])
    pairs = cut(pairs, "levels-edges")
    into = pairs.groupBy("index", F.col("to").alias("id")).agg(F.count("*").alias("n"), F.min("from").alias("parent"))
    single = F.col("n") == 1
    jumps = known.join(into, at, "left").select(*at, F.when(single, F.col("parent")).otherwise(F.col("id")).alias("head"), F.when(single, 1).otherwise(0).cast("long").alias("far"), F.coalesce(~single, F.lit(True)).alias("done"), F.col("n").isNull().alias("free"))
    jumps, open_ = cut(jumps, "levels-jumps"), -1
    while (left := jumps.filter("not done").count()) and left != open_:  # nodes behind cycles stay open
        open_ = left
        ahead = jumps.select("index", F.col("id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"), F.col("done").alias("ends"))
        moved = jumps.filter("not done").join(ahead, ["index", "head"])
        step = moved.select(*at, F.col("next").alias("head"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"), F.lit(False).alias("free"))
        new = cut(jumps.filter("done").unionByName(step), "levels-jumps")
        release(jumps)
        jumps = new
    heads = jumps.select("index", F.col("id").alias("from"), "head", "far", "done")
    meets = into.filter("n > 1").select(*at)
    arcs = pairs.join(meets.withColumnRenamed("id", "to"), ["index", "to"]).join(heads, ["index", "from"]).select("index", F.col("to").alias("id"), F.when(F.col("done"), F.col("head")).alias("head"), (F.col("far") + 1).alias("far"))
    arcs = cut(arcs, "levels-arcs")
    found = cut(jumps.filter("free").select(*at, F.lit(0).cast("long").alias("level")), "levels-found")
    rest, rounds = arcs, 0
    while True:
        by = found.select("index", F.col("id").alias("head"), "level")
        ready = rest.join(by, ["index", "head"], "left").groupBy(*at).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count("level").alias("have"), F.count("*").alias("all")).filter("have = all").select(*at, "level")
        new = cut(ready, "levels-round")
        if not new.limit(1).count():
            break
        found, rounds = found.unionByName(new), rounds + 1
        if rounds % 16 == 0:
            found = cut(found, "levels-found")
        rest = cut(rest.join(new.select(*at), at, "left_anti"), "levels-arcs")
    top = found.select("index", F.col("id").alias("head"), F.col("level").alias("base"))
    return jumps.join(top, ["index", "head"], "left").select(*at, F.when(F.col("done"), F.col("base") + F.col("far")).alias("level"))


def nested(records: DataFrame, graph: Graph, options: Options = Options()) -> DataFrame:  # noqa: B008
    """One row for each record in the file layout; failed records have an error and nothing else."""
    node = F.struct("ordinal", F.struct("id", F.col("kind").alias("env"), "env_raw", "label", "file", "ordinal", "text").alias("n"))
    nodes = graph.nodes.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"]).alias("nodes"))
    pairs = lambda e, name: e.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("from", "to").alias("e")))), lambda x: x["e"]).alias(name))
    maps = adjacency(graph.nodes, graph.edges).groupBy("index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "next")))).alias("adjacency"))
    unknown = graph.unknown.groupBy("index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "uses")))).alias("unknown_refs"))
    out = records.select("index", "filenames").join(nodes, "index", "left").join(pairs(graph.edges, "edges"), "index", "left")
    if options.emit_forward:
        out = out.join(pairs(graph.forward, "forward_edges"), "index", "left")
    return out.join(maps, "index", "left").join(topological(graph.nodes, graph.edges).drop("duplicate_ids"), "index", "left").join(unknown, "index", "left").join(graph.skipped, "index", "left").join(graph.errors, "index", "left")


def edge_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, ord, from, from_text, to, to_text): an end that no node has gets no text; of equal ids the last one's counts.
    Edges without both ends are left out."""
    last = nodes.groupBy("index", "id").agg(F.max_by("text", "ordinal").alias("text"))
    left, right = last.select("index", F.col("id").alias("from"), F.col("text").alias("from_text")), last.select("index", F.col("id").alias("to"), F.col("text").alias("to_text"))
    return edges.filter(F.col("from").isNotNull() & F.col("to").isNotNull()).join(left, ["index", "from"], "left").join(right, ["index", "to"], "left")


def edge_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, n) by decreasing n: kinds of both ends, ? for an end that no node has."""
    last = nodes.groupBy("index", "id").agg(F.max_by("kind", "ordinal").alias("kind"))
    typed = edges.join(last.select("index", F.col("id").alias("from"), F.col("kind").alias("src")), ["index", "from"], "left").join(last.select("index", F.col("id").alias("to"), F.col("kind").alias("dst")), ["index", "to"], "left")
    return typed.groupBy(F.coalesce("src", F.lit("?")).alias("src"), F.coalesce("dst", F.lit("?")).alias("dst")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst")


def summary(dags: DataFrame) -> DataFrame:
    """One row of totals over records in the file layout."""
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0)))
    uses = F.aggregate(F.coalesce(F.map_values("unknown_refs"), F.expr("cast(array() as array<bigint>)")), F.lit(0).cast("long"), lambda s, x: s + x)
    forward = n("forward_edges") if "forward_edges" in dags.columns else F.sum(F.lit(0))
    good = F.col("error").isNull()
    return dags.agg(
        F.count_if(good).alias("records"), F.count_if(~good).alias("error_records"), n("nodes").alias("nodes"), n("edges").alias("edges"), forward.alias("forward_edges"),
        n("unknown_refs").alias("unknown_labels"), F.sum(uses).alias("unknown_uses"), F.coalesce(F.sum("skipped_forward"), F.lit(0)).alias("skipped_forward"),
    )


def proof_reports(graph: Graph, records_events: DataFrame) -> DataFrame:
    """(index, seq, target, method, excerpt) of every proof, for diagnosis."""
    return graph.proofs.join(records_events.select("index", "seq", F.concat(F.substring("text", 1, 200), F.when(F.length("text") > 200, "...").otherwise("")).alias("excerpt")), ["index", "seq"])
