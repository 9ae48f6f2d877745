"""LaTeX rules, statement extraction, bundles and dependency graphs over LaTeX that is made from driver tables.

A conversation is a record: user turns are lemmas, assistant turns theorems with a proof that refers to the two turns
before and to an unknown label, other turns remarks without a label.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lemmaforge.functions import latex as L
from lemmaforge.operators import bundles, dag, statements

OPTIONS = dag.Options(emit_forward=True)


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _label():
    return F.format_string("c%d:t%d", "conv_id", "turn")


def _wrapped(headed: bool = False):
    """LaTeX of a turn. headed: proofs of every fourth conversation name its first turn in their header."""
    label = F.concat(F.lit("\\label{"), _label(), F.lit("}"))
    ref = lambda k: F.concat(F.lit("c"), F.col("conv_id"), F.lit(":t"), F.col("turn") - k)
    header = F.when(F.lit(headed) & (F.col("conv_id") % 4 == 1), F.concat(F.lit("[of \\ref{c"), "conv_id", F.lit(":t0}]"))).otherwise("")
    proof = F.concat(F.lit("\\begin{proof}"), header, F.lit(" By \\ref{"), ref(1), F.lit("} and \\cref{"), ref(2), F.lit(", zz} done. \\end{proof}\n"))
    return (
        F.when(F.col("role") == "user", F.concat(F.lit("\\begin{lemma}"), label, F.lit(" "), "text", F.lit(" \\end{lemma}\n")))
        .when(F.col("role") == "assistant", F.concat(F.lit("\\begin{theorem}[note n]"), label, F.lit(" % \\label{no}\n"), "text", F.lit(" \\end{theorem}\n"), proof))
        .otherwise(F.concat(F.lit("\\begin{remark} "), "text", F.lit(" \\end{remark}\n")))
    )


def _records(spark, d, headed: bool = False):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", _wrapped(headed).alias("t")))), lambda x: x["t"])
    return _turns(spark, d).groupBy(F.col("conv_id").alias("index")).agg(F.array_join(parts, "").alias("body")).select("index", F.array(F.lit("src/main.tex")).alias("filenames"), F.array("body").alias("latex"))


def _graph(spark, d, options=OPTIONS, headed: bool = False):
    records = _records(spark, d, headed)
    return records, dag.build(records, options)


# --- text rules ---



def _marked(spark, d):
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.concat("n_name", F.lit("%x\n\\%y\\\\%z"))).when(k % 3 == 1, F.concat(F.lit("%"), "n_name", F.lit("\nq"))).otherwise(F.col("n_name"))
    return spark.read.parquet(f"{d}/nation.parquet").select(k.cast("long").alias("k"), text.alias("t"))


def l1_parity_comments(spark, d):
    return _marked(spark, d).select("k", F.md5(L.without_comments(F.col("t"))).alias("digest"))


def l2_escaped_comments(spark, d):
    return _marked(spark, d).select("k", F.md5(L.without_comments(F.col("t"), "escaped")).alias("digest"))


def l3_line_comments(spark, d):
    return _marked(spark, d).select("k", F.md5(L.without_comments(F.replace("t", F.lit("\n"), F.lit("\r\n")), "lines")).alias("digest"))


def l4_forgotten(spark, d):
    t = F.concat(F.lit("a "), "role", F.lit(" \\forget x "), "text", F.when(F.col("turn") % 3 == 1, "").otherwise(" \\forgotten"), F.lit(" b "), "turn", F.lit(" \\forget y \\forgotten c"))
    return _turns(spark, d).select("conv_id", "turn", L.without_forgotten(t).alias("kept"))


def l5_raw_blocks(spark, d):
    t = F.concat(F.lit("\\begin{verbatim}\\begin{lemma} hidden \\end{lemma}\\end{verbatim}\\begin{lemma}"), "text", F.lit("\\end{lemma}"))
    records = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.array(t).alias("latex"))
    return statements.scan(records).select("index", "kind", F.md5("text").alias("digest")).distinct()


def l6_declared_names(spark, d):
    """A declared name decides the kind, whichever file declares it."""
    t = F.concat(F.lit("\\begin{foo}"), "text", F.lit("\\end{foo}\\begin{baz*}q\\end{baz*}"))
    files = F.array(F.lit("\\newtheorem{foo}{Key Lemma}\n\\newtheorem{foo}{Theorem}\n\\newaliascnt{baz}{foo}"), t)
    records = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), files.alias("latex"))
    return statements.numbered(statements.scan(records)).select("index", "place", "kind", F.md5("text").alias("digest"))


def _names(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 8).alias("k"))
    shown = F.element_at(F.array(*[F.lit(x) for x in ("Main Theorem", "Lemma A", "Definition", "Proposition!", "Remarks", "Corollary", "Claim", "Standing Assumption")]), F.col("k").cast("int") + 1)
    env = F.element_at(F.array(*[F.lit(x) for x in ("thm", "Lemma*", "dfn", "propx", "rmk", "corol", "claim", "assumx")]), F.col("k").cast("int") + 1)
    return p.select("p_partkey", shown.alias("shown"), env.alias("env"))


def l7_display_kind(spark, d):
    return _names(spark, d).select("p_partkey", L.display_kind(F.col("shown")).alias("kind"))


def l8_env_kind(spark, d):
    return _names(spark, d).select("p_partkey", L.env_kind(F.col("env")).alias("kind"), L.starred(F.col("env")).alias("starred"))


def l22_newtheorem_kinds(spark, d):
    t = F.concat(F.lit("\\newtheorem{"), F.regexp_replace("env", r"\*", ""), F.lit("}[x]{"), "shown", F.lit("}"))
    return _names(spark, d).select("p_partkey", F.explode(L.newtheorems(t)).alias("x")).select("p_partkey", F.col("x.env").alias("env"), L.graph_display_kind(F.col("x.display")).alias("kind"))


def l23_whitelisted(spark, d):
    t = F.concat(F.lit("\\newtheorem{"), F.regexp_replace("env", r"\*", ""), F.lit("}{"), "shown", F.lit("}"))
    found = _names(spark, d).select("p_partkey", F.explode(L.newtheorems(t)).alias("x"))
    return found.filter(L.letters_of(F.col("x.display")).isin("theorem", "lemma", "proposition", "corollary", "claim")).select("p_partkey", F.col("x.env").alias("env"))


GRAPH_NAMES = (
    ("theorem", "theorem"), ("Lemma*", "lemma"), ("dfn", "definition"), ("propx", "proposition"), ("rmk", "remark"), ("corol", "corollary"), ("claims", "claim"), ("assumx", "assumption"),
    ("remex", "remark"), ("exrem", "remark"), ("defrem", "remark"), ("remdef", "remark"), ("myproof", "proof"), ("proofs", "proof"), ("thmx2", "theorem"), ("Zz", "zz"),
)


def l24_graph_kind(spark, d):
    """Names that hit every rule, among them some that hold two abbreviations."""
    env = F.get(F.array(*[F.lit(n) for n, _ in GRAPH_NAMES]), F.col("p_partkey") % len(GRAPH_NAMES))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", L.graph_env_kind(env).alias("kind"))


def l9_l12_statements(spark, d):
    """Titles, labels and comments are no part of a statement; both scans agree after dedup."""
    found = statements.scan(_records(spark, d))
    return found.select("index", "kind", F.md5("text").alias("digest")).distinct()


def l13_pattern_scan(spark, d):
    t = F.concat(F.lit("\\begin{Lemma*} "), "text", F.lit(" \\end{Lemma*}"))
    records = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.array(t).alias("latex"))
    return statements.numbered(statements.scan(records)).select("index", "place", "kind", F.md5("text").alias("digest"))


def l14_dedup(spark, d):
    """Every turn twice, in two files: each statement once, at its first place."""
    t = F.concat(F.lit("\\begin{lemma}"), "text", F.lit("\\end{lemma}"))
    all_turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))), lambda x: x["t"]), "\n")
    records = _turns(spark, d).groupBy(F.col("conv_id").alias("index")).agg(all_turns.alias("t")).select("index", F.array("t", "t").alias("latex"))
    return statements.numbered(statements.scan(records)).select("index", F.col("place").cast("long").alias("place"), F.md5("text").alias("digest"))


def u2_wide_statements(spark, d):
    records = _records(spark, d)
    w = statements.wide(statements.numbered(statements.scan(records)), records)
    return w.select("index", F.size("lemmas").alias("lemmas"), F.size("theorems").alias("theorems"), F.size("proofs").alias("proofs"), F.size("remarks").alias("remarks"))


def a5_statement_totals(spark, d):
    found = statements.numbered(statements.scan(_records(spark, d)))
    return statements.totals(found).filter("kind <> 'proof'")


def f15_found_field(spark, d):
    """The LaTeX field is found by its content."""
    t = F.concat(F.lit("\\begin{lemma}"), "text", F.lit("\\end{lemma}"))
    line = F.to_json(F.struct(F.lit("note").alias("a"), F.array(t).alias("source"), F.lit("\\documentclass").alias("z")))
    lines = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), line.alias("line"))
    return statements.scan_lines(lines).select("index", "kind", F.md5("text").alias("digest")).distinct()


def l15_stable_dedup(spark, d):
    return _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])), ",").alias("roles"))


def l26_references(spark, d):
    t = F.concat(F.lit("see \\ref{a"), "turn", F.lit(", b} and \\Cref {b,c"), "conv_id", F.lit("} not \\cite{q}"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(L.refs(t), "|").alias("refs"))


def l27_learned_macros(spark, d):
    t = F.concat(F.lit("\\newcommand{\\see}[1]{Lemma~\\ref{#1}}\\begin{lemma}\\label{a}x\\end{lemma}\\begin{theorem}\\label{b}y\\end{theorem}\\begin{proof}[of \\see{b}] by \\see{a} "), "text", F.lit("\\end{proof}"))
    records = _turns(spark, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.array(F.lit("m.tex")).alias("filenames"), F.array(t).alias("latex"))
    return dag.build(records).edges.filter("`from` = 'a'").select("index", "from", "to")


def l30_labels(spark, d):
    t = F.concat(F.lit("\\label{x"), "turn", F.lit("}\\label{ y }\\label{x"), "turn", F.lit("}"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(L.labels(t), "|").alias("labels"), L.first_label(t).alias("first"))


def l31_l32_primary_label(spark, d):
    t = F.concat(F.lit("\\begin{lemma}\\begin{align*}\\label{eq}\\end{align*}\\label{"), _label(), F.lit("} x \\end{lemma}"))
    records = _turns(spark, d).groupBy(F.col("conv_id").alias("index")).agg(F.array_join(F.array_sort(F.collect_list(t)), "\n").alias("t")).select("index", F.array(F.lit("m.tex")).alias("filenames"), F.array("t").alias("latex"))
    return dag.scan(records, OPTIONS).select("index", "label", F.array_join("labels", "|").alias("labels"))


def l28_l34_blocks(spark, d):
    """Inner text of every block, titles and labels taken off."""
    return dag.scan(_records(spark, d), OPTIONS).filter("not proof").select("index", "kind", F.md5("text").alias("digest"))


def l29_proof_blocks(spark, d):
    return dag.scan(_records(spark, d, True), OPTIONS).filter("proof").select("index", F.array_join("header_refs", "|").alias("header"), F.array_join("body_refs", "|").alias("refs"))


def l35_l37_label_forms(spark, d):
    label = F.concat(F.lit("Lem:MainResult-"), "p_partkey", F.lit("_Straße_ΛΟΓΟΣ-ﬁt"))
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", L.folded_label(label).alias("folded"), L.canonical_label(label).alias("canonical"), F.array_join(L.label_tokens(label), "|").alias("tokens"))


def l25_reference_pattern(spark, d):
    """A command beyond the usual ones counts when it is named."""
    t = F.concat(F.lit("\\vref{k"), "turn", F.lit("} \\ref{r}"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(L.refs(t), "|").alias("usual"), F.array_join(L.refs(t, ("vref",)), "|").alias("more"))


# --- bundles ---


def _pieces(spark, d):
    """Two turns are a paper: a root and, where there is a second one, a part, in file order. Roots of every third
    conversation take the part in."""
    t = _turns(spark, d).withColumn("paper", F.expr("conv_id * 4 + turn div 2"))
    root = F.concat(F.lit("\\documentclass{a}\n\\begin{document}\n"), F.when(F.col("conv_id") % 3 == 0, "\\input{part} % \\input{x}\n").otherwise("\\input{gone}\n"), F.lit("\\begin{thm}r\\end{thm}\n\\end{document}"))
    part = F.lit("\\begin{document}P \\input{main}\\end{document}\ntail")
    is_root = F.col("turn") % 2 == 0
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.concat(F.lit("arxiv/p"), F.col("paper") % 160, F.when(is_root, "/main.tex").otherwise("/part.tex")).alias("path"),
        F.when(is_root, root).otherwise(part).alias("text"), (F.length("text") + 10).cast("double").alias("kenlm_perplexity"), F.when(is_root, F.lit(None).cast("double")).otherwise(F.lit(7.0)).alias("kenlm_sp_perplexity"),
    )


def _bundles(spark, d, failing: bool = False):
    """failing: the pieces of every fifth conversation have no document, those of every seventh no theorem."""
    pieces = bundles.with_metadata(bundles.located(_pieces(spark, d)), None)
    if failing:
        conversation = F.expr("index div 100")
        bare = F.regexp_replace("text", r"\\begin\{document\}", "% \\\\begin{document}")
        plain = F.regexp_replace("text", "thm", "abc")
        pieces = pieces.withColumn("text", F.when(conversation % 5 == 1, bare).when(conversation % 7 == 2, plain).otherwise(F.col("text")))
    return bundles.bundled(pieces)


def a1_runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return bundles.runs(e, "event_type", "event_id").groupBy("run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def a2_ordered_files(spark, d):
    return _bundles(spark, d).select("run", "arxiv_id", F.array_join(F.transform("files", lambda f: f["name"]), ",").alias("names"))


def a3_geometric_mean(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy("l_orderkey").agg(F.round(bundles.geometric_mean(F.col("l_quantity"), F.col("l_extendedprice").cast("double")), 4).alias("mean"))


def a4_skip_counts(spark, d):
    return bundles.skip_counts(_bundles(spark, d, True))


def f4_bundle_filter(spark, d):
    return bundles.kept(_bundles(spark, d, True)).select("run", "arxiv_id")


def j1_with_metadata(spark, d):
    """An id may have several metadata lines: the last one in mathematics counts."""
    k = F.col("n_nationkey")
    lines = F.array(F.when(k % 2 == 0, "math.CO").otherwise("cs.LG"), F.when(k % 2 == 0, "hep-th math.AG").otherwise("cs.AI"), F.when(k % 4 == 0, "math.NT").otherwise("cs.CL"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.posexplode(lines).alias("line", "categories"))
    joined = bundles.with_metadata(bundles.located(_pieces(spark, d)), n, line="line")
    return joined.select("index", "arxiv_id", F.get_json_object("metadata", "$.categories").alias("categories"))


def j2_without_metadata(spark, d):
    return bundles.with_metadata(bundles.located(_pieces(spark, d)), None).select("index", "arxiv_id", "metadata")


def l16_l21_merged(spark, d):
    """Roots, files used, unresolved includes, cycles, and the merged perplexity."""
    m = bundles.merge(bundles.kept(_bundles(spark, d)))
    return m.select("run", "root", F.array_join("used", ",").alias("used"), F.array_join("unresolved", ",").alias("unresolved"), F.size("warnings").alias("cycles"), F.round("kenlm_perplexity", 4).alias("ppl"), F.round("kenlm_sp_perplexity", 4).alias("sp_ppl"))


def l17_document_body(spark, d):
    return _pieces(spark, d).select("index", F.md5(L.document_body(F.col("text"))).alias("digest"))


def l20_root_score(spark, d):
    return _pieces(spark, d).select("index", L.root_score(F.col("text")).alias("score"))


# --- graphs ---


def g1_statement_nodes(spark, d):
    return _graph(spark, d)[1].nodes.filter("kind <> 'proof'").select("index", "ordinal", "id", "kind")


def g2_proof_nodes(spark, d):
    return _graph(spark, d)[1].nodes.filter("kind = 'proof'").select("index", "ordinal", "kind")


def g3_edges(spark, d):
    return _graph(spark, d)[1].edges.filter("not `from` like 'proof#%'").select("index", "from", "to")


def g4_older_edges(spark, d):
    return _graph(spark, d, dag.Options(direction="dependent_first"))[1].edges.select("index", "from", "to")


def _forward_records(spark, d):
    """Each conversation's first theorem refers to its last turn, which comes later."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    t = _turns(spark, d).withColumn("last", last)
    tex = F.concat(F.lit("\\begin{lemma}\\label{"), _label(), F.lit("}x\\end{lemma}"), F.when(F.col("turn") == 0, F.concat(F.lit("\\begin{proof} by \\ref{c"), "conv_id", F.lit(":t"), "last", F.lit("}\\end{proof}"))).otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", tex.alias("t")))), lambda x: x["t"]), "\n")
    return t.groupBy(F.col("conv_id").alias("index")).agg(body.alias("b")).select("index", F.array(F.lit("m.tex")).alias("filenames"), F.array("b").alias("latex"))


def g5_forward_policy(spark, d):
    r = _forward_records(spark, d)
    out = dag.build(r, dag.Options(emit_forward=True))
    into = dag.build(r, dag.Options(include_forward=True))
    tag = lambda e, name: e.filter("not `from` like 'proof#%'").select("index", "from", "to", F.lit(name).alias("table"))
    skipped = out.skipped.select("index", F.lit("skipped").alias("from"), F.col("skipped_forward").cast("string").alias("to"), F.lit("count").alias("table"))
    return tag(out.edges, "kept").unionByName(tag(out.forward, "forward")).unionByName(tag(into.edges, "included")).unionByName(skipped)


def g6_statement_edges(spark, d):
    """Statements refer to the turn before, in their text."""
    tex = F.concat(F.lit("\\begin{lemma}\\label{"), _label(), F.lit("}x \\ref{c"), "conv_id", F.lit(":t"), F.col("turn") - 1, F.lit("}\\end{lemma}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", tex.alias("t")))), lambda x: x["t"]), "\n")
    r = _turns(spark, d).groupBy(F.col("conv_id").alias("index")).agg(body.alias("b")).select("index", F.array(F.lit("m.tex")).alias("filenames"), F.array("b").alias("latex"))
    return dag.build(r, dag.Options(statement_refs=True)).edges.select("index", "from", "to")


def _chains(spark, d):
    """Nodes and edges turn i to turn j of a conversation, where i divides into j's predecessors."""
    t = _turns(spark, d)
    nodes = t.select(F.col("conv_id").alias("index"), F.col("turn").cast("string").alias("id"), F.col("role").alias("kind"), F.col("turn").cast("int").alias("ordinal"), "text")
    a = t.select("conv_id", F.col("turn").alias("i"))
    edges = a.join(t.select("conv_id", F.col("turn").alias("j")), "conv_id").filter("i < j and (j - i = 1 or j - i = 3)")
    return nodes, edges.select(F.col("conv_id").alias("index"), F.col("i").cast("string").alias("from"), F.col("j").cast("string").alias("to"), (F.col("i") * 100 + F.col("j")).alias("ord"))


def g7_topological(spark, d):
    """Every fifth conversation has a cycle at its start."""
    nodes, edges = _chains(spark, d)
    back = edges.filter("index % 5 = 1 and ord = 1").select("index", F.col("to").alias("from"), F.col("from").alias("to"), F.lit(9000).cast("long").alias("ord"))
    return dag.topological(nodes, edges.unionByName(back)).select("index", F.array_join("topo_order", ",").alias("topo_order"), "dag_valid")


def g7_levels(spark, d):
    """Every fifth conversation has a cycle of its second and third turn."""
    nodes, edges = _chains(spark, d)
    back = edges.filter("index % 5 = 1 and ord = 102").select("index", F.col("to").alias("from"), F.col("from").alias("to"), F.lit(9000).cast("long").alias("ord"))
    return dag.levels(nodes, edges.unionByName(back))


def g8_edge_texts(spark, d):
    nodes, edges = _chains(spark, d)
    odd = edges.unionByName(edges.filter("ord % 7 = 1").select("index", "from", F.lit("none").alias("to"), (F.col("ord") + 50000).alias("ord")))
    q = dag.edge_texts(nodes, odd)
    return q.select("index", "ord", "from", "to", F.md5("from_text").alias("a"), F.md5("to_text").alias("b"))


def g9_proof_reports(spark, d):
    records, g = _graph(spark, d, headed=True)
    return dag.proof_reports(g, dag.scan(records, OPTIONS)).select("index", "method", F.trim("excerpt").alias("excerpt"))


def j3_edge_ends(spark, d):
    nodes, edges = _chains(spark, d)
    return dag.edge_texts(nodes.filter("ordinal <> 2"), edges).select("index", "from", "to", F.col("from_text").isNull().alias("no_from"), F.col("to_text").isNull().alias("no_to"))


def j4_edge_kinds(spark, d):
    nodes, edges = _chains(spark, d)
    return dag.edge_kinds(nodes.filter("ordinal <> 2"), edges)


def a7_edge_types(spark, d):
    nodes, edges = _chains(spark, d)
    return dag.edge_kinds(nodes, edges)


def a8_unknown_references(spark, d):
    return _graph(spark, d)[1].unknown


def a9_edge_dedup(spark, d):
    _, edges = _chains(spark, d)
    return dag.deduped(edges.unionByName(edges.withColumn("ord", F.col("ord") + 7)))


def a10_adjacency(spark, d):
    return dag.adjacency(*_chains(spark, d)).select("index", "id", F.array_join("next", ",").alias("next"))


def a11_in_degree(spark, d):
    return dag.in_degrees(*_chains(spark, d))


def a6_summary(spark, d):
    records, g = _graph(spark, d)
    return dag.summary(dag.nested(records, g, OPTIONS)).select("records", "error_records", "nodes", "unknown_labels", "unknown_uses", "skipped_forward")


def a22_error_count(spark, d):
    records = _records(spark, d).withColumn("filenames", F.when(F.col("index") % 9 == 4, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("filenames")))
    return dag.scan(records, OPTIONS).groupBy("index").agg(F.bool_or(F.col("error").isNotNull()).alias("bad")).agg(F.count_if("bad").alias("errors"))


def _owners(spark, d):
    """Statements with labels in several forms, and references to them."""
    t = _turns(spark, d).select(F.col("conv_id").alias("index"), F.col("turn").cast("int").alias("idx"))
    s = t.select("index", "idx", F.array(F.concat(F.lit("lem:Main-"), "idx"), F.lit("shared")).alias("labels"))
    return t, s


def _resolved(spark, d, how: str, **options):
    t, s = _owners(spark, d)
    close = F.when(F.col("idx") % 2 == 0, "-shared").otherwise("")  # four of five parts agree, or three of five
    form = {"direct": F.concat(F.lit("lem:Main-"), "idx"), "shared": F.lit("shared"), "canonical": F.concat(F.lit("LEM main "), "idx"), "fuzzy": F.concat(F.lit("lem:Main-"), "idx", close, F.lit("-proof")), "alias": F.concat(F.lit("old"), "idx"), "unknown": F.lit("nothing")}[how]
    return dag.resolve(t.select("index", form.alias("raw")), s, dag.Options(**options))


def j5_direct(spark, d):
    return _resolved(spark, d, "direct").unionByName(_resolved(spark, d, "shared"))


def j6_alias(spark, d):
    return _resolved(spark, d, "alias", label_map={"old0": "lem:Main-0", "old1": "lem:Main-1"}, fuzzy=False)


def j7_canonical(spark, d):
    return _resolved(spark, d, "canonical")


def j8_fuzzy(spark, d):
    return _resolved(spark, d, "fuzzy")


def j9_cascade(spark, d):
    out = [_resolved(spark, d, how).withColumn("how", F.lit(how)) for how in ("direct", "canonical", "fuzzy", "unknown")]
    rows = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return rows.groupBy("how", "method").agg(F.count("*").alias("n"))


def j8_token_overlap(spark, d):
    """Best neighbour of each benchmark item by word sets."""
    from lemmaforge.functions.text import word_tokens

    i = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_distinct(word_tokens(F.col("text"))).alias("w"))
    a, b = i.select(F.col("item_id").alias("q"), F.col("w").alias("qw")), i.select(F.col("item_id").alias("c"), F.col("w").alias("cw"))
    words = a.select("q", F.explode("qw").alias("w")).join(b.select("c", F.explode("cw").alias("w")), "w").filter("q <> c").groupBy("q", "c").agg(F.count("*").alias("n"))
    scored = words.join(a.select("q", F.size("qw").alias("x")), "q").join(b.select("c", F.size("cw").alias("y")), "c").select("q", "c", F.round(F.col("n") / (F.col("x") + F.col("y") - F.col("n")), 6).alias("score"))
    return scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "c")).alias("b")).select("q", F.col("b.c").alias("c"), (-F.col("b.s")).alias("score"))


def u4_token_sets(spark, d):
    a, b = F.split("n_name", ""), F.split(F.lit("AEIOUN"), "")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("any"))


def j10_before(spark, d):
    t = _turns(spark, d).select("conv_id", "turn", (F.col("turn") % 2).alias("file"))
    b = t.select("conv_id", F.col("turn").alias("t2"), F.col("file").alias("f2"))
    return t.join(b, "conv_id").filter(F.struct("file", "turn") < F.struct("f2", "t2")).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def j11_proof_targets(spark, d):
    g = _graph(spark, d, headed=True)[1]
    return g.proofs.join(g.nodes.select("index", F.col("seq").alias("s"), "id", "ordinal"), "index").filter("target + 1 = ordinal and not id like 'proof#%'").select("index", "id", "method")


def w14_event_order(spark, d):
    return dag.scan(_records(spark, d), OPTIONS).select("index", F.col("seq").cast("long").alias("seq"), "kind")


def f19_edge_guard(spark, d):
    nodes, edges = _chains(spark, d)
    holed = edges.withColumn("to", F.when(F.col("ord") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("to")))
    return dag.edge_texts(nodes, holed).select("index", "ord")


def v12_learning_rate(spark, d, steps: int = 1000, warmup: int = 100):
    s = spark.range(steps).select("id")
    rate = F.when(F.col("id") < warmup, F.col("id") / warmup).otherwise(F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.pi() * (F.col("id") - warmup) / (steps - warmup)))))
    return s.select("id", F.round(rate, 6).alias("rate"))


_N = r"m AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey % 3 WHEN 0 THEN n_name || '%x' || chr(10) || '\%y\\%z' WHEN 1 THEN '%' || n_name || chr(10) || 'q' ELSE n_name END AS t, n_name FROM nation)"
_KINDS = "VALUES (0,'theorem','thm','theorem',false,'theorem','thm'),(1,'lemma','Lemma*','lemma',true,'lemma','Lemma'),(2,'definition','dfn','definition',false,'definition','dfn'),(3,'proposition','propx','proposition',false,'proposition','propx'),(4,'remark','rmk','remark',false,'remark','rmk'),(5,'corollary','corol','corollary',false,'corollary','corol'),(6,NULL,'claim','claim',false,'claim','claim'),(7,'assumption','assumx','assumption',false,'assumption','assumx')"
_T = "t AS (SELECT conv_id AS index, turn, role, trim(text) AS text, CASE role WHEN 'user' THEN 'lemma' WHEN 'assistant' THEN 'theorem' ELSE 'remark' END AS kind, 'c' || conv_id || ':t' || turn AS lab FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY turn) AS ordinal, count(*) OVER (PARTITION BY index) AS total FROM t), s AS (SELECT *, CASE kind WHEN 'remark' THEN 'remark#' || ordinal || '@main.tex' ELSE lab END AS id FROM n)"
_HEAD = "h AS (SELECT a.*, a.index % 4 = 1 AND EXISTS (SELECT 1 FROM s b WHERE b.index = a.index AND b.turn = 0 AND b.kind <> 'remark') AS named FROM s a WHERE a.kind = 'theorem')"
_E = "e AS (SELECT a.index, b.id AS dep, a.id AS stmt FROM s a JOIN s b ON a.index = b.index AND a.kind = 'theorem' AND b.kind <> 'remark' AND a.turn - b.turn IN (1, 2))"
_C = "nd AS (SELECT conv_id AS index, turn, role AS kind, text FROM conversations), ed AS (SELECT a.conv_id AS index, a.turn AS i, b.turn AS j, a.turn * 100 + b.turn AS ord FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND b.turn - a.turn IN (1, 3))"
_PP = "t AS (SELECT conv_id, turn % 2 AS turn, conv_id * 100 + turn AS index, 'p' || (conv_id * 4 + turn // 2) % 160 AS arxiv_id, length(text) + 10 AS ppl FROM conversations), r AS (SELECT *, CASE WHEN lag(arxiv_id) OVER (ORDER BY index) IS DISTINCT FROM arxiv_id AND lag(arxiv_id) OVER (ORDER BY index) IS NOT NULL THEN 1 ELSE 0 END AS nw FROM t), u AS (SELECT *, CAST(sum(nw) OVER (ORDER BY index) AS BIGINT) AS run FROM r)"
_FAILING = "b AS (SELECT run, arxiv_id, bool_or(conv_id % 5 <> 1) AS doc, bool_or(turn = 0 AND (conv_id % 5 = 1 OR conv_id % 7 <> 2)) AS thm FROM u GROUP BY ALL)"
_RAW = "SELECT conv_id * 100 + turn AS index, 'lemma' AS kind, md5(trim(text)) AS digest FROM conversations WHERE trim(text) <> ''"

QUERIES = {name: f for name, f in list(globals().items()) if name[0] in "lagjfuvw" and name[1:2].isdigit() and callable(f)}
SQL = {
    "l1_parity_comments": rf"WITH {_N} SELECT k, md5(CASE k % 3 WHEN 0 THEN n_name || chr(10) || '\%y\\' WHEN 1 THEN chr(10) || 'q' ELSE t END) AS digest FROM m",
    "l2_escaped_comments": rf"WITH {_N} SELECT k, md5(CASE k % 3 WHEN 0 THEN n_name || chr(10) || '\%y\\%z' WHEN 1 THEN chr(10) || 'q' ELSE t END) AS digest FROM m",
    "l3_line_comments": rf"WITH {_N} SELECT k, md5(CASE k % 3 WHEN 0 THEN n_name || chr(10) || '\%y\\%z' WHEN 1 THEN chr(10) || 'q' ELSE t END) AS digest FROM m",
    "l4_forgotten": "SELECT conv_id, turn, 'a ' || role || ' ' || CASE WHEN turn % 3 = 1 THEN '' ELSE ' b ' || turn || ' ' END || ' c' AS kept FROM conversations",
    "l5_raw_blocks": _RAW,
    "l6_declared_names": "SELECT conv_id * 100 + turn AS index, p AS place, 'lemma' AS kind, CASE p WHEN 0 THEN md5(trim(text)) ELSE md5('q') END AS digest FROM conversations, (VALUES (0), (1)) x(p)",
    "l7_display_kind": f"SELECT p_partkey, a AS kind FROM part JOIN ({_KINDS}) v(k, a, e, b, st, g, bare) ON p_partkey % 8 = k",
    "l8_env_kind": f"SELECT p_partkey, b AS kind, st AS starred FROM part JOIN ({_KINDS}) v(k, a, e, b, st, g, bare) ON p_partkey % 8 = k",
    "l22_newtheorem_kinds": f"SELECT p_partkey, bare AS env, CASE k WHEN 6 THEN 'claim' ELSE a END AS kind FROM part JOIN ({_KINDS}) v(k, a, e, b, st, g, bare) ON p_partkey % 8 = k",
    "l23_whitelisted": f"SELECT p_partkey, bare AS env FROM part JOIN ({_KINDS}) v(k, a, e, b, st, g, bare) ON p_partkey % 8 = k WHERE k IN (3, 5, 6)",
    "l24_graph_kind": f"SELECT p_partkey, kind FROM part JOIN (VALUES {', '.join(f"({i}, '{k}')" for i, (_, k) in enumerate(GRAPH_NAMES))}) v(k, kind) ON p_partkey % {len(GRAPH_NAMES)} = k",
    "l9_l12_statements": f"WITH {_T} SELECT DISTINCT index, kind, md5(text) AS digest FROM s UNION SELECT index, 'proof', md5('By \\ref{{c' || index || ':t' || (turn - 1) || '}} and \\cref{{c' || index || ':t' || (turn - 2) || ', zz}} done.') FROM s WHERE kind = 'theorem'",
    "l13_pattern_scan": _RAW.replace("SELECT conv_id", "SELECT 0 AS place, conv_id"),
    "l14_dedup": "SELECT conv_id AS index, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS place, md5(x) AS digest FROM (SELECT conv_id, trim(text) AS x, min(turn) AS f FROM conversations GROUP BY ALL)",
    "u2_wide_statements": f"WITH {_T} SELECT index, count(DISTINCT text) FILTER (kind = 'lemma') AS lemmas, count(DISTINCT text) FILTER (kind = 'theorem') AS theorems, count(*) FILTER (kind = 'theorem') AS proofs, count(DISTINCT text) FILTER (kind = 'remark') AS remarks FROM s GROUP BY index",
    "a5_statement_totals": f"WITH {_T}, x AS (SELECT DISTINCT index, kind, text FROM s) SELECT kind, count(*) AS n, count(DISTINCT index) AS records, round(count(*)::DOUBLE / count(DISTINCT index), 6) AS per_record FROM x GROUP BY kind",
    "f15_found_field": _RAW,
    "l15_stable_dedup": "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id",
    "l26_references": "SELECT conv_id, turn, 'a' || turn || '|b|c' || conv_id AS refs FROM conversations",
    "l27_learned_macros": "SELECT conv_id * 100 + turn AS index, 'a' AS \"from\", 'b' AS \"to\" FROM conversations",
    "l30_labels": "SELECT conv_id, turn, 'x' || turn || '|y' AS labels, 'x' || turn AS first FROM conversations",
    "l31_l32_primary_label": "SELECT conv_id AS index, 'c' || conv_id || ':t' || turn AS label, 'eq|c' || conv_id || ':t' || turn AS labels FROM conversations",
    "l28_l34_blocks": f"WITH {_T} SELECT index, kind, md5(text) AS digest FROM s",
    "l29_proof_blocks": f"WITH {_T} SELECT index, CASE WHEN index % 4 = 1 THEN 'c' || index || ':t0' ELSE '' END AS header, 'c' || index || ':t' || (turn - 1) || '|c' || index || ':t' || (turn - 2) || '|zz' AS refs FROM s WHERE kind = 'theorem'",
    "l35_l37_label_forms": "SELECT p_partkey, 'lem:mainresult-' || p_partkey || '_strasse_λογοσ-fit' AS folded, 'lemmainresult' || p_partkey || 'straet' AS canonical, 'lem|main|result|' || p_partkey || '|straße|λογος|ﬁt' AS tokens FROM part",
    "l25_reference_pattern": "SELECT conv_id, turn, 'r' AS usual, 'k' || turn || '|r' AS more FROM conversations",
    "a1_runs": "WITH r AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS nw FROM events), u AS (SELECT *, CAST(sum(nw) OVER (ORDER BY event_id) AS BIGINT) AS run FROM r) SELECT run, event_type, count(*) AS n, min(event_id) AS first FROM u GROUP BY ALL",
    "a2_ordered_files": f"WITH {_PP} SELECT run, arxiv_id, string_agg(CASE turn WHEN 0 THEN 'main.tex' ELSE 'part.tex' END, ',' ORDER BY index) AS names FROM u GROUP BY ALL",
    "a3_geometric_mean": "SELECT l_orderkey, round(exp(sum(greatest(1.0::DOUBLE, l_quantity::DOUBLE) * ln(greatest(l_extendedprice::DOUBLE, 1e-12))) / sum(greatest(1.0::DOUBLE, l_quantity::DOUBLE))), 4) AS mean FROM lineitem GROUP BY l_orderkey",
    "a4_skip_counts": f"WITH {_PP}, {_FAILING} SELECT count(*) FILTER (doc AND thm) AS written, count(*) FILTER (NOT doc) AS no_document, count(*) FILTER (doc AND NOT thm) AS no_theorem FROM b",
    "f4_bundle_filter": f"WITH {_PP}, {_FAILING} SELECT run, arxiv_id FROM b WHERE doc AND thm",
    "j1_with_metadata": f"WITH {_PP} SELECT index, arxiv_id, CASE WHEN CAST(substr(arxiv_id, 2) AS INT) % 4 = 0 THEN 'math.NT' ELSE 'hep-th math.AG' END AS categories FROM t WHERE CAST(substr(arxiv_id, 2) AS INT) < 25 AND CAST(substr(arxiv_id, 2) AS INT) % 2 = 0",
    "j2_without_metadata": f"WITH {_PP} SELECT index, arxiv_id, CAST(NULL AS VARCHAR) AS metadata FROM t",
    "l16_l21_merged": rf"WITH {_PP}, x AS (SELECT run, any_value(conv_id) % 3 = 0 AS inc, max(ppl) FILTER (turn = 0) AS p0, max(ppl) FILTER (turn = 1) AS p1 FROM u GROUP BY run), y AS (SELECT *, length('\documentclass{{a}}|\begin{{document}}||\begin{{thm}}r\end{{thm}}|\end{{document}}') + CASE WHEN inc THEN length('\input{{part}} % \input{{x}}') ELSE length('\input{{gone}}') END AS w0, length('\begin{{document}}P \input{{main}}\end{{document}}|tail') AS w1 FROM x) SELECT run, CASE WHEN inc OR p1 IS NULL THEN 'main.tex' ELSE 'part.tex' END AS root, CASE WHEN p1 IS NULL THEN 'main.tex' WHEN inc THEN 'main.tex,part.tex' ELSE 'part.tex,main.tex' END AS used, CASE WHEN NOT inc THEN 'input:gone' WHEN p1 IS NULL THEN 'input:part' ELSE '' END AS unresolved, CASE WHEN inc AND p1 IS NOT NULL THEN 1 ELSE 0 END AS cycles, round(CASE WHEN p1 IS NULL THEN p0 ELSE exp((w0 * ln(p0::DOUBLE) + w1 * ln(p1::DOUBLE)) / (w0 + w1)) END, 4) AS ppl, CASE WHEN p1 IS NOT NULL THEN 7.0::DOUBLE END AS sp_ppl FROM y",
    "l17_document_body": f"WITH {_PP} SELECT index, md5(CASE turn WHEN 0 THEN chr(10) || CASE WHEN conv_id % 3 = 0 THEN '\\input{{part}} % \\input{{x}}' ELSE '\\input{{gone}}' END || chr(10) || '\\begin{{thm}}r\\end{{thm}}' || chr(10) ELSE 'P \\input{{main}}' END) AS digest FROM t",
    "l20_root_score": f"WITH {_PP} SELECT index, CASE turn WHEN 0 THEN 1250 ELSE 250 END AS score FROM t",
    "g1_statement_nodes": f"WITH {_T} SELECT index, CAST(ordinal AS INT) AS ordinal, id, kind FROM s",
    "g2_proof_nodes": f"WITH {_T} SELECT index, CAST(total + row_number() OVER (PARTITION BY index ORDER BY turn) AS INT) AS ordinal, 'proof' AS kind FROM s WHERE kind = 'theorem'",
    "g3_edges": f"WITH {_T}, {_E} SELECT index, dep AS \"from\", stmt AS \"to\" FROM e",
    "g4_older_edges": f"WITH {_T}, {_E} SELECT index, stmt AS \"from\", dep AS \"to\" FROM e",
    "g5_forward_policy": "WITH x AS (SELECT conv_id AS index, max(turn) AS m FROM conversations GROUP BY 1), y AS (SELECT index, 'c' || index || ':t' || m AS dep, 'c' || index || ':t0' AS stmt FROM x WHERE m > 0) SELECT index, dep AS \"from\", stmt AS \"to\", 'forward' AS \"table\" FROM y UNION ALL SELECT index, dep, stmt, 'included' FROM y UNION ALL SELECT index, 'skipped', '1', 'count' FROM y",
    "g6_statement_edges": "SELECT conv_id AS index, 'c' || conv_id || ':t' || (turn - 1) AS \"from\", 'c' || conv_id || ':t' || turn AS \"to\" FROM conversations WHERE turn > 0",
    "g7_levels": """WITH RECURSIVE e AS (SELECT a.conv_id AS index, a.turn AS f, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (b.turn - a.turn = 1 OR b.turn - a.turn = 3 OR a.conv_id % 5 = 1 AND a.turn = 2 AND b.turn = 1)),
r AS (SELECT index, f AS a, t AS b FROM e UNION SELECT r.index, a, e.t FROM r JOIN e ON e.index = r.index AND e.f = r.b),
bad AS (SELECT DISTINCT r.index, r.b AS id FROM r JOIN (SELECT index, a AS c FROM r WHERE a = b) USING (index) WHERE r.a = c),
p AS (SELECT conv_id AS index, turn AS id, 0 AS d FROM conversations UNION SELECT p.index, e.t, d + 1 FROM p JOIN e ON e.index = p.index AND e.f = p.id LEFT JOIN bad ON bad.index = e.index AND bad.id = e.t WHERE bad.id IS NULL)
SELECT p.index, p.id::VARCHAR AS id, CASE WHEN any_value(bad.id) IS NULL THEN CAST(max(d) AS BIGINT) END AS level FROM p LEFT JOIN bad ON bad.index = p.index AND bad.id = p.id GROUP BY p.index, p.id""",
    "g7_topological": "SELECT conv_id AS index, CASE WHEN conv_id % 5 = 1 AND max(turn) > 0 THEN '' ELSE string_agg(turn::VARCHAR, ',' ORDER BY turn) END AS topo_order, conv_id % 5 <> 1 OR max(turn) = 0 AS dag_valid FROM conversations GROUP BY conv_id",
    "g8_edge_texts": f"WITH {_C} SELECT ed.index, ord, i::VARCHAR AS \"from\", j::VARCHAR AS \"to\", md5(a.text) AS a, md5(b.text) AS b FROM ed JOIN nd a ON a.index = ed.index AND a.turn = i JOIN nd b ON b.index = ed.index AND b.turn = j UNION ALL SELECT ed.index, ord + 50000, i::VARCHAR, 'none', md5(a.text), NULL FROM ed JOIN nd a ON a.index = ed.index AND a.turn = i WHERE ord % 7 = 1",
    "g9_proof_reports": f"WITH {_T}, {_HEAD} SELECT index, CASE WHEN named THEN 'direct' ELSE 'fallback' END AS method, 'By \\ref{{c' || index || ':t' || (turn - 1) || '}} and \\cref{{c' || index || ':t' || (turn - 2) || ', zz}} done.' AS excerpt FROM h",
    "j3_edge_ends": f"WITH {_C} SELECT index, i::VARCHAR AS \"from\", j::VARCHAR AS \"to\", i = 2 AS no_from, j = 2 AS no_to FROM ed",
    "j4_edge_kinds": f"WITH {_C} SELECT CASE WHEN i = 2 THEN '?' ELSE a.kind END AS src, CASE WHEN j = 2 THEN '?' ELSE b.kind END AS dst, count(*) AS n FROM ed JOIN nd a ON a.index = ed.index AND a.turn = i JOIN nd b ON b.index = ed.index AND b.turn = j GROUP BY 1, 2",
    "a7_edge_types": f"WITH {_C} SELECT a.kind AS src, b.kind AS dst, count(*) AS n FROM ed JOIN nd a ON a.index = ed.index AND a.turn = i JOIN nd b ON b.index = ed.index AND b.turn = j GROUP BY 1, 2",
    "a8_unknown_references": f"WITH {_T}, r AS (SELECT a.index, 'c' || a.index || ':t' || (a.turn - k) AS label FROM s a, (VALUES (1), (2)) v(k) WHERE a.kind = 'theorem' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.index = a.index AND b.turn = abs(a.turn - k) AND b.kind <> 'remark')) SELECT index, label, count(*) AS uses FROM r GROUP BY ALL UNION ALL SELECT index, 'zz', count(*) FROM s WHERE kind = 'theorem' GROUP BY index",
    "a9_edge_dedup": f"WITH {_C} SELECT index, i::VARCHAR AS \"from\", j::VARCHAR AS \"to\", ord FROM ed",
    "a10_adjacency": f"WITH {_C} SELECT nd.index, turn::VARCHAR AS id, coalesce(string_agg(j::VARCHAR, ',' ORDER BY ord), '') AS next FROM nd LEFT JOIN ed ON ed.index = nd.index AND i = turn GROUP BY nd.index, turn",
    "a11_in_degree": f"WITH {_C} SELECT nd.index, turn::VARCHAR AS id, count(i) AS in_degree FROM nd LEFT JOIN ed ON ed.index = nd.index AND j = turn GROUP BY nd.index, turn",
    "a6_summary": f"WITH {_T}, r AS (SELECT a.index, 'c' || a.index || ':t' || (a.turn - k) AS label FROM s a, (VALUES (1), (2)) v(k) WHERE a.kind = 'theorem' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.index = a.index AND b.turn = abs(a.turn - k) AND b.kind <> 'remark') UNION ALL SELECT index, 'zz' FROM s WHERE kind = 'theorem') SELECT (SELECT count(DISTINCT index) FROM s) AS records, 0 AS error_records, (SELECT count(*) + count(*) FILTER (kind = 'theorem') FROM s) AS nodes, count(DISTINCT (index, label)) AS unknown_labels, count(*) AS unknown_uses, 0 AS skipped_forward FROM r",
    "a22_error_count": "SELECT count(DISTINCT conv_id) AS errors FROM conversations WHERE conv_id % 9 = 4",
    "j5_direct": "SELECT DISTINCT conv_id AS index, 'lem:Main-' || turn AS raw, CAST(turn AS INT) AS idx, 'direct' AS method FROM conversations UNION ALL SELECT conv_id, 'shared', CAST(min(turn) AS INT), 'direct' FROM conversations GROUP BY conv_id",
    "j6_alias": "SELECT conv_id AS index, 'old' || turn AS raw, CASE WHEN turn < 2 THEN CAST(turn AS INT) END AS idx, CASE WHEN turn < 2 THEN 'direct' ELSE 'unknown' END AS method FROM conversations",
    "j7_canonical": "SELECT conv_id AS index, 'LEM main ' || turn AS raw, CAST(turn AS INT) AS idx, 'canonical' AS method FROM conversations",
    "j8_fuzzy": "SELECT conv_id AS index, 'lem:Main-' || turn || CASE WHEN turn % 2 = 0 THEN '-shared' ELSE '' END || '-proof' AS raw, CASE WHEN turn % 2 = 0 THEN CAST(turn AS INT) END AS idx, CASE WHEN turn % 2 = 0 THEN 'fuzzy' ELSE 'unknown' END AS method FROM conversations",
    "j9_cascade": "SELECT h AS how, m AS method, CASE h WHEN 'unknown' THEN (SELECT count(DISTINCT conv_id) FROM conversations) WHEN 'fuzzy' THEN (SELECT count(*) FROM conversations WHERE (turn % 2 = 0) = (m = 'fuzzy')) ELSE (SELECT count(*) FROM conversations) END AS n FROM (VALUES ('direct', 'direct'), ('canonical', 'canonical'), ('fuzzy', 'fuzzy'), ('fuzzy', 'unknown'), ('unknown', 'unknown')) x(h, m)",
    "j8_token_overlap": "WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM benchmark), s AS (SELECT a.item_id AS q, b.item_id AS c, round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS score FROM w a JOIN w b ON a.item_id <> b.item_id AND len(list_intersect(a.w, b.w)) > 0) SELECT q, c, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rn FROM s) WHERE rn = 1",
    "u4_token_sets": "SELECT CAST(n_nationkey AS BIGINT) AS k, len(list_intersect(string_split(n_name, ''), ['A','E','I','O','U','N'])) AS both, len(list_distinct(list_concat(string_split(n_name, ''), ['A','E','I','O','U','N']))) AS \"any\" FROM nation",
    "j10_before": "SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (a.turn % 2 < b.turn % 2 OR (a.turn % 2 = b.turn % 2 AND a.turn < b.turn)) GROUP BY ALL",
    "j11_proof_targets": f"WITH {_T}, {_HEAD} SELECT index, CASE WHEN named THEN 'c' || index || ':t0' ELSE id END AS id, CASE WHEN named THEN 'direct' ELSE 'fallback' END AS method FROM h",
    "w14_event_order": f"WITH {_T}, x AS (SELECT index, turn, 0 AS o, kind FROM s UNION ALL SELECT index, turn, 1, 'proof' FROM s WHERE kind = 'theorem') SELECT index, row_number() OVER (PARTITION BY index ORDER BY turn, o) - 1 AS seq, kind FROM x",
    "f19_edge_guard": f"WITH {_C} SELECT index, ord FROM ed WHERE ord % 3 <> 0",
    "v12_learning_rate": "SELECT range AS id, round(CASE WHEN range < 100 THEN range / 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE * (1 + cos(pi() * (range - 100) / 900.0::DOUBLE))) END, 6) AS rate FROM range(1000)",
}
