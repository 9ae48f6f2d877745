"""Record layouts of the corpus files."""

from __future__ import annotations

PIECE = "path string, text string, kenlm_perplexity double, kenlm_sp_perplexity double"
CATEGORIES = "id string, categories string"
BUNDLE = "arxiv_id string, metadata string, filenames array<string>, latex array<string>, kenlm_perplexity array<double>, kenlm_sp_perplexity array<double>"
PAPER = "arxiv_id string, title string, lemmas array<string>, theorems array<string>, statements array<struct<text:string,type:string>>"
ITEM = "id string, text string"
SHARD = "id string, embedding array<float>"
DAG = (
    "index bigint, filenames array<string>, nodes array<struct<id:string,env:string,env_raw:string,label:string,file:string,ordinal:int,text:string>>, "
    "edges array<struct<from:string,to:string>>, forward_edges array<struct<from:string,to:string>>, adjacency map<string,array<string>>, topo_order array<string>, "
    "dag_valid boolean, unknown_refs map<string,bigint>, skipped_forward bigint, error string"
)
EDGE_RECORD = "index bigint, nodes array<struct<id:string,text:string,env:string>>, edges array<struct<from:string,to:string>>"
