"""Corpus analytics on Spark: LaTeX statements, dependency graphs, lexical retrieval and its evaluation."""
