"""Functions of the corpus engine."""
