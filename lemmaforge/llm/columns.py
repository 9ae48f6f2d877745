"""Input columns of any name.

Operators work on columns named by their place, so neither helpers nor outputs can clash with an input's names; the names
come back at the end. An input column with an output's name, in any case, is replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class Plain:
    """`docs` with columns named c0, c1, ...; `outputs` are the columns that an operator appends."""

    def __init__(self, docs: DataFrame, outputs: list[str], needed: list[str]) -> None:
        low = {o.lower() for o in outputs}
        if taken := [c for c in needed if c.lower() in low]:
            raise ValueError(f"{', '.join(taken)} is read and can't be an output")
        kept = [i for i, c in enumerate(docs.columns) if c.lower() not in low]
        self.names, self.outputs = [docs.columns[i] for i in kept], outputs
        every = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))])
        self.docs = every.select(*[every[f"x{i}"].alias(f"c{k}") for k, i in enumerate(kept)])

    def __call__(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, done: DataFrame) -> DataFrame:
        return done.toDF(*self.names, *self.outputs)


def whole_numbers(docs: DataFrame, column: str, named: str) -> str:
    """The column, if it holds whole numbers of up to 64 bits; else a TypeError that names it."""
    kind = dict(docs.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{named} is {kind}; ids have to be whole numbers")
    return column
