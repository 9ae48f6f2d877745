"""Gapless numbers over a table in the order of columns of any type.

Rows are dealt to ranges by sampled splitters, sorted, and numbered inside their range; each range then starts behind the rows
of the ranges before it. One shuffle, no window over all rows, and one row a range on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut

BITS = 33  # of a row's number inside its partition
SAMPLED = 32  # values for each range


def sampled(rows: DataFrame, column: str, about: int) -> list[int]:
    """A sorted uniform sample of about so many values of a column, or all of fewer; values keep their 64 bits. Nulls are left out."""
    known = rows.select(column).filter(F.col(column).isNotNull())
    share = about / max(1, known.count())
    return sorted(r[0] for r in (known.sample(share, 17) if share < 1 else known).collect())


def range_cuts(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Up to parts - 1 values that cut a whole-number column into ranges of about equal counts."""
    sample = sampled(rows, column, SAMPLED * parts) if parts > 1 else []
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def numbered(rows: DataFrame, order: list[Column], out: str, name: str = "numbered") -> DataFrame:
    """`rows`, stored, with their place from 0 in the given order (nulls first or last as the columns say).

    Rows that are equal in `order` stand in one range; where many may be, its last column should tell them apart. Rows should
    come from a stored table, so that a repeated task deals them alike.
    """
    at = f"{out}_at"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    stored = cut(dealt, name)
    part = F.shiftright(at, BITS)
    counts = sorted((r["p"], r["n"]) for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    before, base = [], 0
    for p, n in counts:
        before.append((p, base))
        base += n
    if len(before) < 2:
        return stored.select(*rows.columns, F.col(at).bitwiseAND(F.lit(2**BITS - 1)).alias(out))
    offsets = rows.sparkSession.createDataFrame(before, f"{at}_p long, {at}_n long")
    joined = stored.withColumn(f"{at}_p", part).join(F.broadcast(offsets), f"{at}_p")
    return joined.select(*rows.columns, (F.col(f"{at}_n") + F.col(at).bitwiseAND(F.lit(2**BITS - 1))).alias(out))


def numbered_within(rows: DataFrame, group: str, order: list[Column], out: str, name: str = "numbered") -> DataFrame:
    """`rows`, stored, with their place from 0 inside their group; a group may be of any size, its value null."""
    first = f"{out}_first"
    every = numbered(rows, [F.col(group), *order], out, name)
    firsts = every.groupBy(F.col(group).alias(f"{first}_g")).agg(F.min(out).alias(first))
    joined = every.join(firsts, every[group].eqNullSafe(firsts[f"{first}_g"]))
    return joined.select(*[c for c in rows.columns], (F.col(out) - F.col(first)).alias(out))
