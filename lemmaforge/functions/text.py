"""Text functions that both the token bags and the label rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def md5_key(*parts: Column | str | int) -> Column:
    """A reproducible shuffle key: MD5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def padded(tokens: Column, length: int, pad: Column) -> Column:
    """Cut or pad to one length."""
    return F.slice(F.concat(tokens, F.array_repeat(pad, length)), 1, length)


def mask(tokens: Column, length: int) -> Column:
    """1 for each kept token, 0 for padding."""
    n = F.least(F.size(tokens), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))
