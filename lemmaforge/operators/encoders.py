"""Encoders by name: functions from a table of items to a table of their representations.

Text encoders take (item, text) and return sparse rows (item, term, w) or vectors (item, vec); poolings take (item, states)
or (item, states, mask). Further encoders are added with `register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.functions.vectors import first_vector, last_vector, normalised
from lemmaforge.operators import bags

Encoder = Callable[[DataFrame], DataFrame]
_KNOWN: dict[str, Encoder] = {}


def register(name: str, encoder: Encoder, replace: bool = False) -> Encoder:
    if name in _KNOWN and not replace:
        raise ValueError(f"there is an encoder named {name}")
    _KNOWN[name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    if name not in _KNOWN:
        raise KeyError(f"no encoder named {name}; there are {', '.join(names())}")
    return _KNOWN[name]


def names() -> list[str]:
    return sorted(_KNOWN)


def minhash_vectors(items: DataFrame, count: int = bags.WIDTH) -> DataFrame:
    """(item, vec): signatures scaled to unit length."""
    signed = bags.minhash(bags.bags_by_item(items, "item", "text"), count)
    return signed.select("item", normalised(F.transform("sig", lambda x: x.cast("double"))).alias("vec"))


register("bm25", lambda items: bags.encoder_weights(bags.bag(items, "item", "text")))
register("jaccard", lambda items: bags.binary_weights(bags.bag(items, "item", "text")))
register("bm25_projected", lambda items: bags.projected(bags.encoder_bags(bags.bags_by_item(items, "item", "text"))))
register("jaccard_projected", lambda items: bags.projected(bags.binary_bags(bags.bags_by_item(items, "item", "text"))))
register("minhash", minhash_vectors)
register("first_token", lambda items: items.select("item", first_vector(F.col("states")).alias("vec")))
register("last_token", lambda items: items.select("item", last_vector(F.col("states"), F.col("mask")).alias("vec")))
