"""Deterministic stand-ins for random draws: orders and picks by the MD5 of seed, scope and id.

A pseudo-random sequence has no meaning in a distributed plan; a hash gives every row its draw
wherever it is computed, and any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

SEED = "1234"


def pick_key(scope: str, *ids: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(scope), *[i.cast("string") for i in ids]))


def pick_number(key: Column, n: Column | int) -> Column:
    """0..n-1 from a pick key."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def pick_from(parts: Column, key: Column) -> Column:
    """One element of an array; null for an empty one."""
    return let(parts, lambda p: F.when(F.size(p) > 0, F.get(p, pick_number(key, F.size(p)).cast("int"))))


def first_by_hash(df: DataFrame, scope: str, n: int, *ids: str) -> DataFrame:
    """The first ``n`` rows in hash order, with their ``rank`` from 1; n is bounded, so one task ranks them."""
    from pyspark.sql import Window

    keyed = df.withColumn("pick_key", pick_key(scope, *[F.col(i) for i in ids])).orderBy("pick_key", *ids).limit(n)
    return keyed.withColumn("rank", F.row_number().over(Window.orderBy("pick_key", *ids)).cast("long"))


def split_first(df: DataFrame, scope: str, n: int, ids: list[str], inside: str, outside: str) -> DataFrame:
    """``split`` is ``inside`` for the first ``n`` rows in hash order and ``outside`` for the rest.

    Only the n-th key is looked up, by a bounded top-n; the table itself is neither sorted nor shuffled.
    """
    keyed = df.withColumn("pick_key", F.concat_ws("|", pick_key(scope, *[F.col(i) for i in ids]), *[F.col(i).cast("string") for i in ids]))
    last = keyed.select("pick_key").orderBy("pick_key").limit(n).agg(F.max("pick_key").alias("last_key"))
    joined = keyed.join(F.broadcast(last))  # one row
    return joined.withColumn("split", F.when(F.col("pick_key") <= F.col("last_key"), inside).otherwise(outside)).drop("last_key", "pick_key")
