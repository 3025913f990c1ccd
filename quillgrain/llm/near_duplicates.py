"""Groups of records that share most of their text, found by an exact similarity self-join.

Set relations save work twice. In the lists, sizes and positions skip whole stretches (see
``setjoin``). Among the answers, a set derives its overlaps from those of a highly similar set that
is already answered: with leader L and set A, |A & X| = |L & X| - |(L - A) & X| + |(A - L) & X|, and
the two differences are small where L and A are near-duplicates. Equal texts are one set from the
start: the copies share its answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.session import write_shared

from . import setjoin
from .common import normalise

#: Pairs of a leader that are one task's work; a hot group of near-duplicates has many parts.
PAIRS = 20_000


def text_classes(df: DataFrame, key: str, text: str, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(members: key, id), (classes: id, side, n, terms): records with equal normalised text share a class."""
    flat = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("body")).where("k is not null and body is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            norm = [normalise(x) for x in b["body"]]
            out = pd.DataFrame({"k": b["k"].to_numpy(), "norm": norm})
            yield out[[len(x.encode("utf-8", "surrogatepass")) >= min_bytes for x in norm]]

    prepared = write_shared(flat.mapInPandas(run, "k string, norm string").withColumn("fp", F.sha2("norm", 256)))
    # map-side aggregation: copies of a text meet as one row for each task
    classes = write_shared(prepared.groupBy("fp").agg(F.min("norm").alias("norm")).withColumn("id", F.monotonically_increasing_id()))
    members = prepared.select("k", "fp").join(classes.select("fp", "id"), "fp").select(F.col("k").alias(key), "id")
    sets = setjoin.with_terms(classes.select("id", F.lit(-1).alias("side"), "norm", F.lit(None).cast("string").alias("scope")))
    return members, write_shared(sets)


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b), similarity of all classes at or over the threshold."""
    posted = setjoin.postings(classes, setjoin.term_counts(classes), threshold)
    pairs = write_shared(setjoin.self_candidates(posted, threshold))
    leaders = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("lead"))
    led = pairs.join(leaders, "a", "left").withColumn("lead", F.coalesce("lead", "a"))
    parts = led.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(PAIRS)).alias("parts"))
    led = write_shared(led.join(parts, "lead").select("lead", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "a", "b"))
    # a part fetches each set it needs once, whatever the number of pairs the set is in
    needed = led.select("lead", "part", F.col("a").alias("id")).unionByName(led.select("lead", "part", F.col("b").alias("id"))).distinct()
    sets = needed.join(classes.select("id", "terms"), "id").select("lead", "part", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "terms")
    rows = sets.unionByName(led.select("lead", "part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("terms")))
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "kind", "a", "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, known = None, {}, {}
        a_id, a_set, less, more = None, None, None, None
        for batch in batches:
            out = []
            for lead, part, kind, a, b, terms in zip(batch["lead"], batch["part"], batch["kind"], batch["a"], batch["b"], batch["terms"]):
                if (lead, part) != at:
                    at, held, known, a_id = (lead, part), {}, {}, None
                if kind == 0:
                    held[a] = setjoin.read_terms(terms)
                    continue
                if a != a_id:
                    a_id, a_set, less, more = a, held[a], None, None
                    lead_set = held.get(lead)
                    if a != lead and lead_set is not None and known:
                        less, more = np.setdiff1d(lead_set, a_set, assume_unique=True), np.setdiff1d(a_set, lead_set, assume_unique=True)
                        if len(less) + len(more) > 0.5 * len(a_set):
                            less = None
                b_set = held[b]
                if less is not None and b in known:
                    both = known[b] - setjoin.overlap(less, b_set) + setjoin.overlap(more, b_set)
                else:
                    both = setjoin.overlap(a_set, b_set)
                    if a == lead:
                        known[b] = both
                union = len(a_set) + len(b_set) - both
                if union and both >= threshold * union - 1e-9:
                    out.append((a, b, both / union))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return rows.mapInPandas(verify, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7, min_bytes: int = 240) -> tuple[DataFrame, DataFrame]:
    """(members: key, id), (links: a, b, similarity between classes).

    Records whose normalised text has under ``min_bytes`` bytes, is null or empty take no part.
    Equal texts, also of repeated rows, are members of one class and need no link. Empty tables
    give empty results; other columns are ignored. Nothing is capped: no link is lost.
    """
    members, classes = text_classes(df, key, text, min_bytes)
    members = write_shared(members)
    return members, write_shared(similar_classes(classes, threshold))


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, class id, group_id: records joined by links, directly or through others.

    Large-star and small-star rounds over the classes' links until nothing changes; each round
    replaces a class's links by links to its least neighbour, so a group of any size and shape needs
    few rounds, and no group meets in one task as a list. A record without a link is its own group.
    """
    edges = write_shared(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = write_shared(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return members.join(roots, members["id"] == roots["u"], "left").select(key, "id", F.coalesce("root", "id").alias("group_id"))


def expand_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key_a < key_b of all records in linked classes or in the same class."""
    left, right = members.select(F.col(key).alias("x"), F.col("id").alias("a")), members.select(F.col(key).alias("y"), F.col("id").alias("b"))
    same = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    linked = links.select("a", "b").join(left, "a").join(right, "b").where("x <> y").select("x", "y")
    both = same.unionByName(linked)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
