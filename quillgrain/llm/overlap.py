"""The same or nearly the same records across splits, by a weighted cosine join.

Each text is a vector over its 4-character substrings with inverse-frequency weights, counted over
all texts. For any fixed weights the Jaccard rule of the task implies a bound on a vector's dot
products: a partner misses at most floor((1 - t) n) of its terms, so what is left without the
heaviest of them must be shared. The join prunes by maximum weights and residual norms on inverted
lists against these bounds (see ``setjoin.cross_candidates``), takes exact dot products, and keeps
the pairs that reach both the cosine bound and the Jaccard index; nothing is lost. A scope column,
where given, must agree too and is part of every term, so lists of different scopes never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.session import write_shared

from . import setjoin


def cross_split_links(records: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members: side, tbl, key, id), (links: a, b, similarity, cosine) of ``records``.

    ``records`` has side (0 evaluation, 1 training), tbl, key, scope (null: any), norm. Equal texts
    of one side and scope are one vector. Texts under four characters have no vector and match
    nothing; nulls and repeated rows are as texts without and with copies; empty tables give
    empty results. Nothing is capped.
    """
    prepared = write_shared(records.where("norm is not null and length(norm) >= 4").select("side", "tbl", "key", "scope", "norm").withColumn("fp", F.sha2(F.concat_ws("\x01", F.coalesce("scope", F.lit("")), "norm"), 256)))
    classes = write_shared(prepared.groupBy("side", "fp").agg(F.min("norm").alias("norm"), F.min("scope").alias("scope")).withColumn("id", F.monotonically_increasing_id()))
    members = prepared.select("side", "fp", "tbl", "key").join(classes.select("side", "fp", "id"), ["side", "fp"]).select("side", "tbl", "key", "id").distinct()
    sets = write_shared(setjoin.with_terms(classes))
    counts = setjoin.term_counts(sets)
    weights = setjoin.square_weights(counts, sets.count())
    posted = setjoin.postings(sets, counts, threshold, weights)
    pairs = setjoin.cross_candidates(posted, threshold, weights)
    left, right = sets.where("side = 0").select(F.col("id").alias("a"), F.col("terms").alias("ta")), sets.where("side = 1").select(F.col("id").alias("b"), F.col("terms").alias("tb"))
    shared = records.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = shared.value
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                x, y = setjoin.read_terms(ta), setjoin.read_terms(tb)
                both = np.intersect1d(x, y, assume_unique=True)
                dot, nx, ny = (weight[setjoin.bucket_of(t)].sum() for t in (both, x, y))
                union = len(x) + len(y) - len(both)
                if union and len(both) >= threshold * union - 1e-9:
                    out.append((a, b, len(both) / union, dot / np.sqrt(nx * ny)))
            yield pd.DataFrame(out, columns=["a", "b", "similarity", "cosine"])

    links = pairs.join(left, "a").join(right, "b").mapInPandas(products, "a long, b long, similarity double, cosine double")
    return write_shared(members), write_shared(links)


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """side, tbl, key, class_id, n_links: how many records of the other side each record is linked to,
    from the sizes of the linked classes; no pair of records is formed.
    """
    sizes = members.groupBy("side", "id").agg(F.count_distinct("key").alias("size"))
    to = lambda mine, other, side: links.join(sizes.where(F.col("side") == side), links[other] == sizes["id"]).groupBy(links[mine].alias("class_id")).agg(F.sum("size").alias("n"))
    found = to("a", "b", 1).withColumn("of", F.lit(0)).unionByName(to("b", "a", 0).withColumn("of", F.lit(1)))
    joined = members.join(found, (members["id"] == found["class_id"]) & (members["side"] == found["of"]), "left")
    return joined.select("side", "tbl", "key", F.col("id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def expand_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """tbl, eval_key, train_key of every linked record pair, once."""
    left = members.where("side = 0").select(F.col("id").alias("a"), "tbl", F.col("key").alias("eval_key"))
    right = members.where("side = 1").select(F.col("id").alias("b"), F.col("key").alias("train_key"))
    return links.select("a", "b").join(left, "a").join(right, "b").select("tbl", "eval_key", "train_key").distinct()
