"""Exact nearest neighbours, cluster order and cluster quality over embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillgrain.functions import vectors as V

#: Query vectors that are broadcast at once; more queries are answered in further rounds.
QUERY_BLOCK = 4096
#: Queries whose distances to a batch are held at once.
TILE = 256


def _blocks(queries: DataFrame, key: str, vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys, rows = [], []
    for r in queries.select(key, vec).where(F.col(vec).isNotNull()).toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        if len(rows) == QUERY_BLOCK:
            yield np.array(keys), np.array(rows, dtype=np.float64)
            keys, rows = [], []
    if rows:
        yield np.array(keys), np.array(rows, dtype=np.float64)


def top_k(queries: DataFrame, corpus: DataFrame, key: str, vec: str, k: int, metric: str = "l2", skip_self: bool = True) -> DataFrame:
    """query_key, key, distance, rank (from 1): the k nearest corpus rows of every query, ties by key.

    The stated query set meets all rows in blocks of bounded size: each task multiplies its rows
    with a block and keeps k for each query, so what is shuffled is queries x tasks x k rows.
    ``l2`` or ``cosine`` distance; null vectors have no neighbours. Blank query sets give no rows.
    """
    k = max(1, int(k))
    spark = corpus.sparkSession
    base = corpus.select(F.col(key).alias("key"), F.col(vec).alias("vec")).where("vec is not null")
    out = None
    for block in _blocks(queries, key, vec):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q2 = (q * q).sum(1)
            best_d, best_k = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
            for b in batches:
                if not len(b):
                    continue
                x, keys = np.stack(b["vec"].to_numpy()).astype(np.float64), b["key"].to_numpy()
                x2 = (x * x).sum(1)
                tiles = []
                for at in range(0, len(ids), TILE):
                    t = slice(at, at + TILE)
                    if metric == "l2":
                        d = np.sqrt(np.maximum(0.0, q2[t, None] + x2[None, :] - 2 * q[t] @ x.T))
                    else:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            d = 1.0 - (q[t] @ x.T) / np.sqrt(q2[t, None] * x2[None, :])
                    if skip_self:
                        d[ids[t, None] == keys[None, :]] = np.inf
                    d, name = np.hstack([best_d[t], np.round(d, 9)]), np.hstack([best_k[t], np.broadcast_to(keys, d.shape)])
                    if d.shape[1] > k:  # the k smallest, ties by key: all rows as near as the k-th stay for the tie
                        last = np.partition(np.where(np.isnan(d), np.inf, d), k - 1, axis=1)[:, k - 1 : k]
                        wide = max(k, int((d <= last).sum(1).max()))
                        near = np.argpartition(np.where(np.isnan(d), np.inf, d), min(wide, d.shape[1]) - 1, axis=1)[:, :wide]
                        d, name = np.take_along_axis(d, near, 1), np.take_along_axis(name, near, 1)
                        order = np.lexsort((name, d), axis=1)[:, :k]
                        d, name = np.take_along_axis(d, order, 1), np.take_along_axis(name, order, 1)
                    tiles.append((d, name))
                best_d, best_k = np.vstack([d for d, _ in tiles]), np.vstack([name for _, name in tiles])
            keep = np.isfinite(best_d)
            yield pd.DataFrame({"query_key": np.broadcast_to(ids[:, None], best_d.shape)[keep], "key": best_k[keep], "distance": best_d[keep]})

        found = base.mapInPandas(run, "query_key long, key long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_key long, key long, distance double")
    order = Window.partitionBy("query_key").orderBy(F.round("distance", 9), "key")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def centroids(rows: DataFrame, cluster: str, vec: str) -> DataFrame:
    """cluster, n, total (vector sum), squares (sum of squared norms): one pass, one row a cluster."""
    parts = rows.where(F.col(vec).isNotNull()).select(cluster, F.posexplode(vec).alias("i", "x")).groupBy(cluster, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    return parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("total"), F.sum("q").alias("squares"), F.max("n").alias("n"))


def centrality(rows: DataFrame, key: str, cluster: str, vec: str) -> DataFrame:
    """key, cluster, centrality, place (from 1): the sum of a row's dot products with its cluster.

    The sum over all members is the dot product with the members' sum, which makes it linear.
    """
    joined = rows.where(F.col(vec).isNotNull()).join(centroids(rows, cluster, vec).select(cluster, "total"), cluster)
    scored = joined.select(key, cluster, F.round(V.dot(F.col(vec), F.col("total")), 6).alias("centrality"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("centrality"), key)).cast("long"))


def squared_silhouette(rows: DataFrame, key: str, cluster: str, vec: str) -> DataFrame:
    """key, cluster, silhouette with squared Euclidean distance, in closed form from cluster moments.

    The mean squared distance to a cluster is |x|^2 + squares / n - 2 x . total / n; a member leaves
    itself out. The clusters' moments are k rows; they meet each row as one array.
    """
    moments = centroids(rows, cluster, vec)
    packed = moments.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "total", "squares", "n")).alias("all_clusters"))
    each = rows.where(F.col(vec).isNotNull()).join(F.broadcast(packed))  # one row of k clusters
    x2 = V.dot(F.col(vec), F.col(vec))

    def mean(m, less: int):
        return (m["n"] * x2 + m["squares"] - 2 * V.dot(F.col(vec), m["total"])) / F.greatest(F.lit(1), m["n"] - less)

    own = F.filter("all_clusters", lambda m: m["c"] == F.col(cluster))[0]
    others = F.transform(F.filter("all_clusters", lambda m: m["c"] != F.col(cluster)), lambda m: mean(m, 0))
    ab = each.select(key, cluster, mean(own, 1).alias("a"), F.array_min(others).alias("b"), own["n"].alias("n"))
    s = F.when((F.col("n") <= 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(key, cluster, F.round(s, 6).alias("silhouette"))


def silhouette(queries: DataFrame, rows: DataFrame, key: str, cluster: str, vec: str) -> DataFrame:
    """key, cluster, silhouette (Euclidean) of the stated query rows against all rows.

    Each task adds up the distances of its rows to a block of queries by cluster, so what is shuffled is
    queries x clusters x tasks; for all rows as queries use a sample or ``squared_silhouette``.
    """
    spark = rows.sparkSession
    base = rows.where(F.col(vec).isNotNull()).select(F.col(cluster).cast("string").alias("c"), F.col(vec).alias("v"))
    out = None
    for ids, q in _blocks(queries, key, vec):
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q2, sums, seen = (q * q).sum(1), {}, {}
            for b in batches:
                for c, part in b.groupby("c"):
                    x = np.stack(part["v"].to_numpy()).astype(np.float64)
                    for at in range(0, len(q), 256):
                        tile = slice(at, at + 256)
                        d = np.sqrt(np.maximum(0.0, q2[tile, None] + (x * x).sum(1)[None, :] - 2 * q[tile] @ x.T))
                        sums.setdefault(c, np.zeros(len(q)))[tile] += d.sum(1)
                    seen[c] = seen.get(c, 0) + len(x)
            for c, s in sums.items():
                yield pd.DataFrame({"k": ids, "other": c, "s": s, "n": seen[c]})

        found = base.mapInPandas(run, "k long, other string, s double, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select(key, cluster, F.lit(0.0).alias("silhouette")).limit(0)
    means = out.groupBy("k", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(cluster).alias("mine"))
    same = F.col("other") == F.col("mine").cast("string")
    ab = means.join(own, "k").groupBy("k", "mine").agg(F.max(F.when(same, F.col("s") / F.greatest(F.lit(1), F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"), F.max(F.when(same, F.col("n"))).alias("n"))
    s = F.when((F.col("n") <= 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(F.col("k").alias(key), F.col("mine").alias(cluster), F.round(s, 6).alias("silhouette"))


def kmeans(rows: DataFrame, key: str, vec: str, k: int = 12, seed: int = 42) -> DataFrame:
    """key, cluster of a seeded k-means; labels are this implementation's own."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(key, F.col("prediction").cast("long").alias("cluster"))


def best_k(rows: DataFrame, key: str, vec: str, low: int = 6, high: int = 10, seed: int = 42, sample: int = 2000) -> int:
    """The k in low..high with the best mean Euclidean silhouette of ``sample`` rows, picked by a hash, against all; the smallest of equals."""
    scores = {}
    for k in range(low, high + 1):
        placed = kmeans(rows, key, vec, k, seed).join(rows.select(key, vec), key)
        scores[k] = silhouette(placed.orderBy(F.xxhash64(key), key).limit(sample), placed, key, "cluster", vec).agg(F.avg("silhouette")).first()[0] or 0.0
    return max(scores, key=lambda k: (scores[k], -k))


def embed_texts(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], vec: str = "embedding", size: int = 64) -> DataFrame:
    """``rows`` with a vector of each text from any embedder, asked for ``size`` texts at a time over Arrow batches.

    Null texts have a null vector. The embedder may be a hosted model or a function such as ``hashed_vectors``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            there = np.flatnonzero(b[text].notna().to_numpy())
            made: list = [None] * len(b)
            for at in range(0, len(there), size):
                part = there[at : at + size]
                for i, v in zip(part, embed(b[text].iloc[part].tolist())):
                    made[i] = v
            yield b.assign(**{vec: pd.Series(made, index=b.index, dtype=object)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(vec, ArrayType(DoubleType()))]))


def hashed_vectors(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that counts the words of a text by their MD5: the offline stand-in for a model."""
    import hashlib
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims] += 1.0
            out.append(v)
        return out

    return embed


def retrieval_chain(queries: DataFrame, corpus: DataFrame, key: str, vec: str, text: str, prompt: Callable[[Column, Column], Column], model: Callable[[Column], Column], parse: Callable[[Column], Column], k: int = 4) -> DataFrame:
    """query_key, context, prompt, answer: the k nearest texts of each query, joined nearest first, put
    into a prompt, sent to a model column and parsed. ``queries`` needs ``question`` beside key and vector.
    """
    near = top_k(queries, corpus, key, vec, k).select("query_key", "key", "rank")
    texts = near.join(corpus.select(F.col(key).alias("key"), F.col(text).alias("passage")), "key")
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]), "\n\n")  # k passages
    rows = texts.groupBy("query_key").agg(context.alias("context")).join(queries.select(F.col(key).alias("query_key"), "question"), "query_key")
    rows = rows.withColumn("prompt", prompt(F.col("context"), F.col("question")))
    return rows.withColumn("answer", parse(model(F.col("prompt")))).select("query_key", "context", "prompt", "answer")
