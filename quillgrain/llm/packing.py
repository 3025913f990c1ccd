"""Filling containers of fixed capacity with texts measured in tokens of a public tokenizer.

Variable-capacity best-fit on the histogram of sizes. Sizes are at most the capacity, so the
histogram has a bounded number of entries whatever the number of texts; best-fit decreasing runs on
it, opening for each lot of equal pieces the permitted length that costs least per token, filling
what is left by the largest sizes that fit, and at the end downsizing each container to the
smallest permitted length that holds its contents. The plan is a list of patterns with
multiplicities; texts join it by their rank within their size. A size is ranked in as many parts as
its count asks for, so a hot size never meets in one task, and pieces that fill a container need no
rank: each has a container of its own.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.session import cut_lineage

#: Pieces of one size that are ranked together, about.
PART = 200_000


def _encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """key, n_tokens of every row; null texts have 0 tokens. Special-token strings are ordinary text."""
    flat = df.select(F.col(key).alias("k"), F.col(text).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n_tokens": [len(encode(x)) if x else 0 for x in b["body"]]})

    return flat.mapInPandas(run, flat.select("k").schema.add("n_tokens", "long")).withColumnRenamed("k", key)


def plan_patterns(counts: dict[int, int], lengths: tuple[int, ...], overhead: int = 16) -> list[tuple[tuple[tuple[int, int], ...], int, int]]:
    """(sizes with multiplicity, container length, how many such containers), covering ``counts``.

    ``counts`` maps a size (1..max(lengths)) to the number of pieces of it. The largest size left
    opens a container; the best completion under each permitted length is built greedily from the
    largest sizes that fit; the length with the least cost per token held wins, where a container
    costs its length and ``overhead`` tokens, so a short one is opened only where it saves space.
    A pattern is used as often as its pieces last, so the work depends on the distinct sizes only.
    """
    lengths = tuple(sorted(lengths))
    left = {s: c for s, c in counts.items() if c > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        head, best = sizes[-1], None
        for cap in lengths:
            if cap < head:
                continue
            use, room = {head: 1}, cap - head
            while room:
                i = bisect_right(sizes, room) - 1
                while i >= 0 and left[sizes[i]] <= use.get(sizes[i], 0):
                    i -= 1
                if i < 0:
                    break
                take = min(left[sizes[i]] - use.get(sizes[i], 0), room // sizes[i])
                use[sizes[i]] = use.get(sizes[i], 0) + take
                room -= take * sizes[i]
            cost = (cap + overhead) / (cap - room)
            if best is None or cost < best[0] or (cost == best[0] and cap > best[1]):
                best = (cost, cap, use, room)
        _, cap, use, room = best
        times = min(left[s] // k for s, k in use.items())
        filled = cap - room
        out.append((tuple(sorted(use.items(), reverse=True)), next(x for x in lengths if x >= filled), times))
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.remove(s)
    return out


def pack(sized: DataFrame, key: str, size: str, capacity: int = 2048, lengths: tuple[int, ...] = (256, 512, 1024, 2048)) -> DataFrame:
    """Containers for the items of ``sized``.

    Columns: key, piece_no (from 1), n_pieces, start (token), n_tokens, container_id,
    container_length. An item is split only if it is longer than ``capacity``, into full containers
    and a rest. Items of size 0 or null need no room: one row with container_id null, n_tokens 0.
    Equal keys and ties are separate items. An empty table gives no rows. Container numbers are
    unique, not dense. A lost executor leads to the same plan again, since ranks follow the row
    numbers of the checkpointed sizes.
    """
    lengths = tuple(sorted({x for x in lengths if x < capacity} | {capacity}))
    # counted once, read several times; its partitions stay as they are, and with them the row numbers
    item = cut_lineage(sized.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    rest, full = F.col("n") % F.lit(capacity), F.floor(F.col("n") / F.lit(capacity)).cast("int")
    item = item.withColumn("row", F.monotonically_increasing_id())
    # at most ``capacity`` rows
    totals = {int(r["s"]): int(r["c"]) for r in item.where("n > 0").groupBy(rest.cast("int").alias("s")).agg(F.count("*").alias("c")).collect() if r["s"]}
    plan = plan_patterns(totals, lengths)
    spark = sized.sparkSession
    parts = spark.createDataFrame([(s, -(-c // PART)) for s, c in totals.items()], "s int, parts int")
    tail = item.where((F.col("n") > 0) & (rest > 0)).select("k", "row", (full + 1).alias("piece_no"), (full + 1).alias("n_pieces"), (F.col("n") - rest).alias("start"), rest.cast("int").alias("s"))
    tail = tail.join(F.broadcast(parts), "s").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    # one row for each PART pieces, and one more for each size
    grid = tail.groupBy("s", "salt").count().toPandas().sort_values(["s", "salt"])
    grid["before"] = grid.groupby("s")["count"].cumsum() - grid["count"]

    # where the pieces of a size go: from rank r0 on, ``per`` to each container of the pattern
    slots, first, taken = [], 0, {}
    for use, length, times in plan:
        for s, per in use:
            r0 = taken.get(s, 0)
            slots.append((s, r0, r0 + per * times, per, first, length))
            taken[s] = r0 + per * times
        first += times
    by_size: dict[int, list] = {}
    for s, r0, r1, per, start, length in slots:
        by_size.setdefault(s, []).append((r0, per, start, length))
    shared = spark.sparkContext.broadcast(
        (
            {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in by_size.items()},
            {(int(s), int(t)): int(b) for s, t, b in zip(grid["s"], grid["salt"], grid["before"])},
        )
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, before = shared.value
        for b in batches:
            box, length = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int32)
            for (s, salt), at in b.groupby(["s", "salt"]).indices.items():
                r0, per, start, cap = table[s]
                r = b["r"].to_numpy()[at] + before[s, salt]
                i = np.searchsorted(r0, r, side="right") - 1
                box[at], length[at] = start[i] + (r - r0[i]) // per[i], cap[i]
            out = b[["k", "piece_no", "n_pieces", "start"]].copy()
            out["n_tokens"], out["container_id"], out["container_length"] = b["s"], box, length
            yield out

    ranked = tail.withColumn("r", (F.row_number().over(Window.partitionBy("s", "salt").orderBy("row")) - 1).cast("long"))
    made = item.select("k").schema.add("piece_no", "integer").add("n_pieces", "integer").add("start", "long").add("n_tokens", "integer").add("container_id", "long").add("container_length", "integer")
    out = ranked.mapInPandas(place, made)
    filled = item.where(full > 0).select("k", F.explode(F.sequence(F.lit(1), full)).alias("piece_no"), (full + F.when(rest > 0, 1).otherwise(0)).alias("n_pieces"))
    filled = filled.select("k", "piece_no", "n_pieces", ((F.col("piece_no") - 1) * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).alias("n_tokens"), (F.monotonically_increasing_id() + F.lit(first)).alias("container_id"), F.lit(capacity).alias("container_length"))
    none = item.where("n <= 0").select("k", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("container_length"))
    out = out.unionByName(filled)
    return out.unionByName(none).withColumnRenamed("k", key)
