"""Held-out passages inside a large corpus, by suffix arrays over the corpus shards.

Each batch of documents is a shard. Its suffix array holds every ``stride``-th suffix of the shard's
normalised texts, sorted by its first ``min_chars`` characters: a passage of ``min_chars`` characters
always covers such a position with ``min_chars - stride + 1`` characters of the passage left, so
every test suffix finds it by binary search on that many characters. Hits that follow each other on
one diagonal (document place minus item place) are one match; it is extended once to both sides.
The test items are the bounded side: their suffixes are sorted once in the driver and broadcast, in
rounds where there are very many. One round reads the corpus once; for more rounds the shards'
arrays are written to the shared folder first and searched there. The corpus is never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrain.session import write_shared

from .common import normalise

#: Most characters of test items that are broadcast; beyond it the items are searched in rounds.
ITEM_CHARS = 1_000_000
#: Characters of a shard, which bounds the memory of its suffix array.
SHARD_CHARS = 3_000_000
#: Hits that are held before they are joined into matches.
HITS = 2_000_000


def suffix_order(texts: list[str], depth: int, stride: int = 1) -> np.ndarray:
    """Places (text, offset) of every ``stride``-th suffix with ``depth`` characters left, sorted by the suffix."""
    place = [(k, i) for k, text in enumerate(texts) for i in range(0, len(text) - depth + 1, stride)]
    longest = max(40, depth)
    place.sort(key=lambda p: texts[p[0]][p[1] : p[1] + longest])
    return np.array(place, dtype=np.int32).reshape(-1, 2)


def _common(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from a[i] and b[j] on agree, up to ``most``; compared in growing slices."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done, step = done + step, step * 4
        elif step == 1:
            break
        else:
            step = max(1, step // 8)
    return done


def _extended(text: str, lo: int, hi: int, item: str, off: int) -> tuple[int, int, int]:
    """The match text[lo:hi] = item[off:] made as long as it gets: its two starts and its length."""
    reach = min(lo, off)
    left = _common(text[lo - reach : lo][::-1], 0, item[off - reach : off][::-1], 0, reach) if reach else 0
    end = off + hi - lo
    right = _common(text, hi, item, end, min(len(text) - hi, len(item) - end))
    return lo - left, off - left, hi - lo + left + right


def longest_matches(texts: list[str], array: np.ndarray, items: list[str], order: np.ndarray, min_chars: int, stride: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (length, -text place, -item place) of the longest match of ``min_chars`` or more."""
    depth = min_chars - stride + 1
    heads = [texts[d][p : p + min_chars] for d, p in array.tolist()]
    keys = [items[k][i : i + depth] for k, i in order.tolist()]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not found:
            return
        at, where = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        found.clear()
        held = 0
        (d, p), (k, off) = array[at].T.astype(np.int64), order[where].T.astype(np.int64)
        diagonal = p - off
        by = np.lexsort((p, diagonal, k, d))
        d, k, p, diagonal = d[by], k[by], p[by], diagonal[by]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] - p[:-1] > stride)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(p)]]) - 1
        span = p[last] - p[first] + depth
        for c in np.argsort(-span, kind="stable").tolist():
            i = first[c]
            pair, lo, hi = (int(d[i]), int(k[i])), int(p[i]), int(p[last[c]]) + depth
            known = best.get(pair, (min_chars, 0, 0))
            a, b, n = _extended(texts[pair[0]], lo, hi, items[pair[1]], lo - int(diagonal[i]))
            if n >= known[0] and (n, -a, -b) > best.get(pair, (0, 0, 0)):
                best[pair] = (n, -a, -b)

    lo, i, n = 0, 0, len(keys)
    while i < n:
        j = i + 1
        while j < n and keys[j] == keys[i]:
            j += 1
        lo = bisect_left(heads, keys[i], lo)  # the test suffixes are sorted too, so the search only moves on
        if lo == len(heads):
            break
        if heads[lo].startswith(keys[i]):
            hi = bisect_left(heads, keys[i] + chr(0x10FFFF), lo)
            many = max(1, HITS // (j - i))
            for start in range(lo, hi, many):
                stop = min(hi, start + many)
                found.append((np.repeat(np.arange(start, stop), j - i), np.tile(np.arange(i, j), stop - start)))
                held += (stop - start) * (j - i)
                if held >= HITS:
                    settle()
        i = j
    settle()
    return best


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_chars: int = 40, stride: int = 16) -> DataFrame:
    """Documents that share at least ``min_chars`` consecutive normalised characters with an item.

    Columns: doc_key, item_key, n_chars (the longest match), doc_at, item_at (its first places in the
    normalised texts). One row for each document row and item. Null, empty and shorter texts match
    nothing; empty tables give no rows; equal documents are each reported; other columns are ignored.
    """
    depth = min_chars - stride + 1
    if depth < 1:
        raise ValueError("stride must not exceed min_chars")
    spark = docs.sparkSession
    flat = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("body"))
    kind = flat.schema["k"].dataType
    made = T.StructType([T.StructField("k", kind), T.StructField("i", items.select(item_key).schema[0].dataType)]).add("n_chars", "integer").add("doc_at", "integer").add("item_at", "integer")
    names = {"k": doc_key, "i": item_key}
    rounds = _rounds(items.select(F.col(item_key), F.col(item_text)).where(F.col(item_text).isNotNull()).orderBy(item_key), min_chars)
    group, following = next(rounds, None), next(rounds, None)
    if group is None:
        return spark.createDataFrame([], made).withColumnsRenamed(names)
    if following is None:
        return flat.mapInPandas(_search_texts(_shared(group, depth, spark), min_chars, stride), made).withColumnsRenamed(names)
    stored = T.StructType([T.StructField("k", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("places", T.BinaryType())])
    shards = write_shared(flat.mapInPandas(_store(min_chars, stride), stored))
    out = None
    while group is not None:
        sent = _shared(group, depth, spark)
        found = write_shared(shards.mapInPandas(_search_stored(sent, min_chars, stride), made))
        sent.destroy()
        out = found if out is None else out.unionByName(found)
        group, following = following, next(rounds, None)
    return out.withColumnsRenamed(names)


def _rounds(items: DataFrame, min_chars: int) -> Iterator[list[tuple[object, str]]]:
    """Groups of normalised items of at most ITEM_CHARS characters (a longer item is a group)."""
    group, size = [], 0
    for key, text in items.toLocalIterator():
        norm = normalise(text)
        if len(norm) < min_chars:
            continue
        if group and size + len(norm) > ITEM_CHARS:
            yield group
            group, size = [], 0
        group.append((key, norm))
        size += len(norm)
    if group:
        yield group


def _shared(group: list[tuple[object, str]], depth: int, spark):
    """Keys, texts and sorted suffixes of a round, at hand in every task."""
    texts = [x for _, x in group]
    return spark.sparkContext.broadcast(([k for k, _ in group], texts, suffix_order(texts, depth)))


def _shards(batches: Iterator[pd.DataFrame], min_chars: int, stride: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Keys, normalised texts and suffix array of each shard; texts that are too short are left out."""
    for b in batches:
        for _, part in b.groupby(b["body"].str.len().fillna(0).cumsum() // SHARD_CHARS):
            long = [(k, t) for k, t in zip(part["k"].tolist(), map(normalise, part["body"])) if len(t) >= min_chars]
            if long:
                texts = [t for _, t in long]
                yield [k for k, _ in long], texts, suffix_order(texts, min_chars - stride + 1, stride)


def _rows(docs: list, texts: list[str], array: np.ndarray, held: tuple, min_chars: int, stride: int) -> pd.DataFrame:
    keys, items, order = held
    best = longest_matches(texts, array, items, order, min_chars, stride)
    return pd.DataFrame([(docs[d], keys[k], n, -a, -c) for (d, k), (n, a, c) in best.items()], columns=["k", "i", "n_chars", "doc_at", "item_at"])


def _search_texts(sent, min_chars: int, stride: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, texts, array in _shards(batches, min_chars, stride):
            yield _rows(docs, texts, array, sent.value, min_chars, stride)

    return run


def _store(min_chars: int, stride: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, texts, array in _shards(batches, min_chars, stride):
            yield pd.DataFrame({"k": [docs], "texts": [texts], "places": [array.tobytes()]})

    return run


def _search_stored(sent, min_chars: int, stride: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for docs, texts, places in zip(b["k"], b["texts"], b["places"]):
                yield _rows(list(docs), list(texts), np.frombuffer(places, dtype=np.int32).reshape(-1, 2), sent.value, min_chars, stride)

    return run


def without_leaks(docs: DataFrame, doc_key: str, found: DataFrame) -> DataFrame:
    """The documents that hold no item; rows with a null key are kept."""
    return docs.join(found.select(doc_key).distinct(), doc_key, "left_anti")
