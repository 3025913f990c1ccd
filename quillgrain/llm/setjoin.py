"""Exact set-similarity joins over inverted lists, shared by the two duplicate searches.

A text is the set of its hashed character n-grams. Terms are ordered by how many sets hold them,
rarest first, as counted over all sets in a sketch of fixed size; any order is exact, a good one
is fast. Each set posts its first terms; two similar sets must meet in one of those lists. A list
is ordered by set size, and from a posting's size and position follows the stretch of the list
that can hold partners at all: whatever lies outside is skipped as a block, unread. What is left
passes a bitmap bound on the overlap before it becomes a candidate.

Lists of terms that very many sets share are dealt into blocks, and block pairs are joined in
tasks of their own, so no task holds an unbounded list and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the term sketch: what is sent to the driver and broadcast, whatever the corpus.
BUCKETS = 1 << 18
#: Postings of one block of a list; a join task holds two.
BLOCK = 20_000
#: Bits of the overlap bound.
BITS = 512
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(norm: str, k: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-character substrings; empty for shorter texts."""
    cp = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(cp) < k:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(cp) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * _M1 + cp[i : len(cp) - k + 1 + i] + np.uint64(1))
    return np.unique(h)


def scoped(terms: np.ndarray, scope: str | None) -> np.ndarray:
    """Terms that are only equal within one scope."""
    if not scope:
        return terms
    seed = np.uint64(abs(hash_text(scope)) & 0xFFFFFFFFFFFFFFFF)
    return np.sort(_mix(terms ^ seed))


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets, looking the smaller up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def bucket_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - 18)).astype(np.int64)


def bitmap(terms: np.ndarray) -> bytes:
    """Parity of the terms of each of BITS classes: differing bits never exceed differing terms."""
    odd = np.bincount((terms & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def shingle_sets(norms: list[str], scopes: list[str | None] | None = None, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all texts one after the other, sorted within each; how many each has); see ``shingle_set``."""
    terms, sizes = [], []
    at, end = 0, 0
    while at < len(norms):  # about a million characters at once, a longer text by itself
        chars = 0
        while end < len(norms) and (end == at or chars + len(norms[end]) <= 1_000_000):
            chars += len(norms[end])
            end += 1
        part = norms[at:end]
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        doc = np.repeat(np.arange(len(part)), [len(x) for x in part])
        if len(cp) >= k:
            h = np.zeros(len(cp) - k + 1, dtype=np.uint64)
            for i in range(k):
                h = _mix(h * _M1 + cp[i : len(cp) - k + 1 + i] + np.uint64(1))
            own = doc[: len(h)]
            inside = own == doc[k - 1 :]
            h, own = h[inside], own[inside]
            if scopes is not None:
                seeds = np.array([abs(hash_text(s)) if s else 0 for s in scopes[at:end]], dtype=np.uint64)
                mixed = np.array([bool(s) for s in scopes[at:end]])[own]
                h = np.where(mixed, _mix(h ^ seeds[own]), h)
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.empty(0, dtype=bool)
            terms.append(h[new])
            sizes.append(np.bincount(own[new], minlength=len(part)))
        else:
            sizes.append(np.zeros(len(part), dtype=np.int64))
        at = end
    return np.concatenate(terms) if terms else np.empty(0, dtype=np.uint64), np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, dtype=np.int64)


def with_terms(texts: DataFrame) -> DataFrame:
    """``texts`` (id, side, norm, scope) as stored sets: id, side, n, terms (hashes as binary), computed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            terms, n = shingle_sets(b["norm"].tolist(), b["scope"].tolist())
            ends = np.cumsum(n)
            yield pd.DataFrame({"id": b["id"], "side": b["side"], "n": n.astype(np.int32), "terms": [terms[z - m : z].tobytes() for z, m in zip(ends, n)]})

    return texts.select("id", F.col("side").cast("int").alias("side"), "norm", "scope").mapInPandas(run, "id long, side int, n int, terms binary")


def read_terms(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, dtype=np.uint64)


def term_counts(sets: DataFrame) -> np.ndarray:
    """How many stored sets hold a term of each bucket, over all rows of ``sets``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            total += np.bincount(bucket_of(read_terms(b"".join(b["terms"]))), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = sets.select("terms").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def square_weights(counts: np.ndarray, n_sets: int) -> np.ndarray:
    """Squared inverse-frequency weight of the terms of each bucket."""
    return np.log1p(n_sets / np.maximum(1, counts)) ** 2


def postings(sets: DataFrame, counts: np.ndarray, threshold: float, weights: np.ndarray | None = None) -> DataFrame:
    """The lists' entries of stored ``sets``: key, blk, own, side, id, n, pos, rest, need, bits.

    A set posts its first floor((1 - threshold) n) + 1 terms, rarest first, which is also heaviest
    first. ``side`` is 0 for sets that probe, 1 for sets that are probed, -1 where each set does
    both. Terms that no second set holds are left out. With squared ``weights``, ``rest`` is the
    squared norm of the terms from the posted one on and ``need`` the part of the squared norm that
    any partner must share: all but the floor((1 - threshold) n) heaviest terms.
    """
    shared = sets.sparkSession.sparkContext.broadcast((counts, weights))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, weight = shared.value
        for whole in batches:
            cut = whole["n"].cumsum() // 400_000
            for _, b in whole.groupby(cut):
                n = b["n"].to_numpy(dtype=np.int64)
                if not n.sum():
                    continue
                terms = read_terms(b"".join(b["terms"]))
                doc = np.repeat(np.arange(len(b)), n)
                starts = np.cumsum(n) - n
                c = count[bucket_of(terms)].astype(np.int64)
                by = np.lexsort((terms, c, doc))
                pos = np.arange(len(terms)) - starts[doc]
                lost = np.floor((1 - threshold) * n + 1e-9).astype(np.int64)
                rest, need = np.zeros(len(terms)), np.zeros(len(b))
                if weight is not None:
                    w = weight[bucket_of(terms[by])]
                    run = np.concatenate([[0.0], np.cumsum(w)])
                    rest = run[(starts + n)[doc]] - run[np.arange(len(terms))]
                    need = run[starts + n] - run[starts + np.minimum(lost, n)]
                keep = (pos <= lost[doc]) & (c[by] > 1)
                pos, doc, rest = pos[keep], doc[keep], rest[keep]
                key, groups = terms[by][keep].view(np.int64), -(-c[by][keep] // BLOCK)
                ids, side = b["id"].to_numpy(dtype=np.int64), b["side"].to_numpy(dtype=np.int64)
                own = ((ids.astype(np.uint64) * _M1) >> np.uint64(33)).astype(np.int64)[doc] % groups
                # a set that does both is in every pair of blocks with its own, one that probes in every block
                many = np.where(side[doc] == 1, 1, groups)
                at = np.repeat(np.arange(len(doc)), many)
                other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                mine, kind = own[at], side[doc[at]]
                blk = np.where(kind == -1, np.minimum(mine, other) * 1_000_000 + np.maximum(mine, other), np.where(kind == 0, other, mine))
                d = doc[at]
                held = [bitmap(t) for t in np.split(terms, starts[1:])]
                out = {"key": key[at], "blk": blk, "own": mine.astype(np.int32), "side": kind.astype(np.int8), "id": ids[d], "n": n[d].astype(np.int32), "pos": pos[at].astype(np.int32)}
                if weight is not None:
                    out |= {"rest": rest[at], "need": need[d]}
                yield pd.DataFrame(out | {"bits": [held[i] for i in d]})

    made = "key long, blk long, own int, side byte, id long, n int, pos int" + (", rest double, need double" if weights is not None else "") + ", bits binary"
    return sets.select("id", "side", "n", "terms").mapInPandas(post, made)


def _stretches(g: dict[str, np.ndarray], least_n, most_n, probes: np.ndarray, probed: np.ndarray, after_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (probe, partner) where the partner's size lies in the probe's allowed stretch."""
    big = 1 << 32
    comp = g["group"][probed] * big + g["n"][probed]
    base = g["group"][probes] * big
    lo = np.searchsorted(comp, base + least_n, side="left")
    hi = np.searchsorted(comp, base + most_n, side="right")
    if after_self:  # probed is the whole list, so the place in it is known
        lo = np.maximum(lo, probes + 1)
    many = np.maximum(0, hi - lo)
    ends = np.cumsum(many)
    start = 0
    while start < len(probes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, side="right"))
        stop = max(stop, start + 1)
        m = many[start:stop]
        if m.sum():
            i = np.repeat(probes[start:stop], m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:stop], m)
            yield i, probed[j]
        start = stop


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Whole (key, blk) groups of the sorted rows, many at a time."""
    kept: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        kept.append(b)
        rows += len(b)
        if rows < 40_000:
            continue
        both = pd.concat(kept, ignore_index=True)
        key, blk = both["key"].to_numpy(), both["blk"].to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1]))
        if not len(change):
            kept, rows = [both], len(both)
            continue
        cut = change[-1] + 1
        yield _arrays(both.iloc[:cut])
        kept, rows = [both.iloc[cut:]], len(both) - cut
    if rows:
        yield _arrays(pd.concat(kept, ignore_index=True))


def _arrays(b: pd.DataFrame) -> dict[str, np.ndarray]:
    g = {c: b[c].to_numpy() for c in ("own", "side", "id", "pos", "key")}
    g["n"] = b["n"].to_numpy(dtype=np.int64)
    if "need" in b:
        g["rest"], g["need"] = b["rest"].to_numpy(), b["need"].to_numpy()
    key, blk = b["key"].to_numpy(), b["blk"].to_numpy()
    g["group"] = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (blk[1:] != blk[:-1]))]).astype(np.int64)
    g["mixed"] = blk // 1_000_000 != blk % 1_000_000
    g["bits"] = np.frombuffer(b"".join(b["bits"]), dtype=np.uint64).reshape(len(b), BITS // 64)
    return g


def _within_bound(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Pairs whose bitmaps allow an overlap of ``need``: (n + m - differing bits) / 2 bounds it."""
    ok = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 200_000):
        s = slice(at, at + 200_000)
        diff = np.bitwise_count(g["bits"][i[s]] ^ g["bits"][j[s]]).sum(1, dtype=np.int64)
        ok[s] = (g["n"][i[s]] + g["n"][j[s]] - diff) >= 2 * need[s] - 1e-9
    return ok


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    if not a:
        return pd.DataFrame({"a": np.empty(0, dtype=np.int64), "b": np.empty(0, dtype=np.int64)})
    x = np.concatenate(a), np.concatenate(b)
    order = np.lexsort(x[::-1])
    p, q = x[0][order], x[1][order]
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.empty(0, dtype=bool)
    return pd.DataFrame({"a": p[first], "b": q[first]})


def self_candidates(posted: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, that may have a Jaccard index of ``threshold`` or more; none is lost."""
    alpha = threshold / (1 + threshold)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            n, pos = g["n"], g["pos"].astype(np.int64)
            # the smaller set of a pair meets its partner early: n - pos >= alpha (n + m), m >= n
            probes = np.flatnonzero(n - pos >= 2 * alpha * n - 1e-9)
            most = np.minimum(n[probes] / threshold, (n[probes] - pos[probes]) / alpha - n[probes]) + 1e-9
            left, right = [], []
            for i, j in _stretches(g, n[probes], np.floor(most).astype(np.int64), probes, np.arange(len(n)), True):
                need = alpha * (n[i] + n[j])
                ok = (n[j] - pos[j] >= need - 1e-9) & (g["id"][i] != g["id"][j]) & (~g["mixed"][i] | (g["own"][i] != g["own"][j]))
                i, j, need = i[ok], j[ok], need[ok]
                ok = _within_bound(g, i, j, need)
                a, b = g["id"][i[ok]], g["id"][j[ok]]
                left.append(np.minimum(a, b))
                right.append(np.maximum(a, b))
            yield _unique_pairs(left, right)

    return _sorted(posted).mapInPandas(join, "a long, b long").distinct()


def cross_candidates(posted: DataFrame, threshold: float, weights: np.ndarray) -> DataFrame:
    """Distinct (a, b): probing set a and probed set b that may have a Jaccard index of ``threshold``.

    A Jaccard index of t lets each set lose at most floor((1 - t) n) terms, so the dot product of the
    weighted vectors is at least what is left of either squared norm without its heaviest terms
    (``need``). At the first common term, the heaviest, the product is at most the residual squared
    norm of either vector from there on, and at most as many products of the maximum weight as the
    shorter rest has terms; both must reach the larger need.
    """
    shared = posted.sparkSession.sparkContext.broadcast(weights)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = shared.value
        for g in _groups(batches):
            n, pos, rest, need = g["n"], g["pos"].astype(np.int64), g["rest"], g["need"]
            heaviest = weight[bucket_of(g["key"].view(np.uint64))]
            probes, probed = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
            left, right = [], []
            if len(probes) and len(probed):
                least, most = np.ceil(threshold * n[probes] - 1e-9).astype(np.int64), np.floor(n[probes] / threshold + 1e-9).astype(np.int64)
                for i, j in _stretches(g, least, most, probes, probed, False):
                    both = np.maximum(need[i], need[j]) * (1 - 1e-9) - 1e-9
                    ok = (np.minimum(rest[i], rest[j]) >= both) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) * heaviest[i] >= both)
                    i, j = i[ok], j[ok]
                    ok = _within_bound(g, i, j, threshold / (1 + threshold) * (n[i] + n[j]))
                    left.append(g["id"][i[ok]])
                    right.append(g["id"][j[ok]])
            yield _unique_pairs(left, right)

    return _sorted(posted).mapInPandas(join, "a long, b long").distinct()


def _sorted(posted: DataFrame) -> DataFrame:
    return posted.repartition(F.col("key"), F.col("blk")).sortWithinPartitions("key", "blk", "side", "n", "id")
