import random
from itertools import combinations

import numpy as np
import pytest

from quillgrain.llm import near_duplicates, overlap, setjoin
from quillgrain.llm.common import normalise


def grams(t):
    n = normalise(t)
    return frozenset(n[i : i + 4] for i in range(len(n) - 3))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def texts(n, seed, length=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijkl中文") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[len(t) // 2 :] + t[: len(t) // 2]
        else:
            t = [rng.choice(words) for _ in range(length // 6 + rng.randint(0, 20))]
        out.append(" ".join(t))
    return out


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)), np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))
        b = np.unique(np.concatenate([b, a[:100]]))
        x, y = (np.frombuffer(setjoin.bitmap(s), dtype=np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * setjoin.overlap(a, b)


@pytest.mark.parametrize("block", [20_000, 7])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)  # small blocks deal every list into pairs of blocks
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts(160, 5))]
    rows += [("z1", rows[0][1]), ("z2", rows[0][1].upper()), ("n", None), ("e", ""), ("s", "short"), ("l", "x" * 50000)]
    df = spark.createDataFrame(rows, "key string, text string").selectExpr("*", "1 as id", "'a' as norm").repartition(4)
    got = {(r.key_a, r.key_b) for r in near_duplicates.expand_pairs(*near_duplicates.near_duplicates(df, "key", "text", 0.7, 60), "key").collect()}
    sets = {k: grams(t) for k, t in rows if t and len(normalise(t).encode()) >= 60}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.7 or sets[a] == sets[b]}
    assert got == want and len(want) > 60


def test_near_duplicates_of_nothing(spark):
    members, links = near_duplicates.near_duplicates(spark.createDataFrame([], "key string, text string"), "key", "text")
    assert members.count() == 0 and links.count() == 0


@pytest.mark.parametrize("block", [20_000, 5])
def test_cross_split_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for i, t in enumerate(texts(200, 8, 40)):
        scope = rng.choice([None, None, "C1", "C2"])
        rows.append((int(rng.random() < 0.7), "t", f"r{i:03}", scope, normalise(t)))
    rows += [(0, "t", "q1", None, rows[3][4]), (1, "t", "q2", None, rows[3][4]), (1, "t", "q3", None, rows[3][4]), (0, "t", "n", None, None), (1, "t", "s", None, "ab")]
    df = spark.createDataFrame(rows, "side int, tbl string, key string, scope string, norm string")
    got = {(r.eval_key, r.train_key) for r in overlap.expand_links(*overlap.cross_split_links(df)).collect()}
    sets = [(s, k, c, grams(n)) for s, _, k, c, n in rows if n]
    want = {(a[1], b[1]) for a in sets if a[0] == 0 for b in sets if b[0] == 1 and a[2] == b[2] and jaccard(a[3], b[3]) >= 0.7}
    assert got == want and len(want) > 15
    assert overlap.expand_links(*overlap.cross_split_links(df.limit(0))).count() == 0
