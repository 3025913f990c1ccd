"""Texts cut off by a writer's limit or a broken transfer.

Per source and column the lengths of the values without a closing mark are counted, in characters
and in UTF-8 bytes, for whole values and for the answers inside sound objects. A limit shows as a
spike against its neighbours; values at a spike with an open end are cut by that limit. A broken
transfer leaves no spike. What it cuts looks at its end like what a limit cuts, so the values at the
spikes, and sound values cut anywhere, teach a model of endings (``endings``), which tells cut ends
from whole ones; objects that do not close and broken characters are cuts by themselves.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import PLACEHOLDERS, normalise, question_of
from .endings import BROKEN, CLOSED, OPEN, WIDTH, Endings, Reply, cut_features, final_mark, fit_endings, fold_of

#: Neighbouring lengths on either side against which a length is a spike.
NEIGHBOURS = 12
#: Cut values that a spike needs; a limit that cut fewer of a source's values shows nowhere.
LEAST_CUT = 5
#: A spike is so many times what its neighbours let expect.
TIMES = 8
#: Most open ends, and most sound values that are cut to teach; the documented bound of the fit.
FIT_ENDINGS = 10_000


def _made_cut(text: str) -> list[int] | None:
    """Features of a sound value cut at a place that follows from its text."""
    s = text.rstrip()
    if len(s) < 12:
        return None
    rng = random.Random(zlib.crc32(s.encode("utf-8", "surrogatepass")))
    part = s[: rng.randrange(min(16, len(s) - 1), len(s))]
    return cut_features(part) if final_mark(part) == OPEN else None


def measure(df: DataFrame, keys: list[str], text: str, prompt: str | None = None) -> DataFrame:
    """keys, part, n_chars, n_bytes, state, ends, made, fold: how each value ends and how long it is.

    ``part`` is ``answer`` where a sound object holds the text that may be cut, else ``value``.
    ``ends`` are the features of an open end; ``made`` those of a cut made in a closed value, for
    about FIT_ENDINGS of them, picked by a hash. Null texts give no row; blank texts and
    placeholders are closed, and so is a text that repeats its ``prompt``'s question.
    """
    asked = F.col(prompt) if prompt else F.lit(None).cast("string")
    flat = df.select(*keys, F.col(text).alias("body"), asked.alias("asked")).where("body is not null")
    taught = min(1.0, FIT_ENDINGS / max(1, flat.count()))
    made = flat.select(*keys).schema.add("part", "string")
    for name in ("n_chars", "n_bytes", "state"):
        made = made.add(name, "integer")
    made = made.add("ends", ArrayType(IntegerType())).add("made", ArrayType(IntegerType())).add("fold", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, q in zip(b["body"], b["asked"]):
                r = Reply(x)
                own = r.body if r.found is not None else x
                state = r.state
                if state == OPEN:
                    norm = normalise(own)
                    if not norm or norm in PLACEHOLDERS or q and (asks := normalise(question_of(q))) and norm.endswith(asks):
                        state = CLOSED
                teach = state == CLOSED and (zlib.crc32(x.encode("utf-8", "surrogatepass")) ^ 0x5BD1E995) / 2**32 < taught
                rows.append(("value" if r.found is None else "answer", len(own), len(own.encode("utf-8", "surrogatepass")), state, cut_features(own) if state == OPEN else None, _made_cut(own) if teach else None, fold_of(own)))
            out = b[keys].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["part", "n_chars", "n_bytes", "state", "ends", "made", "fold"])], axis=1)

    return flat.mapInPandas(run, made)


def length_limits(measured: DataFrame, by: list[str]) -> DataFrame:
    """Spikes of the open values' lengths: ``by`` columns, part, unit, length, n_open, expected.

    A limit is no shorter than a quarter of the source's closed values, and has cut LEAST_CUT values
    or more. Counts are made over all values with partial aggregation before the shuffle; the
    windows run over distinct lengths only.
    """
    unit = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(c).alias("length")) for u, c in (("chars", "n_chars"), ("bytes", "n_bytes"))]))
    counted = measured.where((F.col("state") != CLOSED) & (F.col("n_chars") > 0)).select(*by, "part", unit.alias("u")).groupBy(*by, "part", "u.unit", "u.length").agg(F.count("*").alias("n_open"))
    near = Window.partitionBy(*by, "part", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    counted = counted.withColumn("expected", (F.sum("n_open").over(near) - F.col("n_open")) / F.lit(2.0 * NEIGHBOURS))
    spikes = counted.where((F.col("n_open") >= LEAST_CUT) & (F.col("n_open") > F.col("expected") + 6 * F.sqrt("expected") + 3) & (F.col("n_open") > TIMES * F.col("expected")))
    usual = measured.where((F.col("state") == CLOSED) & (F.col("n_chars") > 0)).select(*by, "part", unit.alias("u")).groupBy(*by, "part", "u.unit").agg(F.percentile_approx("u.length", 0.25).alias("least"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}")) for c in (*by, "part", "unit")]
    joined = spikes.alias("s").join(usual.alias("u"), same, "left")
    return joined.where(F.col("s.length") >= F.coalesce("u.least", F.lit(0))).select("s.*")


def at_limits(measured: DataFrame, by: list[str]) -> DataFrame:
    """``measured`` with ``limit_unit``: chars or bytes where a value without a closing mark ends at a limit."""
    limits = length_limits(measured, by)
    opened = measured.where(F.col("state") != CLOSED)
    for u, length in (("chars", "n_chars"), ("bytes", "n_bytes")):
        own = limits.where(F.col("unit") == u).select(*[F.col(c).alias(f"l_{c}") for c in by], F.col("part").alias("l_part"), F.col("length").alias("l_len"), F.lit(u).alias(f"at_{u}"))
        same = (F.col("l_len") == F.col(length)) & (F.col("l_part") == F.col("part"))
        for c in by:
            same &= F.col(f"l_{c}").eqNullSafe(F.col(c))
        opened = opened.join(own, same, "left").drop("l_len", "l_part", *[f"l_{c}" for c in by])
    return opened.withColumn("limit_unit", F.coalesce("at_chars", "at_bytes")).drop("at_chars", "at_bytes")


def ending_model(measured: DataFrame, by: list[str]) -> Endings:
    """The model of endings, taught by the values at limits, about FIT_ENDINGS open ends and as many made cuts.

    Open ends are picked by a hash of what they look like, made cuts by a hash of their texts.
    """
    opened = at_limits(measured, by).where("ends is not null")
    few = F.least(F.lit(1.0), FIT_ENDINGS / F.greatest(F.lit(1), F.lit(measured.where("ends is not null").count())))
    order = (F.xxhash64("ends", "n_chars", "fold") / F.lit(2.0**64)) + F.lit(0.5)
    rows = opened.where(order <= few).select("ends", "fold", F.col("limit_unit").isNotNull().alias("cut")).limit(2 * FIT_ENDINGS).toPandas()
    rows = rows.assign(at=rows["ends"].map(tuple)).sort_values(["at", "fold", "cut"])
    made = measured.where("made is not null").select("made").limit(2 * FIT_ENDINGS).toPandas()["made"].map(tuple).sort_values()
    return fit_endings(np.array(rows["at"].tolist(), dtype=np.int64).reshape(-1, WIDTH), rows["fold"].to_numpy(dtype=np.int64), rows["cut"].to_numpy(dtype=bool), np.array(made.tolist(), dtype=np.int64).reshape(-1, WIDTH))


def cut_values(measured: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """keys, by, ``limit_unit``, ``transfer`` and ``log_odds`` of the values that are cut.

    ``limit_unit`` is chars or bytes where the length says so, else null; ``transfer`` says that the
    end itself does: a broken character or object, or an open end that the model takes for a cut.
    Nulls and blanks are no cases. Equal rows each give a row. A null source is a source. Empty
    tables give no rows.
    """
    model = ending_model(measured, by)
    shared = measured.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.common))  # of fixed size
    out = at_limits(measured, by)
    names = list(dict.fromkeys([*keys, *by]))
    flat = out.select(*names, "state", "limit_unit", "ends", "fold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Endings(*shared.value)
        for b in batches:
            odds = np.full(len(b), np.nan)
            at = np.flatnonzero(b["ends"].notna().to_numpy())
            if len(at):
                odds[at] = held.score(np.array(b["ends"].iloc[at].tolist(), dtype=np.int64), b["fold"].to_numpy(dtype=np.int64)[at])
            made = b[[*names, "limit_unit"]].copy()
            made["transfer"] = (b["state"] == BROKEN).to_numpy() | (np.nan_to_num(odds, nan=-1.0) > 0)
            made["log_odds"] = np.round(odds, 6)
            yield made[made["transfer"] | made["limit_unit"].notna()]

    return flat.mapInPandas(run, flat.select(*names, "limit_unit").schema.add("transfer", "boolean").add("log_odds", "double"))
