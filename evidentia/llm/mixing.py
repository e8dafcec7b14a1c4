"""Mixing sources to target weights by the cube method (operator 8).

Every source gets a target of words. Its rate, target over size, splits into
whole copies that every document gets and a fraction that only some get. The
cube method picks those: the fractional inclusion probabilities move along the
null space of two constraints, the source's words and its documents, until
each is 0 or 1 but for two at most. Blocks of bounded size fly independently
on all workers, each leaving out a pool of rows of all sizes; these and what
else stays fractional fly again in blocks, level by level, until one block a
source is left; the dozen rows that remain land where the words come nearest
to the target.

The random walk is a function of keys and sizes, so reruns agree.

Defined results: a null text has size 0; documents of size 0 may be picked but
take no words; a null source is a source of its own, last in order; repeated
rows are drawn one by one; an empty table gives an empty mix; further columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import apart, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
BLOCK = 2000
POOL = 10
SEED = 20_240_613


def allot(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Target words of each source: share of all words by weight, cut at limit times the size, the excess shared again."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    most = {s: limit * n for s, n in ordered}
    total = share * sum(n for _, n in ordered)
    full: dict[str | None, float] = {}
    while len(full) < len(most):
        left = total - sum(full.values())
        heavy = sum(w for s, w in weight.items() if s not in full)
        target = {s: left * weight[s] / heavy for s in most if s not in full}
        over = [s for s, t in target.items() if t > most[s]]
        if not over:
            return full | target
        full |= {s: most[s] for s in over}
    return full


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 0) -> np.ndarray:
    """The inclusion probabilities after the flight phase; but for the last keep rows, two are still fractional at most.

    Three fractional rows at a time move along the null vector of their counts
    and sizes, so both totals are kept and at least one row settles each step.
    """
    pi = pi.copy()
    eps = 1e-9
    todo = [i for i in range(len(pi) - keep) if eps < pi[i] < 1 - eps]
    todo.reverse()
    held: list[int] = []
    draws = iter(rng.random(len(todo) + 1))
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            break
        a, b, c = (float(size[i]) for i in held)
        u = (b - c, c - a, a - b)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            pi[i] = min(1.0, max(0.0, pi[i] + step * x))
        held = [i for i in held if eps < pi[i] < 1 - eps]
    return pi


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the last few rows where the words, then the documents, come nearest to what is expected."""
    open_ = [i for i in range(len(pi)) if 1e-9 < pi[i] < 1 - 1e-9]
    words, count = float((pi[open_] * size[open_]).sum()), float(pi[open_].sum())
    masks = np.arange(1 << len(open_))
    taken = (masks[:, None] >> np.arange(len(open_))) & 1
    # a document too many or too few weighs as much as a hundredth of its mean size in words
    off = np.abs(taken @ size[open_] - words) + np.abs(taken.sum(1) - count) * (size[open_].mean() / 100 if open_ else 0)
    best = int(off.argmin())
    out = np.rint(pi)
    for j, i in enumerate(open_):
        out[i] = best >> j & 1
    return out


def _flown(final: bool):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie"], ascending=[False, True], kind="stable", ignore_index=True)
        pool = np.unique(np.linspace(0, len(rows) - 1, min(POOL, len(rows))).astype(int))
        rows = rows.iloc[np.r_[np.setdiff1d(np.arange(len(rows)), pool), pool]].reset_index(drop=True)
        size = rows["size"].to_numpy()
        # the walk is seeded with what it walks over, never with a partition's number
        rng = np.random.default_rng([SEED, len(rows), int(size.sum()), int(rows["rank"].iloc[0]), int(rows["block"].iloc[0])])
        pi = flight(rows["pi"].to_numpy(), size, rng, len(pool))
        rows["pi"] = land(pi, size) if final else pi
        return rows

    return fly


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size): words of each row."""
    return df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_sources(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, copies) for each row of df.

    Per-source totals come to the driver: one row a source, as many as the
    mix has entries to configure.
    """
    rows, _ = stored(spark, sized(df, key, text, source), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    target = allot([(t["source"], t["n"]) for t in totals])
    plan = []
    for rank, t in enumerate(sorted(totals, key=lambda t: (t["source"] is None, t["source"] or ""))):
        rate = target[t["source"]] / t["n"] if t["n"] else 0.0
        plan.append((t["source"], int(t["n"]), float(target[t["source"]]), int(rate), float(rate - int(rate)), rank, max(1, -(-t["rows"] // BLOCK))))
    plan_df = spark.createDataFrame(plan, "plan_source string, source_size long, target double, whole int, frac double, rank int, blocks int")
    at = F.broadcast(plan_df) if len(plan) < 10_000 else plan_df
    tie = F.xxhash64("key", "size")
    units = rows.join(at, rows["source"].eqNullSafe(at["plan_source"])).select("key", "source", "size", "source_size", "target", "whole", "rank", tie.alias("tie"), F.pmod(tie, F.col("blocks")).cast("int").alias("block"), F.col("frac").alias("pi"))
    schema = units.schema
    fractional = (F.col("pi") > 1e-9) & (F.col("pi") < 1 - 1e-9)
    done, level = None, 0
    while True:
        flown, _ = stored(spark, units.groupBy("rank", "block").applyInPandas(_flown(False), schema), "mix-flown")
        settled = flown.where(~fractional)
        done = settled if done is None else done.unionByName(settled)
        rest = flown.where(fractional)
        left = {r["rank"]: r["count"] for r in rest.groupBy("rank").count().collect()}
        if max(left.values(), default=0) <= BLOCK:
            break
        # what the blocks left flies once more in blocks, a hundredth of the rows at each level
        level += 1
        blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r, n in left.items() for x in (r, -(-n // BLOCK))]), F.col("rank")), F.lit(1))
        units = rest.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(level)), blocks).cast("int"))
    last = rest.withColumn("block", F.lit(0)).groupBy("rank").applyInPandas(_flown(True), schema)
    done = done.unionByName(last)
    return done.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("whole") + F.rint("pi")).cast("int").alias("copies"))


def mixed(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df as often as the mix takes them, with df's columns.

    Rows that agree in key, source and size are interchangeable and numbered,
    so each gets its own count. Of each source most rows are taken equally
    often; a filter of fixed size tells which rows may differ, and only those
    are joined with their counts, so the others' texts need no exchange.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    picks = mix_sources(spark, df, key, text, source).select(F.col(key).alias("__k"), F.col("source").alias("__s"), F.col("size").alias("__n"), "copies", F.floor(rate + 0.5).alias("usual"))
    by = picks.groupBy("__k", "__s", "__n").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"), F.max("copies").alias("__most"), F.min("usual").alias("__usual"))
    by, _ = stored(spark, by, "mix-picks")
    usual, _ = stored(spark, by.groupBy(F.col("__s").alias("__of")).agg(F.min("__usual").alias("__each")), "mix-usual")
    few = usual.count() < 10_000
    odd = by.where(F.col("__copies") != F.col("__usual") * F.col("__rows")).drop("__usual")
    named = F.col(source).cast("string")
    rows = df.join(F.broadcast(usual) if few else usual, named.eqNullSafe(F.col("__of")), "left").select(*df.columns, "__each")
    most, some = apart(rows, F.xxhash64(F.col(key), named), odd.select(F.xxhash64("__k", "__s").alias("h")))
    some = some.withColumn("__n2", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    same = some[key].eqNullSafe(odd["__k"]) & some[source].cast("string").eqNullSafe(odd["__s"]) & (some["__n2"] == odd["__n"])
    some = some.join(odd, same, "left")
    if odd.where("__rows > 1").isEmpty():
        own = F.coalesce("__copies", "__each")
    else:
        one = Window.partitionBy("__k", "__s", "__n").orderBy(F.xxhash64(text))
        repeated = some.where("__rows > 1").withColumn("__r", F.row_number().over(one))
        some = some.where("coalesce(__rows, 1) = 1").withColumn("__r", F.lit(1)).unionByName(repeated)
        own = F.when(F.col("__rows") > 1, F.least(F.col("__most").cast("long"), F.col("__copies") - (F.col("__r") - 1) * F.col("__most"))).otherwise(F.coalesce("__copies", "__each"))
    taken = most.withColumn("__own", F.col("__each")).select(*df.columns, "__own").unionByName(some.withColumn("__own", own).select(*df.columns, "__own"))
    return taken.where("__own > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__own").cast("int")))).select(*df.columns)
