"""Score fusion: a class-balanced logistic model on log(1 + score) of several channels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.functions import failure_floor
from pairlight.scratch import keep

RIDGE, STEPS, SETTLED = 1e-9, 100, 1e-12


def align_channels(channels: dict[str, DataFrame], keys: list[str], carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, carry and a score column for each channel, one row a pair; channels that list different pairs are an error.

    Pairs are the same by ``keys``, null keys equal to null keys; ``carry`` is taken
    from the first channel. Keys that are numbers make the joins cheap.
    """
    joined, first = None, next(iter(channels))
    for name, df in channels.items():
        renamed = [F.col(k).alias(f"{k}__{name}") for k in keys]
        part = df.select(*renamed, *(carry if name == first else ()), F.col("score").cast("double").alias(name), F.lit(True).alias(f"has_{name}"))
        if joined is None:
            joined = part
            continue
        joined = joined.join(part, reduce(lambda a, b: a & b, [F.col(f"{k}__{first}").eqNullSafe(F.col(f"{k}__{name}")) for k in keys]), "full_outer")
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"has_{name}"), F.lit(False)) for name in channels])
    same = F.when(whole, True).otherwise(F.raise_error(F.lit("the channels do not list identical pairs")).cast("boolean"))
    return joined.where(same).select(*[F.col(f"{k}__{first}").alias(k) for k in keys], *carry, *channels)


def floors(fit: DataFrame, channels: list[str]) -> dict[str, float]:
    """The lowest score of each channel on the fit rows: one row of numbers."""
    row = fit.agg(*[F.min(c).alias(c) for c in channels]).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in channels}


def with_features(scores: DataFrame, channels: list[str], low: dict[str, float]) -> DataFrame:
    return scores.select("*", *[failure_floor(F.col(c), F.lit(low[c])).alias(f"x_{c}") for c in channels])


def fit_logistic(rows: DataFrame, features: list[str], label: str, n: str | None = None) -> np.ndarray:
    """Weights, the bias last, by Newton's method; both classes weigh the same in total. ``n`` may name how many rows a row stands for.

    Equal rows are counted once and written. Every step is one aggregate of the
    gradient and of the Hessian's upper half over the counts, so only these few sums
    reach the driver.
    """
    rows = keep(rows.groupBy(*features, F.col(label).alias("__y")).agg(F.sum(F.col(n) if n else F.lit(1)).cast("double").alias("__n")), "fit-rows")
    label, many = "__y", F.col("__n")
    names = [*features, None]
    x = [F.col(c) if c else F.lit(1.0) for c in names]
    y = F.col(label).cast("double")
    counts = rows.agg(F.sum(y * many).alias("p"), F.sum((1 - y) * many).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        raise ValueError("both classes are needed")
    share = F.when(y == 1, 0.5 / counts["p"]).otherwise(0.5 / counts["n"]) * many
    w = np.zeros(len(x))
    for _ in range(STEPS):
        z = F.lit(0.0)
        for value, column in zip(w, x):
            z = z + F.lit(float(value)) * column
        scored = rows.select(*features, y.alias("y"), share.alias("share"), (1 / (1 + F.exp(-z))).alias("p"))
        column = lambda c: F.col(c) if c else F.lit(1.0)
        gradient = [F.sum(F.col("share") * (F.col("p") - F.col("y")) * column(c)) for c in names]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        hessian = [F.sum(F.col("share") * F.col("p") * (1 - F.col("p")) * column(names[i]) * column(names[j])) for i, j in pairs]
        sums = scored.agg(*[s.alias(f"s{k}") for k, s in enumerate(gradient + hessian)]).first()
        g, h = np.array(sums[: len(names)]) + RIDGE * w, np.zeros((len(names), len(names)))
        for (i, j), s in zip(pairs, sums[len(names) :]):
            h[i, j] = h[j, i] = s
        step = np.linalg.solve(h + RIDGE * np.eye(len(names)), g)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    return w


def fused(scores: DataFrame, channels: list[str], low: dict[str, float], weights) -> DataFrame:
    """``scores`` with fused: the weighted features without the bias."""
    total: Column = F.lit(0.0)
    for c, w in zip(channels, weights):
        total = total + F.lit(float(w)) * F.col(f"x_{c}")
    return with_features(scores, channels, low).withColumn("fused", total).drop(*[f"x_{c}" for c in channels])


def best_marks(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """``results`` with best: whether a row has its group's greatest value; ties are all marked."""
    return results.withColumn("best", F.col(value) == F.max(value).over(Window.partitionBy(*by)))
