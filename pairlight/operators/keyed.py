"""Keyed ranking, sampling and splitting: order by a hash of seed, purpose and key.

The order depends on the keys alone, not on how rows are partitioned or sorted,
so reruns and other engines get the same samples. Ranks inside a group that are
filtered to a prefix are planned as a per-partition limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.functions import keyed_hash, round_half_even
from pairlight.scratch import keep


def offsets(rows: DataFrame, order: list[str], count: str | None = None) -> DataFrame:
    """``rows`` with offset: how many rows, or how much of ``count``, come before in ``order``; ``count`` is dropped.

    Rows are dealt by range and numbered inside their partition; only one row a
    partition meets to add up what the partitions before it hold. The ranges are
    sampled once, so the dealt rows are written before they are used twice.
    """
    size = F.col(count) if count else F.lit(1)
    dealt = keep(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.sum(size).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("__inside", inside).join(totals.select("__part", before.alias("__before")), "__part")
    return placed.withColumn("offset", (F.col("__inside") + F.col("__before")).cast("long")).drop("__part", "__inside", "__before", *([count] if count else []))


def keyed_rank(df: DataFrame, seed: str, purpose: Column | str, key: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with its 1-based keyed rank inside each group of ``by``; ties of the hash fall back to the key."""
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy(keyed_hash(seed, purpose, key), key)
    return df.withColumn(name, F.row_number().over(group))


def keyed_top(df: DataFrame, seed: str, purpose: str, key: Column, k: int, before: str | None = None) -> DataFrame:
    """The first k rows in keyed order, or by column ``before`` and then in keyed order, over the whole table; a distributed top-k, not a sort."""
    return df.orderBy(*([before] if before else []), keyed_hash(seed, purpose, key), key).limit(k)


def last_hash(k: int, size: Column) -> Column:
    """A text that no hash of the first k of ``size`` rows in keyed order is beyond.

    Hashes are uniform; that more than those of a few more than k rows should be needed
    is less likely than a failing machine, and ``keyed_sample`` makes it an error.
    """
    share = F.lit(k + 12 * k**0.5 + 40) / size
    digits = F.lpad(F.lower(F.hex(F.floor(share * F.lit(float(2**52))))), 13, "0")
    return F.concat(F.when(share >= 1, "").otherwise(digits), F.lit("g"))  # beyond the digits of any hash that begins so


def keyed_sample(df: DataFrame, seed: str, purpose: Column | str, key: Column, by: list[str], k: int, exact: bool = True, size: str | None = None) -> DataFrame:
    """The first k rows of each group in keyed order. With ``exact`` a group of fewer than k rows is an error.

    ``size`` may name a column with the number of rows of the row's group. Rows beyond
    ``last_hash`` are then left out by their hash alone, before anything is shuffled or
    sorted; a group left short by it would be an error.
    """
    expected = F.lit(k) if exact else F.lit(0)
    if size:
        df = df.where(keyed_hash(seed, purpose, key) <= last_hash(k, F.col(size)))
        expected = F.lit(k) if exact else F.least(F.lit(k), F.col(size))
    kept = keyed_rank(df, seed, purpose, key, by).where(F.col("rank") <= k)
    if exact or size:
        kept = kept.withColumn("last", F.max("rank").over(Window.partitionBy(*by)))
        short = F.concat_ws(" ", F.lit("a group has fewer candidates than asked for:"), *[F.col(c).cast("string") for c in by])
        # a filter, so that pruning columns cannot drop the check
        kept = kept.where(F.when(F.col("last") < expected, F.raise_error(short).cast("boolean")).otherwise(True)).drop("last")
    return kept.drop(size) if size else kept


def stratified_split(strata: DataFrame, seed: str, fraction: float, prefix: str = "split") -> DataFrame:
    """``strata`` (subject, stratum) with half: the first round-half-even share of each stratum is dev, the rest test."""
    ranked = keyed_rank(strata, seed, F.concat(F.lit(f"{prefix}:"), F.col("stratum")), F.col("subject"), ["stratum"])
    size = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    return ranked.withColumn("half", F.when(F.col("rank") <= round_half_even(size * fraction), "dev").otherwise("test")).drop("rank")


def has_r_strata(manifest: DataFrame) -> DataFrame:
    """subject, stratum: whether a subject of U, V or R has any R image, excluded ones included."""
    return (
        manifest.where(F.col("set").isin("U", "V", "R")).groupBy("subject")
        .agg(F.when(F.max(F.col("set") == "R"), "has_R").otherwise("no_R").alias("stratum"))
    )


def development_split(manifest: DataFrame, seed: str, fraction: float = 0.5) -> DataFrame:
    """subject, stratum, half."""
    return stratified_split(has_r_strata(manifest), seed, fraction)


def train_validation_split(manifest: DataFrame, seed: str, fraction: float = 0.5, share: float = 0.2) -> DataFrame:
    """Development subjects with role: a share of each stratum validates, the rest trains."""
    dev = development_split(manifest, seed, fraction).where("half = 'dev'").select("subject", "stratum")
    split = stratified_split(dev, seed, share, "method-validation")
    return split.select("subject", "stratum", F.when(F.col("half") == "dev", "validation").otherwise("train").alias("role"))
