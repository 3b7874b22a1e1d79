"""A join of many rows to one row a key that also spreads keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot beyond HOT_ROWS rows and beyond one in SHARE of all, so at most SHARE keys are hot, and their salts are at most twice as many.
HOT_ROWS, SHARE = 128, 10_000


def spread_join(rows: DataFrame, named: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` to ``named``, one row a key, whose column ``count`` says how many of ``rows`` have it.

    Rows of a hot key are dealt by their other columns to as many tasks as they
    fill and meet a copy of their key's row there. Only the hot keys themselves,
    SHARE at most, are broadcast. Null keys find nothing; ``how`` is inner or left.
    ``count`` is dropped. ``named`` is read twice, so let it be a written table or
    cheap.
    """
    top = named.agg(F.coalesce(F.sum(count) / SHARE, F.lit(0.0)).alias("share"), F.coalesce(F.max(count), F.lit(0)).alias("most")).first()
    limit = max(float(HOT_ROWS), top["share"])
    if top["most"] <= limit:
        return rows.join(named.drop(count), key, how)
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = F.broadcast(named.where(F.col(count) > F.lit(limit)).limit(SHARE).select(key, salts.alias("__salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns, F.lit("salt")), F.col("__salts")), F.lit(0)).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    copies = F.when(F.col(count) > F.lit(limit), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(named.withColumn("__salt", F.explode(copies)).drop(count), [key, "__salt"], how).drop("__salt")


def once(rows: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with those of one ``key`` fewer, if any key has very many: before a shuffle every task drops what it has already. ``listed`` has the same keys."""
    many = listed.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHARE).limit(1).count()
    return rows.dropDuplicates(key) if many else rows
