"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def keyed_start(seed: str, purpose: Column | str) -> Column:
    """What ``keyed_hash`` hashes before the item."""
    return F.concat(F.lit(seed + SEPARATOR), F.lit(purpose) if isinstance(purpose, str) else purpose, F.lit(SEPARATOR))


def keyed_hash(seed: str, purpose: Column | str, item: Column) -> Column:
    """SHA-256 in hex of seed, purpose and item, joined by U+001F."""
    return F.sha2(F.concat(keyed_start(seed, purpose), item), 256)


def image_id(set_code: Column, subject: Column, frgp: Column) -> Column:
    return F.format_string("%s_%s_%02d", set_code, subject, frgp)


def subject_of(image: Column) -> Column:
    """The second part of an image id."""
    return F.split_part(image, F.lit("_"), F.lit(2))


def set_of(image: Column) -> Column:
    """The set code that an image id starts with."""
    return F.substring(image, 1, 1)


def far_label(target: float) -> str:
    return f"{target * 100:g}%"


def failure_floor(score: Column, floor: Column) -> Column:
    """log(1 + score); a failed comparison takes the floor of its channel."""
    return F.log1p(F.coalesce(score, floor))


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def probit(p: Column) -> Column:
    """Inverse normal distribution, good to 4.5e-4 (Abramowitz and Stegun 26.2.23): enough for axes. 0 and 1 give infinities."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    tail = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    x = F.when(p < 0.5, -tail).otherwise(tail)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(x)
