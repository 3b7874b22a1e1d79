"""Error rates from scored pairs.

A score table has group columns, kind (genuine or impostor) and a nullable score.
A null score is a failed comparison: never accepted, always counted. Scores are
first counted by value, so windows run over distinct scores and not over pairs;
running sums go through bins of scores, so no task has to hold all the distinct
scores of a group, which with continuous scores are as many as the pairs.
Acceptance is strictly above a threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILED = float("-inf")
#: Bins of scores for each doubling of a score.
FINE = 512


def grid(scores: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, score, genuine, impostor: weights at each distinct score; failures at -Infinity, which is always there."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    at = F.coalesce(F.col("score").cast("double"), F.lit(FAILED)).alias("score")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, w).otherwise(0.0)).alias(kind)
    counted = scores.groupBy(*by, at).agg(of("genuine"), of("impostor"))
    floor = F.struct(F.lit(FAILED).alias("score"), F.lit(0.0).alias("genuine"), F.lit(0.0).alias("impostor"))
    # beside each row, and combined in its task, so that the pairs are not gone over again for it
    each = counted.select(*by, F.explode(F.array(F.struct("score", "genuine", "impostor"), floor)).alias("x")).select(*by, "x.*")
    return each.groupBy(*by, "score").agg(F.sum("genuine").alias("genuine"), F.sum("impostor").alias("impostor"))


def score_bin(score: Column) -> Column:
    """A whole number that never falls as the score rises: ``FINE`` steps a doubling on each side of 0; NaN, which sorts last, has the highest."""
    size = F.greatest(F.lit(-1080.0), F.least(F.lit(1030.0), F.log2(F.abs(score))))
    step = F.floor((size + 1100) * FINE).cast("long")
    return F.when(F.isnan(score), F.lit(1 << 40)).when(score == 0, F.lit(0)).when(score < 0, -step).otherwise(step)


def running(table: DataFrame, by: list[str], score: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``table``, one row a score in each group of ``by``, with {c}_before and {c}_total of each of ``columns``: the sum before the row in order of score, and the group's.

    Two levels: a window over the bins' sums, and one inside each bin.
    """
    down = lambda name: F.col(name).desc() if descending else F.col(name).asc()
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    binned = table.withColumn("__bin", score_bin(F.col(score).cast("double")))
    sums = binned.groupBy(*by, "__bin").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = group.orderBy(down("__bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    bins = sums.select(
        F.struct(*by, "__bin").alias("__cell"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in columns],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in columns],
    )
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__cell.`{c}`")) for c in (*by, "__bin")]
    inside = Window.partitionBy(*by, "__bin").orderBy(down(score)).rowsBetween(Window.unboundedPreceding, -1)
    joined = binned.join(bins, reduce(lambda a, b: a & b, same)).drop("__cell")
    for c in columns:
        joined = joined.withColumn(f"{c}_before", F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return joined.drop("__bin", *[f"__{c}" for c in columns])


def rates(grid_table: DataFrame, by: list[str]) -> DataFrame:
    """by, score (the threshold), genuine, impostor, genuine_above, impostor_above, genuine_total, impostor_total, far, frr."""
    out = running(grid_table, by, "score", ["genuine", "impostor"], descending=True)
    out = out.withColumnsRenamed({"genuine_before": "genuine_above", "impostor_before": "impostor_above"})
    far = F.when(F.col("impostor_total") > 0, F.col("impostor_above") / F.col("impostor_total"))
    frr = F.when(F.col("genuine_total") > 0, 1 - F.col("genuine_above") / F.col("genuine_total"))
    return out.withColumn("far", far).withColumn("frr", frr)


def tar_at_far(rate_table: DataFrame, by: list[str], targets: tuple[float, ...]) -> DataFrame:
    """by, far_target, threshold (null: all scored pairs), counts, tar, frr, far at the lowest threshold within each target."""
    each = rate_table.withColumn("far_target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    total = F.col("impostor_total")
    allowed = F.col("impostor_above") <= F.col("far_target") * total + 1e-9 * F.greatest(F.lit(1.0), total)
    best = each.where(allowed).groupBy(*by, "far_target").agg(F.min_by(F.struct("score", "genuine_above", "impostor_above", "genuine_total", "impostor_total", "far", "frr"), "score").alias("b"))
    return best.select(
        *by, "far_target", F.when(F.col("b.score") != FAILED, F.col("b.score")).alias("threshold"),
        F.col("b.genuine_total").cast("long").alias("genuine"), F.round("b.genuine_above").cast("long").alias("true_accepts"),
        F.round(F.col("b.genuine_total") - F.col("b.genuine_above")).cast("long").alias("false_rejects"),
        F.col("b.impostor_total").cast("long").alias("impostor"), F.round("b.impostor_above").cast("long").alias("false_accepts"),
        (1 - F.col("b.frr")).alias("tar"), F.col("b.frr").alias("frr"), F.col("b.far").alias("far"),
    )


def eer(rate_table: DataFrame, by: list[str]) -> DataFrame:
    """by, eer: where the rates meet, interpolated between the thresholds around the first crossing.

    As the threshold falls the gap between the rates never does, so the threshold
    before the crossing is the lowest with a gap below 0.
    """
    points = rate_table.withColumn("gap", F.col("far") - F.col("frr")).withColumn("mean", (F.col("far") + F.col("frr")) / 2)
    point = F.struct("far", "gap", "mean")
    at = points.groupBy(*by).agg(
        F.max_by(F.when(F.col("gap") >= 0, point), F.when(F.col("gap") >= 0, F.col("score"))).alias("one"),
        F.min_by(F.when(F.col("gap") < 0, point), F.when(F.col("gap") < 0, F.col("score"))).alias("zero"), F.min_by("mean", "score").alias("last"),
    )
    between = F.col("zero.far") + F.col("zero.gap") / (F.col("zero.gap") - F.col("one.gap")) * (F.col("one.far") - F.col("zero.far"))
    return at.select(*by, F.coalesce(F.when(F.col("zero").isNull(), F.col("one.mean")).otherwise(between), F.col("last")).alias("eer"))


def auc(scores: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, auc: chance that a genuine score exceeds an impostor one, ties half; null scores are left out, an empty class is an error."""
    counted = grid(scores.where(F.col("score").isNotNull()), by, weight)
    won = running(counted, by, "score", ["impostor"]).withColumn("won", F.col("genuine") * (F.col("impostor_before") + F.col("impostor") / 2))
    total = F.sum("genuine") * F.sum("impostor")
    return won.groupBy(*by).agg(F.when(total > 0, F.sum("won") / total).otherwise(F.raise_error(F.lit("both classes are needed")).cast("double")).alias("auc"))


def no_false_accept_point(scores: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, threshold, genuine, true_accepts, false_rejects, impostor, tar, frr: accepted only above every impostor score; ``weight`` is how many pairs a row stands for."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counted = scores.groupBy(*by, "kind", "score").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    top = F.max(F.when(F.col("kind") == "impostor", F.col("score").cast("double"))).over(group)
    accepted = F.col("score").isNotNull() & (F.col("top").isNull() | (F.col("score") > F.col("top")))
    genuine = F.col("kind") == "genuine"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        counted.withColumn("top", top).groupBy(*by)
        .agg(F.max("top").alias("threshold"), total(genuine).alias("genuine"), total(genuine & accepted).alias("true_accepts"), total(~genuine).alias("impostor"))
        .withColumn("false_rejects", F.col("genuine") - F.col("true_accepts"))
        .withColumn("tar", F.when(F.col("genuine") > 0, F.col("true_accepts") / F.col("genuine"))).withColumn("frr", 1 - F.col("tar"))
    )


def accepts_by_finger(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, frgp, accepted: "accepted/total" of the genuine pairs at the strictest point."""
    tops = scores.where("kind = 'impostor'").groupBy(*by).agg(F.max("score").alias("top"))
    fingers = scores.where("kind = 'genuine'").join(tops, by, "left")
    accepted = F.col("score").isNotNull() & (F.col("top").isNull() | (F.col("score") > F.col("top")))
    return fingers.groupBy(*by, "frgp").agg(F.concat_ws("/", F.count_if(accepted).cast("string"), F.count(F.lit(1)).cast("string")).alias("accepted"))


def summary(values: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """by, count, mean, median, p95 (nearest rank, half-even), min, max of the values that are not null; ``weight`` is how many a row stands for."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    placed = running(counted, by, "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n")).withColumnRenamed("n_total", "total")
    rank = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))  # noqa: E731  the r-th smallest
    p95 = F.greatest(F.lit(1), F.least(F.col("total"), F.bround(F.col("total") * 0.95).cast("long")))
    return (
        placed.groupBy(*by)
        .agg(
            F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
            ((rank(F.floor((F.col("total") + 1) / 2)) + rank(F.ceil((F.col("total") + 1) / 2))) / 2).alias("median"),
            rank(p95).alias("p95"), F.min("v").alias("min"), F.max("v").alias("max"),
        )
    )


def share_threshold(scores: DataFrame, share: float, by: list[str] | tuple[str, ...] = (), n: str | None = None) -> DataFrame:
    """by, threshold: the lowest that at most ``share`` of the scores lie above; -Infinity where all may. ``n`` may name how many scores a row stands for."""
    counted = scores.groupBy(*by, F.coalesce(F.col("score").cast("double"), F.lit(FAILED)).alias("score")).agg(F.sum(F.col(n) if n else F.lit(1)).alias("n"))
    placed = running(counted, by, "score", ["n"], descending=True)
    marked = placed.withColumn("allowed", F.floor(F.col("n_total") * F.lit(float(share)) + 1e-9)).withColumn("upto", F.col("n_before") + F.col("n"))
    found = F.max(F.when(F.col("upto") > F.col("allowed"), F.col("score")))
    return marked.groupBy(*by).agg(F.coalesce(found, F.lit(FAILED)).alias("threshold"))


def operational(fit: DataFrame, test: DataFrame, by: list[str], target: float, weight: str | None = None) -> DataFrame:
    """The threshold that ``fit`` sets at ``target``, and what it accepts of ``test``; ``weight`` names a column of counts of equal scores."""
    n = F.col(weight) if weight else F.lit(1)
    set_ = tar_at_far(rates(grid(fit, by, n), by), by, (target,)).select(*by, F.coalesce("threshold", F.lit(FAILED)).alias("threshold"))
    over = F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))
    genuine = F.col("kind") == "genuine"
    total = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("long")
    return (
        test.join(set_, by).groupBy(*by)
        .agg(
            F.max("threshold").alias("threshold"), total(genuine & over).alias("true_accepts"), total(genuine).alias("genuine"),
            total(~genuine & over).alias("false_accepts"), total(~genuine).alias("impostor"),
        )
        .withColumn("tar", F.when(F.col("genuine") > 0, F.col("true_accepts") / F.col("genuine")))
        .withColumn("far", F.when(F.col("impostor") > 0, F.col("false_accepts") / F.col("impostor")))
    )


def result_tables(scores: DataFrame, by: list[str], targets: tuple[float, ...], weight: Column | None = None) -> DataFrame:
    """tar_at_far of every group and target, with the group's number of failures; ``weight`` is how many pairs a row stands for."""
    n = F.lit(1) if weight is None else weight
    failures = scores.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("score").isNull(), n)), F.lit(0)).cast("long").alias("failures"))
    return tar_at_far(rates(grid(scores, by, weight), by), by, targets).join(failures, by)


def det_points(rate_table: DataFrame, by: list[str], most: int = 3000) -> DataFrame:
    """by, k, far, frr: the curve's inner points (no rate 0 or 1), thinned to ``most`` evenly spaced ones, first and last kept."""
    inner = rate_table.where("far > 0 and far < 1 and frr > 0 and frr < 1").withColumn("one", F.lit(1).cast("long"))
    numbered = running(inner, by, "score", ["one"], descending=True).withColumnRenamed("one_before", "k").withColumn("last", F.col("one_total") - 1)
    step = F.col("last") / F.lit(float(most - 1))
    picked = F.floor(F.ceil(F.col("k") / step) * step) == F.col("k")
    return numbered.where((F.col("last") < most) | picked).select(*by, F.col("k").cast("long").alias("k"), "far", "frr")
