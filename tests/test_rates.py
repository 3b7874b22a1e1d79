import numpy as np
import pytest

from pairlight.functions import far_label, probit
from pairlight.operators import rates
from tests.core_helpers import scores


def at_far(spark, genuine, impostor, far):
    return rates.tar_at_far(rates.rates(rates.grid(scores(spark, genuine, impostor), ["scenario"]), ["scenario"]), ["scenario"], (far,)).first()


def test_small_lists_by_hand(spark):
    """Ten impostors allow one of them at 10 %: the threshold is the second score from above, and failures count but never pass."""
    r = at_far(spark, [31, 17, 44, None, 90], [8, 12, 25, 3, 30, 11, 2, 19, None, 6], 0.1)
    assert (r.threshold, r.false_accepts, r.true_accepts, r.false_rejects, r.genuine, r.impostor) == (25, 1, 3, 2, 5, 10)
    r = at_far(spark, [13, 14], [13] * 4 + [2] * 36, 0.05)  # all four ties or none
    assert (r.threshold, r.false_accepts, r.tar) == (13, 0, 0.5)
    r = at_far(spark, [0.25, None, -3], [None, -7], 1.0)
    assert (r.threshold, r.false_accepts, r.true_accepts) == (None, 1, 2)
    genuine, impostor = [61, 48, None, 70, 52], [49, None, 33, 51]
    r, strict = at_far(spark, genuine, impostor, 0.0), rates.no_false_accept_point(scores(spark, genuine, impostor), ["scenario"]).first()
    assert (r.threshold, r.true_accepts) == (strict.threshold, strict.true_accepts) == (51, 3)


def brute(genuine, impostor, far):
    allowed = int(np.floor(far * len(impostor) + 1e-9))
    scored = sorted((s for s in impostor if s is not None), reverse=True)
    top = scored[allowed] if allowed < len(scored) else None
    over = lambda x: sum(s is not None and (top is None or s > top) for s in x)
    return top, over(genuine), over(impostor)


@pytest.mark.parametrize("levels", [7, 250, 10**6])
def test_thresholds_equal_brute_force(spark, levels):
    """Few, some and next to no ties."""
    r = np.random.default_rng(levels)
    draw = lambda n, shift, lost: [None if r.random() < lost else float(np.floor(levels * min(0.999, r.beta(2 + shift, 5)))) for _ in range(n)]
    genuine, impostor = draw(140, 4, 0.03), draw(2600, 0, 0.01)
    for far in (0.0, 0.0007, 0.013, 0.45):
        got = at_far(spark, genuine, impostor, far)
        top, accepts, false = brute(genuine, impostor, far)
        assert (got.threshold, got.true_accepts, got.false_accepts) == (top, accepts, false)


def test_auc_is_the_share_of_ordered_pairs(spark):
    r = np.random.default_rng(77)
    for spread in (1, 3, 40):
        genuine, impostor = (r.integers(0, spread, 30) + 1).tolist(), r.integers(0, spread, 50).tolist()
        want = np.mean([(g > i) + 0.5 * (g == i) for g in genuine for i in impostor])
        assert abs(rates.auc(scores(spark, genuine, impostor), ["scenario"]).first().auc - want) < 1e-12


def test_auc_needs_both_classes(spark):
    with pytest.raises(Exception, match="both classes"):
        rates.auc(scores(spark, [1], []), ["scenario"]).collect()


def test_summary(spark):
    """Against the sorted list: halves of the middle two, and the nearest rank of 95 %."""
    r = np.random.default_rng(5)
    for n in (1, 2, 19, 61):
        values = r.integers(-9, 9, n).tolist()
        got, ranked = rates.summary(scores(spark, [*values, None], []), ["scenario"], "score").first(), sorted(values)
        want = (n, float(np.mean(values)), float(np.median(values)), ranked[min(n, max(1, round(0.95 * n))) - 1], ranked[0], ranked[-1])
        assert np.allclose([got[c] for c in ("count", "mean", "median", "p95", "min", "max")], want)
    assert rates.summary(scores(spark, [None], []), ["scenario"], "score").count() == 0


def test_eer(spark):
    of = lambda g, i: rates.eer(rates.rates(rates.grid(scores(spark, g, i), ["scenario"]), ["scenario"]), ["scenario"]).first().eer
    assert of([40, 60, 80, 90, 70], [10, 20, 30, 50, 65]) == pytest.approx(0.2)
    assert of([9.5, 8], [-1, 0, 3]) == 0
    assert of([None, None], [4, 2]) == 1.0  # meets where everything scored is accepted


def test_weights_repeat_pairs(spark):
    from pyspark.sql import functions as F

    plain = scores(spark, [12, 30, 18, 45], [3, 22, 9, 30, 14])
    weight = F.when(F.col("score") >= 18, 3).otherwise(1)
    repeated = plain.unionByName(plain.where("score >= 18")).unionByName(plain.where("score >= 18"))
    of = lambda df, w=None: sorted(map(tuple, rates.rates(rates.grid(df, ["scenario"], w), ["scenario"]).collect()))
    assert of(plain, weight) == of(repeated)


def test_share_threshold(spark):
    r = np.random.default_rng(8)
    values = r.integers(0, 300, 2000)
    for share in (0.0, 0.001, 0.03, 0.5):
        got = rates.share_threshold(scores(spark, values.tolist(), []), share).first().threshold
        above = lambda t: (values > t).sum()
        assert got == min(t for t in set(values.tolist()) if above(t) <= np.floor(share * len(values) + 1e-9))
    assert rates.share_threshold(scores(spark, [3, 8], []), 1.0).first().threshold == float("-inf")


def test_operational(spark):
    """The threshold comes from one list and is applied to the other; counts of equal scores give the same."""
    fit, test = scores(spark, [21, 35], [4] * 60 + [15, 26, 26]), scores(spark, [30, 14, 26, None, 16], [17, 2, 15, 31, None])
    r = rates.operational(fit, test, ["scenario"], 0.04).first()
    assert (r.threshold, r.true_accepts, r.genuine, r.false_accepts, r.impostor) == (15, 3, 5, 2, 5)
    counted = [df.groupBy("scenario", "kind", "score").count().withColumnRenamed("count", "n") for df in (fit, test)]
    assert rates.operational(*counted, ["scenario"], 0.04, "n").first() == r


def test_det_thinning(spark):
    r = np.random.default_rng(19)
    table = rates.rates(rates.grid(scores(spark, r.gamma(5, 2, 220).tolist(), r.gamma(3, 2, 340).tolist()), ["scenario"]), ["scenario"])
    full, thin = (sorted((x.k, x.far) for x in rates.det_points(table, ["scenario"], n).collect()) for n in (3000, 40))
    want = sorted(set(np.linspace(0, len(full) - 1, 40).astype(int).tolist()))
    assert [k for k, _ in thin] == want and set(thin) <= set(full)


def test_probit_and_labels(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    p = [0.0001, 0.01, 0.3, 0.5, 0.9, 0.9999]
    got = [r.x for r in spark.createDataFrame([(v,) for v in p], "p double").select(probit(F.col("p")).alias("x")).collect()]
    assert all(abs(x - NormalDist().inv_cdf(v)) < 5e-4 for x, v in zip(got, p))
    assert [far_label(x) for x in (0.01, 0.001, 0.0001)] == ["1%", "0.1%", "0.01%"]


def test_bins_never_fall_as_scores_rise(spark):
    """Ordered doubles of every size, either sign, neighbours of powers of two, infinities and NaN."""
    r = np.random.default_rng(5)
    some = np.concatenate([r.normal(size=4000) * 10.0 ** r.integers(-300, 300, 4000), 2.0 ** np.arange(-1074, 1024), [0.0, -0.0, 5e-324, np.inf, np.nan]])
    some = np.unique(np.concatenate([some, -some, np.nextafter(some, np.inf), np.nextafter(some, -np.inf)]))  # NaN last
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(some)], "k int, score double")
    got = [x.b for x in rows.select("k", rates.score_bin(rows.score).alias("b")).orderBy("k").collect()]
    assert all(a <= b for a, b in zip(got, got[1:])) and len(set(got)) > 1000


def test_running_sums_through_bins(spark):
    """Groups, null groups among them, against sums over the sorted list, both ways."""
    r = np.random.default_rng(6)
    values = np.unique(np.concatenate([r.normal(size=700) * 10.0 ** r.integers(-6, 6, 700), 1 + r.random(700) * 1e-3, [-np.inf]]))
    rows = [(g, float(v), int(n)) for g in ("a", None) for v, n in zip(values, r.integers(0, 9, len(values)))]
    table = spark.createDataFrame(rows, "g string, score double, n long")
    for down in (False, True):
        got = {(x.g, x.score): (x.n_before, x.n_total) for x in rates.running(table, ["g"], "score", ["n"], down).collect()}
        for g in ("a", None):
            mine, before = sorted(((v, n) for h, v, n in rows if h == g), reverse=down), 0
            for v, n in mine:
                assert got[g, v] == (before, sum(k for _, k in mine))
                before += n
    empty = rates.running(table.where("n < 0"), [], "score", ["n"])
    assert empty.count() == 0
