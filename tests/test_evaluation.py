import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.operators import audit, bootstrap, fusion, matching, pairs
from pairlight.plans import stand_ins as S
from tests.core_helpers import MANIFEST


def naive_bootstrap(rows, draws, targets):
    out = {}
    for r in range(draws.shape[1]):
        w = draws[:, r].astype(float)
        score = np.array([-np.inf if s is None else s for *_, s, _, _ in rows])
        kind = np.array([k == "genuine" for k, *_ in rows])
        weight = np.array([w[p] if k == "genuine" else w[p] * w[q] for k, _, p, q in rows])
        grid = np.unique(np.append(score, -np.inf))[::-1]
        far = np.array([weight[~kind & (score > t)].sum() for t in grid]) / weight[~kind].sum()
        frr = 1 - np.array([weight[kind & (score > t)].sum() for t in grid]) / weight[kind].sum()
        k = int(np.argmax(far - frr >= 0)) if (far - frr >= 0).any() else len(grid) - 1
        if k and far[k] >= frr[k]:
            a, b = far[k - 1] - frr[k - 1], far[k] - frr[k]
            out[r, "eer"] = far[k - 1] + a / (a - b) * (far[k] - far[k - 1])
        else:
            out[r, "eer"] = (far[k] + frr[k]) / 2
        for t in targets:
            out[r, f"tar_at_{t!r}"] = 1 - frr[np.flatnonzero(far <= t + 1e-9)[-1]]
    return out


def test_bootstrap_equals_naive(spark):
    r, n = np.random.default_rng(4), 9
    rows = [("genuine", int(r.integers(3, 12)) if r.random() > 0.1 else None, k % n, k % n) for k in range(60)]
    rows += [("impostor", int(r.integers(0, 8)) if r.random() > 0.1 else None, int(a), int(b)) for a, b in r.integers(0, n, (200, 2)) if a != b]
    df = spark.createDataFrame([(k, None if s is None else float(s), f"{p}", f"{q}") for k, s, p, q in rows], "kind string, score double, probe_subject string, reference_subject string").withColumn("algorithm", F.lit("x")).repartition(3)
    index = bootstrap.subject_index(spark.createDataFrame([(f"{k}",) for k in range(n)], "subject string"))
    for make in (bootstrap.split_draws, bootstrap.sequence_draws):
        draws = make(n, 70, 5)
        whole = draws(0, n)
        assert (whole.sum(0) == n).all() and all((draws(a, a + 4) == whole[a : a + 4]).all() for a in range(6))
        want = naive_bootstrap(rows, whole, (0.1,))
        got = bootstrap.subject_bootstrap(df, index, draws, 70, ["algorithm"], (0.1,)).collect()
        assert len(got) == 140 and all(abs(x.value - want[x.replicate, x.metric]) < 1e-9 for x in got)
    two = df.withColumnRenamed("score", "one").withColumn("two", 12 - F.col("one"))
    wide = bootstrap.subject_bootstrap(two, index, draws, 70, ["algorithm"], (0.1,), ("one", "two")).collect()
    assert {(x.replicate, x.metric): x.value for x in wide if x.channel == "one"} == {(x.replicate, x.metric): x.value for x in got} and len(wide) == 280


@pytest.mark.parametrize("dense", [0, 1000])
def test_bootstrap_in_blocks_of_subjects(spark, monkeypatch, dense):
    """Subjects in blocks, sums in parts, and tasks that give up what they hold: the same numbers."""
    r, n = np.random.default_rng(9), 23
    rows = [("genuine", float(r.integers(0, 9)), int(k), int(k)) for k in range(n)] + [("impostor", float(r.integers(0, 6)), int(a), int(b)) for a, b in r.integers(0, n, (300, 2)) if a != b]
    df = spark.createDataFrame([(k, s, f"{p:02d}", f"{q:02d}") for k, s, p, q in rows], "kind string, score double, probe_subject string, reference_subject string").repartition(3)
    index = bootstrap.subject_index(df.select(F.explode(F.array("probe_subject", "reference_subject")).alias("subject")))
    draws = bootstrap.split_draws(n, 60, 2)
    want = naive_bootstrap(rows, draws(0, n), (0.2,))
    for name, value in (("SUBJECTS", 5), ("PARTS", 3), ("ROWS", 7), ("HELD", 1), ("DENSE", dense)):
        monkeypatch.setattr(bootstrap, name, value)
    got = bootstrap.subject_bootstrap(df, index, draws, 60, [], (0.2,)).collect()
    assert len(got) == 120 and all(abs(x.value - want[x.replicate, x.metric]) < 1e-9 for x in got)


def test_split_draws_are_those_of_a_bootstrap():
    """Mean, variance and covariance of the counts are those of n draws from n subjects."""
    n, r = 40, 20_000
    w = bootstrap.split_draws(n, r, 11)(0, n).astype(float)
    assert (w.sum(0) == n).all() and np.abs(w.mean(1) - 1).max() < 0.04
    cov = np.cov(w)
    assert np.abs(np.diag(cov) - (1 - 1 / n)).max() < 0.06 and np.abs(cov[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.04


def test_intervals_and_differences(spark):
    r = np.random.default_rng(1).normal(size=(2, 101))
    rows = [(a, k, "eer", float(v)) for a, vs in zip("ab", r) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "algorithm string, replicate int, metric string, value double")
    x = {i.algorithm: (i.low, i.high) for i in bootstrap.intervals(df, ["algorithm"]).collect()}
    assert np.allclose(x["a"], np.percentile(r[0], [2.5, 97.5]))
    d = bootstrap.paired_differences(df, [], "algorithm").collect()
    assert len(d) == 1 and (d[0].minuend, d[0].subtrahend) == ("b", "a") and np.allclose((d[0].low, d[0].high), np.percentile(r[1] - r[0], [2.5, 97.5]))


def test_fusion_fit_equals_numpy(spark):
    r = np.random.default_rng(6)
    y = (np.arange(400) % 4 == 0).astype(float)
    x = np.column_stack([y + r.normal(size=400), r.normal(size=400) + 0.5 * y])
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    design, share, w = np.column_stack([x, np.ones(400)]), np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (share * p * (1 - p))[:, None]).T @ design + 1e-9 * np.eye(3), design.T @ (share * (p - y)) + 1e-9 * w)
    assert np.allclose(fusion.fit_logistic(df, ["a", "b"], "y"), w, atol=1e-9)
    with pytest.raises(ValueError):
        fusion.fit_logistic(df.where("y = 1"), ["a", "b"], "y")


def test_channels_must_list_identical_pairs(spark):
    a, b = (spark.createDataFrame(rows, "pair_id string, score double") for rows in ([("1", 2.0), ("2", None)], [("2", 5.0), ("1", 1.0)]))
    assert {(r.pair_id, r.a, r.b) for r in fusion.align_channels({"a": a, "b": b}, ["pair_id"]).collect()} == {("1", 2.0, 1.0), ("2", None, 5.0)}
    with pytest.raises(Exception, match="identical pairs"):
        fusion.align_channels({"a": a, "b": b.limit(1)}, ["pair_id"]).collect()
    fused = fusion.fused(fusion.align_channels({"a": a, "b": b}, ["pair_id"]), ["a", "b"], {"a": 1.0, "b": 1.0}, (2.0, 1.0)).collect()
    assert {r.pair_id: round(r.fused, 12) for r in fused} == {"1": round(2 * np.log(3) + np.log(2), 12), "2": round(2 * np.log(2) + np.log(6), 12)}


AUDIT = "image_id string, set string, subject string, frgp int"


def test_label_audit(spark):
    row = spark.createDataFrame([("Q_A_03", "Q", "A", 3)], AUDIT)
    references = spark.createDataFrame([(f"V_{s}_{f:02d}", "V", s, f) for s, f in (("A", 3), ("A", 4), ("B", 3), ("B", 4), ("C", 3))], AUDIT)
    made = audit.candidate_pairs(row, references)
    assert sorted(r.reference_image_id for r in made.collect()) == ["V_A_03", "V_A_04", "V_B_03", "V_C_03"]
    for values, want in (([40, 5, 3, 2], "confirmed"), ([4, 40, 3, 2], "suspected"), ([4, 5, 40, 2], "suspected"), ([40, 41, 3, 2], "suspected"), ([8, 5, 3, 2], "undetermined"), ([None, 5, 3, 2], "no_reference")):
        score = F.element_at(F.create_map(*[x for k, v in zip(("V_A_03", "V_A_04", "V_B_03", "V_C_03"), values) for x in (F.lit(k), F.lit(v).cast("double"))]), F.col("reference_image_id"))
        got = audit.classify(row, made.withColumn("score", score), 10).first()
        assert got.category == want, values
    assert audit.classify(row, made.withColumn("score", F.lit(None).cast("double")), 10).first().category == "no_reference"


def naive_matches(a, b, ratio):
    count = 0
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    for i in range(len(a)):
        j = d[i].argmin()
        if d[:, j].argmin() == i and (min(len(a), len(b)) == 1 or (d[i, j] < ratio * np.sort(d[i])[1] and d[i, j] < ratio * np.sort(d[:, j])[1])):
            count += 1
    return count


@pytest.mark.parametrize("block", [512, 7])
def test_mutual_matches_in_blocks(spark, block):
    """Images of no, one and many descriptors, equal ones among them, whole and in blocks."""
    r = np.random.default_rng(3)
    sizes = {"a": 60, "b": 45, "c": 1, "d": 2, "e": 33}
    images = {k: r.normal(size=(n, 8)) for k, n in sizes.items()}
    images["b"][:20] = images["a"][:20] + r.normal(size=(20, 8)) * 0.05
    images["e"][:10] = images["a"][5:15]
    images["e"][10:14] = images["e"][0]  # ties
    images["d"][0] = images["a"][3] + 0.01
    rows = [(k, i, v.tolist()) for k, x in images.items() for i, v in enumerate(x)]
    descriptors = spark.createDataFrame(rows, "image_id string, row_id int, vector array<double>").repartition(3)
    names = [*images, "none"]
    listed = matching.every_pair(*[spark.createDataFrame([(n,) for n in names], "image_id string")] * 2, listed=2)
    got = {(x.probe_image_id, x.reference_image_id): (x.status, x.score) for x in matching.score_pairs(listed, descriptors, 0.7, block).collect()}
    assert len(got) == len(names) ** 2
    for (p, q), (status, score) in got.items():
        assert (status, score) == (("failed", None) if "none" in (p, q) else ("ok", naive_matches(images[p], images[q], 0.7)))
    assert got["a", "b"][1] >= 20 and got["a", "a"][1] == 60
    features = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "image_id string, descriptors array<double>")
    assert matching.differing_features(features, features.where("image_id = 'a'")).count() == 1


def test_a_descriptor_is_sent_once_a_pair(spark, monkeypatch):
    """Images of more descriptors than a tile are not cut into blocks that each meet all blocks of the other; floats are sent as floats."""
    r = np.random.default_rng(4)
    images = {k: r.normal(size=(1300, 4)).astype(np.float32) for k in "ab"}
    images["b"][:30] = images["a"][:30]
    images["b"][1290:] = images["a"][0]  # ties in two tiles
    descriptors = spark.createDataFrame([(k, i, v.tolist()) for k, x in images.items() for i, v in enumerate(x)], "image_id string, row_id int, vector array<float>")
    sent, close = [], matching._nearest_in_blocks
    monkeypatch.setattr(matching, "_nearest_in_blocks", lambda rows: sent.append((rows.count(), rows.schema["vector"].dataType.elementType.simpleString())) or close(rows))
    got = matching.score_pairs(spark.createDataFrame([("a", "b")], "probe_image_id string, reference_image_id string"), descriptors).collect()
    assert sent == [(2600, "float")]
    assert got[0].score == naive_matches(*(x.astype(float) for x in images.values()), 0.7) > 10


def test_resolved_features(spark):
    images = spark.createDataFrame([(i,) for i in ("Q_1", "Q_2", "Q_3", "V_1", "X_1")], "image_id string")
    tables = [(name, spark.createDataFrame(rows, "image_id string, n int, x double")) for name, rows in (("full", [("V_1", 1, 0.5), ("Q_1", 9, 9.0)]), ("method", [("Q_1", 2, 1.5), ("V_1", 8, 8.0)]), ("plain", [("Q_1", 3, 2.5), ("Q_2", 4, 3.5), ("X_1", 7, 7.0)]))]
    got = {r.image_id: (r.source, r.n, r.x) for r in matching.resolved_features(images, tables, {"Q": ["method", "plain"], "V": ["full"]}).collect()}
    assert got == {"Q_1": ("method", 2, 1.5), "Q_2": ("plain", 4, 3.5), "Q_3": (None, None, None), "V_1": ("full", 1, 0.5), "X_1": (None, None, None)}


def test_bootstrap_by_classes_equals_that_of_all_pairs(spark, monkeypatch):
    """Classes of several images, subjects on both sides, failures, small blocks and tasks that give up what they hold: the numbers of the pairs themselves, which are not made."""
    r = np.random.default_rng(3)
    rows = [(f"{s}_{k:08d}_{f:02d}", s, f"{k:08d}", f, int(r.integers(0, 9)), int(r.random() < 0.1)) for s in "UVR" for k in range(13) for f in (1, 2, 3) if r.random() < 0.9]
    images = spark.createDataFrame(rows, MANIFEST).repartition(2)
    made = S.both_channels(pairs.all_pairs(images, pairs.SCENARIOS, ("trait",)))
    index = bootstrap.subject_index(images)
    draws = bootstrap.split_draws(13, 70, 8)
    want = bootstrap.subject_bootstrap(made, index, draws, 70, ["scenario"], (0.1,), ("one", "two")).collect()
    for name, value in (("SUBJECTS", 5), ("CLASSES", (2, 3)), ("CACHED", 4), ("HELD", 1)):
        monkeypatch.setattr(bootstrap, name, value)
    monkeypatch.setattr(pairs, "impostor_pairs", None)
    got = bootstrap.class_bootstrap(images, pairs.SCENARIOS, "trait", S.both_channels, index, draws, 70, (0.1,), ("one", "two")).collect()
    key = ["scenario", "channel", "replicate", "metric", "value"]
    assert len(got) == 2 * 2 * 70 * 2 and sorted([x[c] for c in key] for x in got) == sorted([x[c] for c in key] for x in want)


def test_weights_of_classes_take_few_bytes(spark):
    """Whole numbers travel in as few bytes as they need (before, in eight), and come back as they were."""
    r = np.random.default_rng(4)
    for top, size in ((200, 1), (60_000, 2), (10**9, 4), (2**40, 8)):
        rows = r.integers(0, top, (5, 7))
        rows[2, 3] = top
        column = bootstrap._packed(rows)
        assert {len(x) for x in column.to_pylist()} == {7 * size} and (bootstrap._unpacked(column.slice(1), 7) == rows[1:]).all()
    images = spark.createDataFrame([(k % 40, k % 3) for k in range(300)], "idx int, class long")
    draws = bootstrap.split_draws(40, 60, 5)
    got = bootstrap._class_weights(images, draws, 40, 60).collect()
    drawn = draws(0, 40)
    for row in got:
        want = sum(drawn[k % 40] for k in range(300) if k % 3 == row["class"])
        assert 60 <= len(row.w) <= 120 and np.frombuffer(row.w, np.uint8 if len(row.w) == 60 else np.uint16).tolist() == want.tolist()


def test_sums_in_order_of_scores():
    r = np.random.default_rng(6)
    rows = r.integers(0, 9, (50, 4)).astype(np.float32)
    for cells in (r.integers(0, 5, 50), r.integers(0, 900, 50), np.zeros(50, int)):
        order = np.argsort(cells, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], cells[order][1:] != cells[order][:-1]]))
        assert bootstrap._sums_of(rows, order, first).tolist() == [rows[cells == c].sum(0).tolist() for c in np.unique(cells)]
