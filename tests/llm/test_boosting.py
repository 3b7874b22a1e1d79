import zlib

import numpy as np

from pairlight.llm import boosting
from pairlight.llm.doc_stats import NAMES, statistics
from pairlight.llm.text_arrays import Texts


def test_traversal_equals_walking_the_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = boosting.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (1 if row[f[node]] <= t[node] else 2)
            total += leaf[node - len(f)]
        return total

    assert np.allclose(forest.raw(x), [walk(row) for row in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
    assert np.array_equal(forest.raw(x), boosting.fit(x, y, trees=20, depth=3).raw(x))


def test_one_class_and_no_labels():
    x = np.zeros((4, 3))
    assert (boosting.fit(x, np.ones(4)).score(x) > 0.8).all()
    assert (boosting.fit(x[:0], np.zeros(0)).score(x) == 0.5).all()
    assert (boosting.fit(x, np.array([0.0, 1, 0, 1])).score(x) == 0.5).all()


def test_statistics_by_hand():
    import pyarrow as pa

    row = dict(zip(NAMES, statistics(Texts(pa.array(["The cat.\nThe cat.\n12 ## é", None])))[0]))
    assert np.isclose(row["log_words"], np.log1p(7)) and np.isclose(row["dup_lines"], 1 / 3)
    assert np.isclose(row["distinct_words"], 5 / 7) and np.isclose(row["top_word"], 2 / 7) and np.isclose(row["capital_words"], 2 / 7)
    assert np.isclose(row["stop_ends"], 2 / 7) and np.isclose(row["digit_words"], 1 / 7) and np.isclose(row["symbol_only_words"], 1 / 7)


def test_held_out_accuracy_and_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = boosting.op9_gradient_boosting(spark, "/root/testdata/sf0.01").collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.9
    # labels of the held-out fold change nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(boosting.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in boosting.score(docs, boosting.train(docs, turned)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (9, None, 0), (10, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    forest = boosting.train(odd_docs, labels)
    assert boosting.score(odd_docs, forest).count() == 13
    kept = boosting.score(odd_docs, forest, odd_docs.columns, "__score")
    assert kept.columns == [*odd_docs.columns, "__score"] and kept.count() == 13
    assert boosting.score(no_docs, boosting.train(no_docs, labels)).count() == 0
