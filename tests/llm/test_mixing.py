import duckdb
import pytest

import corpus_pipeline
from pairlight.llm import mixing


def test_targets_fill_and_stop_at_twice(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100), ("z", 0)], "source string, size long")
    rows = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert rows["a"].target == 20 and rows["z"].target == 0
    assert sum(r.target for r in rows.values()) == pytest.approx(1.5 * 2110)
    assert all(r.target <= 2 * r.source_size for r in rows.values())
    # sources by code point weigh 5, 2, 1, 5, 2; the null one comes last
    assert rows[None].weight == 2 and rows["z"].weight == 5
    free = {k: r.target / r.weight for k, r in rows.items() if r.target < 2 * r.source_size - 1e-9}
    assert len({round(v, 6) for v in free.values()}) == 1


def test_mix_equals_sql_and_comes_near(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.pareto_mix(docs).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(mixing.ORACLE).df()
    keys = ["doc_id", "copies", "taken", "size"]
    assert sorted(map(tuple, got[keys].values.tolist())) == sorted(map(tuple, want[keys].values.tolist()))
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.pareto_mix(docs.repartition(3)).toPandas()
    assert sorted(map(tuple, again[keys].values.tolist())) == sorted(map(tuple, got[keys].values.tolist()))


def test_propensity_tilts(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    rows = mixing.pareto_mix(docs, share=0.5, propensity=F.when(F.col("doc_id") < 1000, 3.0).otherwise(1.0)).groupBy((F.col("doc_id") < 1000).alias("first")).agg(F.sum("taken").alias("t")).collect()
    t = {r["first"]: r.t for r in rows}
    assert t[True] + t[False] == pytest.approx(3000, abs=3) and 2.4 < t[True] / t[False] < 3.8


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.pareto_mix(odd_docs).collect()
    assert len(rows) == 13 and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.pareto_mix(no_docs).count() == 0


def test_rows_of_one_id_keep_their_own_copies(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    docs = spark.range(600).select((F.col("id") % 3).alias("doc_id"), F.lit("s").alias("source"), F.format_string("a b w%d", F.col("id") % 200).alias("text"), F.col("id").alias("copies"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    mixed = mixing.pareto_mix(docs, carry=True)
    rows = mixed.select("doc_id", "taken", F.col("document.copies").alias("own"), F.col("copies").alias("n")).collect()
    assert sorted(r.own for r in rows) == list(range(600)) and abs(sum(r.taken for r in rows) - 2700) <= 2
    # rows without an id draw by their texts, so both outcomes occur among them
    assert set(Counter(r.n for r in rows if r.doc_id is None)) == {1, 2}
    stage = corpus_pipeline.mix(spark, docs, "")
    assert stage.columns == docs.columns
    assert Counter(r.copies for r in stage.collect()) == {r.own: r.n for r in rows if r.n}


def test_plan_is_native(spark, sf_dir):
    plan = mixing.pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
