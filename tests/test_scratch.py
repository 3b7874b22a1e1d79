import os

from pairlight import scratch


def test_tables_are_written_read_and_swept(spark):
    df = scratch.keep(spark.range(5), "five")
    assert df.count() == 5 and "file:" in scratch.shared_dir(spark) or scratch.shared_dir(spark)
    path = scratch._WRITTEN[-1].removeprefix("file://")
    assert os.path.isdir(path)
    assert scratch.sweep(spark) >= 1 and not os.path.exists(path) and not scratch._WRITTEN


def test_an_empty_table_keeps_its_schema(spark):
    df = scratch.keep(spark.range(5).where("id < 0").selectExpr("id", "cast(null as array<long>) as a"), "none")
    assert df.count() == 0 and df.dtypes == [("id", "bigint"), ("a", "array<bigint>")]
