"""Result reports as JSON files: written from result rows, read back through a declared schema.

A report is one JSON file: scenarios, in each its algorithms, in each the points
at fixed false-accept rates. A study has many reports; they are one table whose
partitions are the reports, so writing and scanning them is a Spark job each.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a point holds; a report's keys are scenarios, algorithms and rates.
POINT = ["far", "false_accepts", "frr", "genuine", "impostor", "tar", "threshold", "true_accepts"]
_COUNTS = {"false_accepts", "genuine", "impostor", "true_accepts"}
_POINT = "struct<" + ", ".join(f"{c}: {'bigint' if c in _COUNTS else 'double'}" for c in POINT) + ">"
REPORT = f"scenarios map<string, struct<algorithms: map<string, struct<at_far: map<string, {_POINT}>>>>>"


def json_text(data) -> str:
    """Deterministic JSON: sorted keys, two spaces, UTF-8 as it is, one newline at the end."""
    return json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def _formatted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: json_text(json.loads(text)).removesuffix("\n"))


def _entries(rows: DataFrame, by: list[str], key: str, value) -> DataFrame:
    """by, m: a map from ``key`` to ``value``; a report's levels are few rows each."""
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))).alias("m"))


def report_rows(results: DataFrame) -> DataFrame:
    """report, value (the JSON text) from rows of report, scenario, algorithm, far_target and POINT."""
    point = F.struct(*[F.col(c).cast("bigint" if c in _COUNTS else "double").alias(c) for c in POINT])
    rates = _entries(results.withColumn("rate", F.col("far_target").cast("string")), ["report", "scenario", "algorithm"], "rate", point)
    algorithms = _entries(rates, ["report", "scenario"], "algorithm", F.struct(F.col("m").alias("at_far")))
    scenarios = _entries(algorithms, ["report"], "scenario", F.struct(F.col("m").alias("algorithms")))
    return scenarios.select("report", F.pandas_udf(_formatted, "string")(F.to_json(F.struct(F.col("m").alias("scenarios")))).alias("value"))


def write_reports(results: DataFrame, path: str) -> None:
    """A JSON file for each report of ``results``, in a folder report=<name>; refuses to overwrite."""
    report_rows(results).repartition("report").write.mode("errorifexists").partitionBy("report").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report, scenarios: whole files, many lines each, with the declared schema."""
    return spark.read.schema(f"{REPORT}, report string").option("multiLine", True).json(path)


def result_rows(reports: DataFrame) -> DataFrame:
    """report, scenario, algorithm, far_target and POINT of every point of every report."""
    one = reports.select("report", F.explode("scenarios").alias("scenario", "s"))
    two = one.select("report", "scenario", F.explode("s.algorithms").alias("algorithm", "a"))
    three = two.select("report", "scenario", "algorithm", F.explode("a.at_far").alias("rate", "p"))
    return three.select("report", "scenario", "algorithm", F.col("rate").cast("double").alias("far_target"), "p.*")
