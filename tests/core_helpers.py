"""Synthetic manifests for the tests."""

from pyspark.sql import functions as F

MANIFEST = "image_id string, set string, subject string, frgp int, trait long, excluded int"


def manifest(spark, subjects=None, fingers=range(1, 11), excluded=()):
    """U and V with 12 subjects and R with the first 5, ten positions each, unless said otherwise."""
    subjects = subjects or {"U": 12, "V": 12, "R": 5}
    rows = [
        (f"{s}_{k:08d}_{f:02d}", s, f"{k:08d}", f, k * 31 + f * 7, int((s, k, f) in excluded))
        for s, n in subjects.items() for k in range(n) for f in fingers
    ]
    return spark.createDataFrame(rows, MANIFEST)


def scores(spark, genuine, impostor):
    rows = [("genuine", None if s is None else float(s)) for s in genuine] + [("impostor", None if s is None else float(s)) for s in impostor]
    return spark.createDataFrame(rows, "kind string, score double").withColumn("scenario", F.lit("x"))
