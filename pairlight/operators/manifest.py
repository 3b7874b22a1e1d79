"""Building the manifest: file names, checksums, exclusions, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions import image_id

#: subject, device, resolution, capture and position, as the corpus names its files.
FILE_NAME = r"^([0-9]{8})_([A-Z])_([0-9]+)_([a-z]+)_([0-9]{2})\.png$"
NATIVE_PPI = 1000


def parse_file_name(name: Column) -> Column:
    """subject, device, ppi, capture, frgp; an error for any other name."""
    part = lambda k: F.regexp_extract(name, FILE_NAME, k)
    fields = F.struct(part(1).alias("subject"), part(2).alias("device"), part(3).cast("int").alias("ppi"), part(4).alias("capture"), part(5).cast("int").alias("frgp"))
    return F.when(name.rlike(FILE_NAME), fields).otherwise(F.raise_error(F.concat(F.lit("not an image file name: "), name)).cast("struct<subject:string,device:string,ppi:int,capture:string,frgp:int>"))


def unique_or_fail(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df`` with repeated keys turned into an error when read."""
    return df.groupBy(*keys).agg(F.max(F.struct(*[c for c in df.columns if c not in keys])).alias("v"), F.count(F.lit(1)).alias("n")).select(
        *keys, F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.concat_ws(" ", F.lit(f"duplicate {what}:"), *[F.col(k).cast("string") for k in keys]))).alias("v")
    ).select(*keys, "v.*")


def checksum_status(listed: Column, found: Column) -> Column:
    return F.when(listed.isNull(), "not_listed").when(listed == found, "ok").otherwise("mismatch")


def build(images: DataFrame, checksums: DataFrame, exclusions: DataFrame, participants: DataFrame, sets: DataFrame) -> DataFrame:
    """The manifest.

    images: set, name, sha256, width, height, bit_depth, ppi_x, ppi_y.
    checksums: set, name, listed. exclusions: set, subject, frgp, decision, reason.
    participants: id, collection_day. sets: set, capture_label, impression,
    device_model, directory. A file that does not belong to its set is an error, and so
    is an exclusion that names no image.
    """
    fields = images.withColumn("f", parse_file_name(F.col("name"))).join(sets, "set")
    fits = (F.col("f.device") == F.col("set")) & (F.col("f.capture") == F.col("capture_label")) & (F.col("f.ppi") == NATIVE_PPI)
    rows = fields.withColumn("subject", F.when(fits, F.col("f.subject")).otherwise(F.raise_error(F.concat_ws(" ", "name", F.lit("does not belong to set"), "set")))).withColumn("frgp", F.col("f.frgp"))
    excluded = unique_or_fail(exclusions.select("set", "subject", "frgp", "decision", "reason"), ["set", "subject", "frgp"], "exclusion")
    joined = rows.join(checksums, ["set", "name"], "left").join(excluded, ["set", "subject", "frgp"], "left").join(participants.select(F.col("id").alias("subject"), "collection_day", F.lit(True).alias("known")), "subject", "left")
    checksum = checksum_status(F.col("listed"), F.col("sha256"))
    odd = ~(F.col("ppi_x").eqNullSafe(F.lit(float(NATIVE_PPI))) & F.col("ppi_y").eqNullSafe(F.lit(float(NATIVE_PPI))))
    size = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("decision").isNotNull(), F.concat_ws(": ", "decision", "reason")),
        F.when(F.col("checksum") != "ok", F.concat(F.lit("R2: checksum "), F.col("checksum"))),
        F.when(odd, F.concat(F.lit("R2: header resolution "), size("ppi_x"), F.lit("x"), size("ppi_y"), F.lit(" ppi"))),
        F.when(F.col("known").isNull(), F.lit("subject missing from participants.csv")),
    )
    out = joined.withColumn("checksum", checksum).withColumn("exclusion_reason", reasons)
    made = out.select(
        image_id(F.col("set"), F.col("subject"), F.col("frgp")).alias("image_id"), "set", "subject", "frgp", "impression", "capture_label", "device_model",
        F.concat_ws("/", "directory", F.lit("png"), "name").alias("relpath"), "width", "height", "bit_depth", "ppi_x", "ppi_y", "sha256", "checksum",
        F.coalesce("collection_day", F.lit("")).alias("collection_day"), (F.col("exclusion_reason") != "").cast("int").alias("excluded"), "exclusion_reason",
    )
    stray = unmatched_exclusions(exclusions, rows).agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(" ", "set", "subject", F.col("frgp").cast("string"))).alias("one"))
    # a filter, so that pruning columns cannot drop the check
    wrong = stray.where(F.when(F.col("n") > 0, F.raise_error(F.concat_ws(" ", F.lit("exclusions that name no image:"), F.col("n").cast("string"), F.lit("of them, the first"), "one")).cast("boolean")).otherwise(False))
    return made.unionByName(wrong.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields]))


def missing_files(checksums: DataFrame, images: DataFrame) -> DataFrame:
    """set, name of what a checksum list names and no file has."""
    return checksums.select("set", "name").join(images.select("set", "name"), ["set", "name"], "left_anti")


def unmatched_exclusions(exclusions: DataFrame, manifest: DataFrame) -> DataFrame:
    return exclusions.join(manifest.select("set", "subject", "frgp"), ["set", "subject", "frgp"], "left_anti")


def set_summary(manifest: DataFrame) -> DataFrame:
    """set, images, excluded, subjects."""
    return manifest.groupBy("set").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("excluded") == 1).alias("excluded"), F.count_distinct("subject").alias("subjects"))
