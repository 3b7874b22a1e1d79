"""Reading and writing tables and image files; every schema is declared, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "image_id string, set string, subject string, frgp int, impression string, capture_label string, device_model string, relpath string, "
    "width int, height int, bit_depth int, ppi_x double, ppi_y double, sha256 string, checksum string, collection_day string, excluded int, exclusion_reason string"
)
PAIRS = "pair_id string, scenario string, kind string, frgp int, probe_image_id string, reference_image_id string, probe_subject string, reference_subject string"
SCORES = "pair_id string, scenario string, kind string, frgp int, probe_image_id string, reference_image_id string, compact int, status string, reason string, score string"
EXCLUSIONS = "set string, subject string, frgp int, decision string, reason string, source string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Deterministic CSV: sorted, one header, LF; refuses to overwrite. Rows are ordered across files, not gathered into one."""
    df.orderBy(*order).write.mode("errorifexists").csv(path, header=True, lineSep="\n")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table; a status other than ok or an empty score is a null score."""
    raw = read_csv(spark, path, SCORES)
    return raw.withColumn("score", F.when(F.col("status") == "ok", F.expr("try_cast(score AS DOUBLE)")))


_ORDER = ["scenario", "frgp", "probe_image_id", "reference_image_id"]


def write_scores(pairs: DataFrame, compact: DataFrame, path: str, files: int | None = None) -> None:
    """The score table in order of scenario, position, probe and reference, with ``compact``: whether a pair is among ``compact`` (pair_id).

    ``pairs`` has the columns of SCORES but compact. Rows are dealt by range and a
    file's number is its place, so the files in order of their names are the table in
    order and nothing is gathered; there is no header, so they can be put together
    whatever their number. Refuses to overwrite.
    """
    marked = pairs.join(compact.select("pair_id", F.lit(1).alias("compact")).distinct(), "pair_id", "left").withColumn("compact", F.coalesce("compact", F.lit(0)))
    dealt = marked.repartitionByRange(files, *_ORDER) if files else marked.repartitionByRange(*_ORDER)
    write_dealt_scores(dealt, path)


def write_dealt_scores(pairs: DataFrame, path: str, compression: str = "none") -> None:
    """The score table from ``pairs`` with all columns of SCORES whose partitions are stretches of its order, as those of ``pairs.ordered_pairs``; a partition is a file.

    Files of ``compression`` gzip hold a tenth or less, as neighbouring lines are alike, and can be put together like plain ones.
    """
    columns = [c.split(" ")[0] for c in SCORES.split(", ")]
    pairs.sortWithinPartitions(*_ORDER).select(*columns).write.mode("errorifexists").csv(path, header=False, lineSep="\n", emptyValue="", compression=compression)


def read_written_scores(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_scores`` has written; a status other than ok or an empty score is a null score."""
    raw = spark.read.schema(SCORES).csv(path, header=False)
    return raw.withColumn("score", F.when(F.col("status") == "ok", F.expr("try_cast(score AS DOUBLE)")))


def read_ordered_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The manifest rows that a listing names, with pos: their place in it. A listing names a sample and is read as one row, up to some million lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\r?\n")).alias("pos", "line")).where("pos > 0")
    listed = lines.select("pos", F.split_part("line", F.lit(","), F.lit(1)).alias("image_id"))
    return listed.join(manifest, "image_id")


def read_checksums(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """set, name, listed from checksum lists, a folder or glob for each set; the hash column has either name, the last file of a set wins."""
    out = None
    for code, path in paths.items():
        lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
        head = F.transform(F.split(F.col("lines")[0], ","), lambda h: F.trim(h))
        cells = lines.select("file", head.alias("head"), F.posexplode("lines").alias("pos", "line")).where("pos > 0 and trim(line) != ''").withColumn("cell", F.split("line", ","))
        hash_at = F.when(F.array_contains("head", "sha256"), F.array_position("head", "sha256")).otherwise(F.array_position("head", "checksum"))
        at = lambda k: F.trim(F.element_at("cell", k.cast("int")))
        part = cells.select(F.lit(code).alias("set"), F.regexp_extract(at(F.array_position("head", "filename")), r"([^/\\]+)$", 1).alias("name"), F.lower(at(hash_at)).alias("listed"), "file", "pos")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("set", "name").agg(F.max_by("listed", F.struct("file", "pos")).alias("listed"))


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col from text files of "row,col" lines."""
    return spark.read.schema("row int, col int").csv(path).withColumn("file", F.input_file_name())


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("version"))
