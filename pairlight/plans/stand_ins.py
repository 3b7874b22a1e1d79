"""Stand-in inputs from the driver's tables, which hold no biometric data.

They exercise the operators' semantics; the rates they give mean nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions import image_id
from pairlight.scratch import keep

SEED = "pairlight-v1"
SETS = {"signup": "U", "view": "V", "click": "R", "purchase": "Q", "error": "J"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as images: the first event of each set, subject and position; every 97th event is excluded."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in SETS.items() for x in kv]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(
        code.alias("set"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("subject"), (F.col("event_id") % 10 + 1).cast("int").alias("frgp"), "event_id", "value"
    )
    first = rows.where(F.col("set").isNotNull()).groupBy("set", "subject", "frgp").agg(F.min(F.struct("event_id", "value")).alias("e"))
    return first.select(
        image_id(F.col("set"), F.col("subject"), F.col("frgp")).alias("image_id"), "set", "subject", "frgp",
        F.floor(F.col("e.value") * 100).cast("long").alias("trait"), (F.col("e.event_id") % 97 == 0).cast("int").alias("excluded"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest as the table that a study writes once and every later step reads."""
    return keep(manifest(spark, sf_dir), "manifest")


#: What the scores of ``scored`` and of ``second_channel`` tell traits apart by: traits that agree modulo this have equal scores against any other.
FIRST_MODULUS, SECOND_MODULUS = 97 * 53, 89 * 41


def with_residue(images: DataFrame, modulus: int, name: str = "residue") -> DataFrame:
    """``images`` with the trait modulo ``modulus``, so that there is a bounded number of them however many traits there are; with a negative trait among them, whose remainders are signed, the trait itself."""
    signed = images.where("trait < 0").limit(1).count()
    return images.withColumn(name, F.col("trait") if signed else F.col("trait") % modulus)


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with an integer score from both images' traits; every 53rd sum of traits is a failure."""
    p, r = F.col("probe_trait"), F.col("reference_trait")
    score = (p * 31 + r * 17) % 97 + F.when(F.col("kind") == "genuine", 40).otherwise(0)
    return pairs.withColumn("score", F.when((p + r) % 53 != 0, score.cast("double"))).drop("probe_trait", "reference_trait")


def second_channel(pairs: DataFrame) -> DataFrame:
    p, r = F.col("probe_trait"), F.col("reference_trait")
    score = (p * 13 + r * 29) % 89 + F.when(F.col("kind") == "genuine", 25).otherwise(0)
    return pairs.withColumn("score", F.when((p + r) % 41 != 0, score.cast("double"))).drop("probe_trait", "reference_trait")


def both_channels(pairs: DataFrame) -> DataFrame:
    """Pairs with one and two: both channels' scores, from one pass."""
    first = scored(pairs.withColumn("p2", F.col("probe_trait")).withColumn("r2", F.col("reference_trait"))).withColumnRenamed("score", "one")
    second = second_channel(first.withColumnRenamed("p2", "probe_trait").withColumnRenamed("r2", "reference_trait"))
    return second.withColumnRenamed("score", "two")


#: The same in DuckDB, as common table expressions.
MANIFEST_SQL = """
e AS (
  SELECT CASE event_type WHEN 'signup' THEN 'U' WHEN 'view' THEN 'V' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'Q' WHEN 'error' THEN 'J' END AS set_code,
         lpad(user_id::VARCHAR, 8, '0') AS subject, (event_id % 10 + 1)::INT AS frgp, event_id, value FROM events),
m AS (
  SELECT set_code || '_' || subject || '_' || lpad(frgp::VARCHAR, 2, '0') AS image_id, set_code AS "set", subject, frgp,
         floor(value * 100)::BIGINT AS trait, (event_id % 97 = 0)::INT AS excluded
  FROM (SELECT *, row_number() OVER (PARTITION BY set_code, subject, frgp ORDER BY event_id) AS rn FROM e WHERE set_code IS NOT NULL) WHERE rn = 1),
u AS (SELECT * FROM m WHERE excluded = 0)"""


def pairs_sql(scenarios: dict[str, tuple[str, str]]) -> str:
    """Genuine and impostor pairs of the scenarios as table expression x."""
    named = ", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in scenarios.items())
    return f"""
x AS (
  SELECT s.n || ':' || p.image_id || ':' || r.image_id AS pair_id, s.n AS scenario,
         CASE WHEN p.subject = r.subject THEN 'genuine' ELSE 'impostor' END AS kind, p.frgp,
         p.image_id AS probe_image_id, r.image_id AS reference_image_id, p.subject AS probe_subject, r.subject AS reference_subject,
         p.trait AS pt, r.trait AS rt
  FROM (VALUES {named}) s(n, a, b) JOIN u p ON p."set" = s.a JOIN u r ON r."set" = s.b AND r.frgp = p.frgp)"""


SCORED_SQL = """
y AS (
  SELECT pair_id, scenario, kind, frgp, probe_image_id, reference_image_id, probe_subject, reference_subject,
         CASE WHEN (pt + rt) % 53 <> 0 THEN ((pt * 31 + rt * 17) % 97 + CASE WHEN kind = 'genuine' THEN 40 ELSE 0 END)::DOUBLE END AS score,
         CASE WHEN (pt + rt) % 41 <> 0 THEN ((pt * 13 + rt * 29) % 89 + CASE WHEN kind = 'genuine' THEN 25 ELSE 0 END)::DOUBLE END AS score2
  FROM x)"""


def hash_sql(purpose: str, item: str) -> str:
    """Keyed hash as SQL; purpose and item are SQL expressions."""
    return f"sha256('{SEED}' || chr(31) || {purpose} || chr(31) || {item})"


SPLIT_SQL = f"""
strata AS (SELECT subject, CASE WHEN bool_or("set" = 'R') THEN 'has_R' ELSE 'no_R' END AS stratum FROM m WHERE "set" IN ('U', 'V', 'R') GROUP BY subject),
split AS (
  SELECT subject, stratum, CASE WHEN rn <= round_even(n * 0.5, 0) THEN 'dev' ELSE 'test' END AS half
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {hash_sql("'split:' || stratum", 'subject')}, subject) AS rn,
               count(*) OVER (PARTITION BY stratum) AS n FROM strata))"""

GRID_SQL = """
g AS (
  SELECT scenario, score, sum(gen) AS gen, sum(imp) AS imp FROM (
    SELECT scenario, coalesce(score, '-inf'::DOUBLE) AS score, (kind = 'genuine')::INT::DOUBLE AS gen, (kind = 'impostor')::INT::DOUBLE AS imp FROM y
    UNION ALL SELECT DISTINCT scenario, '-inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM y) GROUP BY scenario, score),
r AS (
  SELECT *, ia / it AS far, 1 - ga / gt AS frr FROM (
    SELECT scenario, score, coalesce(sum(gen) OVER a, 0) AS ga, coalesce(sum(imp) OVER a, 0) AS ia,
           sum(gen) OVER (PARTITION BY scenario) AS gt, sum(imp) OVER (PARTITION BY scenario) AS it
    FROM g WINDOW a AS (PARTITION BY scenario ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
