"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document gets an expected number of copies. Its whole part is allocated for
certain; for the rest documents are ranked by random odds divided by inclusion
odds (Rosen's Pareto sampling) and the smallest ratios are taken until the
source's remaining budget, counted in words, is filled as nearly as whole
documents allow. The ranking is cut by a histogram of the ratio (``BINS`` rows a
source) and a second one inside the bin where the budget ends, so a task sorts a
part in ``BINS`` squared of a source and never a whole one. Targets and cuts have
a row a source and are written, so the planner knows their sizes before it joins:
small ones are broadcast and the documents are not shuffled for them.

Defined cases: a null text has size 0; a null source is a source of its own,
sorted last; repeated rows are separate documents; a row without a doc_id draws
its random number by its text; zero-size documents take 0
words; an empty table gives an empty result. Input columns other than the three
named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix has.
SHARE = 1.5
#: No source's target exceeds so many times its size.
MAX_REPEATS = 2.0
#: Bins of the Pareto ratio's histogram for each source, at each of two levels.
BINS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Targets solve sum(min(max_repeats * size, level * weight)) = share * all sizes:
    what a capped source cannot hold is shared again by weight. The windows run
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pick))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("cap", cap)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if exactly the sources before this one were capped; the largest such level is the solution
        .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("capped")) / F.col("open"))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1, fixed by key and seed: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _filled(bin_: str) -> Column:
    """Words of the cell that ranking may take."""
    return F.sum(F.when(F.col(bin_).isNotNull(), F.col("size")).otherwise(0))


def _cuts(cells: DataFrame, bin_: str) -> DataFrame:
    """For each source the bin that its budget ends in, and the words before it. ``cells`` has at most ``BINS`` + 1 rows a source."""
    upto = Window.partitionBy("source").orderBy(F.col(bin_).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.col("start") + F.coalesce(F.sum("cell").over(upto), F.lit(0)))
    return before.where(F.col("before") <= F.col("budget")).groupBy("source").agg(F.max(F.struct(F.coalesce(bin_, F.lit(-1)).alias("bin"), "before", "budget")).alias("cut"))


def _with_cut(rows: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    named = cuts.select(F.col("source").alias("c_source"), F.col("cut").alias(name))
    return rows.join(named, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")


def pareto_mix(docs: DataFrame, *, seed: str = "mix", propensity: Column | None = None, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, bins: int = BINS, carry: bool = False) -> DataFrame:
    """Copies of each document in the mix.

    ``docs`` has doc_id, source, text. ``propensity`` (default equal) tilts the
    inclusion probabilities inside a source; a document never gets more than
    ``max_repeats`` copies. Returns doc_id, source, size, source_size, target,
    inclusion (expected copies), copies, taken; with ``carry`` also document, a
    struct of the row's own columns, so that nothing has to be joined back.
    """
    tilt = F.lit(1.0) if propensity is None else F.coalesce(propensity.cast("double"), F.lit(0.0))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if carry else []
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))
    sizes = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tilt.alias("tilt"), uniform(key, seed).alias("u"), *carried), "mix-sizes")
    plan = source_targets(sizes, weights, share, max_repeats)
    means = sizes.groupBy(F.col("source").alias("m_source")).agg((F.sum(F.col("tilt") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("mean_tilt"))
    plan = plan.join(means, F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source").withColumnRenamed("source", "p_source")
    plan = keep(plan, "mix-targets")  # a row a source, read several times
    rate = F.col("target") / F.col("source_size") / F.col("mean_tilt") * F.col("tilt")
    dealt = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
        .withColumn("inclusion", F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(max_repeats)), F.coalesce(rate, F.lit(0.0)))))
        .withColumn("certain", F.floor("inclusion"))
        .withColumn("part", F.col("inclusion") - F.col("certain"))
        .withColumn("odds", F.when(F.col("part") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))))
        .withColumn("fine", F.when(F.col("odds").isNotNull(), F.least(F.lit(bins * bins - 1), F.floor(bins * bins * F.col("odds") / (1 + F.col("odds"))))))
        .withColumn("coarse", F.floor(F.col("fine") / bins))
    )
    sure = F.sum(F.sum(F.col("certain") * F.col("size"))).over(Window.partitionBy("source"))
    coarse = dealt.groupBy("source", "coarse").agg(_filled("coarse").alias("cell"), (F.max("target") - sure).alias("budget")).withColumn("start", F.lit(0))
    marked = _with_cut(dealt, keep(_cuts(coarse, "coarse"), "mix-cuts"), "one")
    edge = F.coalesce(F.col("coarse") == F.col("one.bin"), F.lit(False))
    inner = marked.where(edge).groupBy("source", "fine").agg(_filled("fine").alias("cell"), F.max("one.budget").alias("budget"), F.max("one.before").alias("start"))
    marked = _with_cut(marked, keep(_cuts(inner, "fine"), "mix-cuts"), "two")
    last = edge & F.coalesce(F.col("fine") == F.col("two.bin"), F.lit(False))
    inside = Window.partitionBy("source", "fine").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    below = (F.col("coarse") < F.col("one.bin")) | (edge & (F.col("fine") < F.col("two.bin")))
    clear = marked.where(~last).withColumn("extra", F.coalesce(below.cast("long"), F.lit(0)))
    close = (
        marked.where(last)
        .withColumn("reach", F.col("two.before") + F.sum("size").over(inside) - F.col("size") / 2)
        .withColumn("extra", (F.col("reach") <= F.col("one.budget")).cast("long"))
        .drop("reach")
    )
    copies = (F.col("certain") + F.col("extra")).cast("long")
    return clear.unionByName(close).select("doc_id", "source", "size", "source_size", "target", "inclusion", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["document"] if carry else []))


#: The same mix in DuckDB, with one plain window over each source.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS digest,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM p),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN d.size = 0 THEN 0.0 ELSE least(2.0, t.target / t.source_size) END::DOUBLE AS inclusion,
         (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, d.digest, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, floor(inclusion) AS certain, inclusion - floor(inclusion) AS part FROM e),
q AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM o),
r AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS budget,
         sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds ASC NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS reach
  FROM q)
SELECT doc_id, source, size, source_size, target, inclusion,
       (certain + CASE WHEN odds IS NOT NULL AND reach <= budget THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((certain + CASE WHEN odds IS NOT NULL AND reach <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""


def op2_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """The mix over all of ``documents``, sources by code point weighing 5, 2, 1 and sharing 150 % of all words."""
    return pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
