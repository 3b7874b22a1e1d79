"""Long runs in chunks: plan, resume, progress and forecast over tables.

A stage is an ordered list of items cut into chunks of a fixed size. Finished
chunks are rows of a log table; what is missing is an anti-join of the plan with
the log, so a stopped run goes on where it ended and no chunk runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlight.operators.keyed import offsets
from pairlight.scratch import keep

LOG = "stage string, chunk long, count long, first string, last string, expected_s double, started double, finished double"
RECENT_S = 7200
#: Chunks whose hashes are hashed together.
DIGEST_BLOCK = 4096
#: Megabytes that a run needs beside its features.
MARGIN_MB = 2000.0


def chunk_plan(items: DataFrame, stage: str, size: int, order: list, item: str, cost: DataFrame | None = None) -> DataFrame:
    """stage, chunk, item, pos, expected_s: items in order, ``size`` of them a chunk.

    Positions come from ``keyed.offsets``, so no task ever holds the whole list, and the
    dealt items are written: a second run of the range partitioning may draw other
    bounds, and its counts would not be those of the numbered rows. ``cost`` has set, seconds.
    """
    chosen = items.withColumn("item", F.col(item))
    seconds = chosen.withColumn("set", F.substring("item", 1, 1)) if "set" not in items.columns else chosen
    priced = seconds.join(cost, "set", "left").withColumn("expected_s", F.coalesce("seconds", F.lit(0.0))) if cost is not None else seconds.withColumn("expected_s", F.lit(0.0))
    placed = offsets(priced.select("item", "expected_s", F.struct(*order).alias("key")), ["key", "item"]).withColumnRenamed("offset", "pos")
    return placed.select(F.lit(stage).alias("stage"), F.floor(F.col("pos") / size).alias("chunk"), "item", F.col("pos").cast("long").alias("pos"), "expected_s")


def chunk_heads(plan: DataFrame) -> DataFrame:
    """stage, chunk, count, first, last, expected_s."""
    return plan.groupBy("stage", "chunk").agg(F.count(F.lit(1)).alias("count"), F.min_by("item", "pos").alias("first"), F.max_by("item", "pos").alias("last"), F.sum("expected_s").alias("expected_s"))


def checked_log(log: DataFrame, heads: DataFrame) -> DataFrame:
    """The log; a chunk that is not of this plan is an error."""
    known = heads.select("stage", "chunk", F.col("count").alias("h_count"), F.col("first").alias("h_first"), F.col("last").alias("h_last"))
    fits = (F.col("h_count") == F.col("count")) & (F.col("h_first") == F.col("first")) & (F.col("h_last") == F.col("last"))
    joined = log.join(known, ["stage", "chunk"], "left")
    return joined.withColumn("stage", F.when(F.coalesce(fits, F.lit(False)), F.col("stage")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not of this plan:"), "stage", F.col("chunk").cast("string"))))).drop("h_count", "h_first", "h_last")


def missing_chunks(heads: DataFrame, log: DataFrame) -> DataFrame:
    return heads.join(log.select("stage", "chunk"), ["stage", "chunk"], "left_anti")


def _digests(rows: DataFrame, by: list[str], order: str, value: str, **sums) -> DataFrame:
    """One SHA-256 a group of ``by`` over the group's values in order."""
    held = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.transform(held, lambda x: x[value])), 256).alias("digest"), *[F.sum(c).alias(n) for n, c in sums.items()])


def fingerprint(plan: DataFrame) -> DataFrame:
    """stage, items, chunks, digest: equal for equal plans.

    Items are hashed by chunk, chunks by ``DIGEST_BLOCK`` of them, and the blocks
    once more, so a row holds a chunk or a block and, at the top, one hash for
    ``DIGEST_BLOCK`` chunks.
    """
    chunks = _digests(plan.withColumn("one", F.lit(1)), ["stage", "chunk"], "pos", "item", items="one")
    numbered = chunks.select("stage", "chunk", "items", F.lit(1).alias("one"), F.floor(F.col("chunk") / DIGEST_BLOCK).alias("block"), F.col("digest").alias("of_chunk"))
    blocks = _digests(numbered, ["stage", "block"], "chunk", "of_chunk", items="items", chunks="one").withColumnRenamed("digest", "of_block")
    return _digests(blocks, ["stage"], "block", "of_block", items="items", chunks="chunks").select("stage", "items", "chunks", "digest")


def remaining(plan: DataFrame, log: DataFrame) -> DataFrame:
    """The plan's rows whose chunk is not in the log; what they give is one job, and lost tasks are Spark's to repeat."""
    return plan.join(log.select("stage", "chunk"), ["stage", "chunk"], "left_anti")


def log_rows(done: DataFrame, started: float, finished: float) -> DataFrame:
    """Rows to append to the log for plan rows whose results, marked with the same ``started``, are written."""
    return chunk_heads(done).select("*", F.lit(float(started)).alias("started"), F.lit(float(finished)).alias("finished"))


def checked_results(results: DataFrame, plan: DataFrame) -> DataFrame:
    """``results`` (stage, chunk, pos, item and others); chunks whose results are not the plan's items, each once and in its place, are an error."""
    told = results.select("stage", "chunk", "pos", "item").groupBy("stage", "chunk", "pos", "item").agg(F.count(F.lit(1)).alias("n"))
    asked = plan.join(results.select("stage", "chunk").distinct(), ["stage", "chunk"], "left_semi").select("stage", "chunk", "pos", F.col("item").alias("wanted"))
    met = told.join(asked, ["stage", "chunk", "pos"], "full_outer")
    bad = met.where("item is null or wanted is null or item != wanted or n > 1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("stage", "chunk")).alias("one"))
    # a filter, so that pruning columns cannot drop the check
    wrong = bad.where(F.when(F.col("n") > 0, F.raise_error(F.concat_ws(" ", F.lit("results do not match the plan, first in"), "one.stage", F.col("one.chunk").cast("string"))).cast("boolean")).otherwise(False))
    return results.unionByName(wrong.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema.fields]))


def commit(results: DataFrame, plan: DataFrame, path: str, log_path: str, started: float, finished: float) -> None:
    """Write the results of whole chunks and then their log rows.

    A chunk is a partition of both tables and a write replaces the partitions that it
    has rows for. Committing a chunk again, or once more after a failure between the two
    writes, leaves one copy of it; chunks without a log row count as not done. The
    results are checked against the plan before anything is replaced.
    """
    spark = results.sparkSession
    held = keep(checked_results(results, plan), "chunk-results")
    write = lambda df, to: df.repartition("stage", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "chunk").parquet(to)
    write(held, path)
    done = plan.join(held.select("stage", "chunk").distinct(), ["stage", "chunk"], "left_semi")
    write(log_rows(done, started, finished), log_path)
    spark.catalog.refreshByPath(path)


def committed(spark, path: str, log_path: str, schema: str) -> DataFrame:
    """The results of all chunks that have a log row; ``schema`` is that of the results."""
    results, log = spark.read.schema(schema).parquet(path), spark.read.schema(LOG).parquet(log_path)
    return results.join(log.select("stage", "chunk"), ["stage", "chunk"], "left_semi")


def stage_results(results: DataFrame, log: DataFrame) -> DataFrame:
    """Result rows of logged chunks, of the attempt that the log names."""
    return results.join(log.select("stage", "chunk", "started"), ["stage", "chunk", "started"], "left_semi")


def pace(heads: DataFrame, log: DataFrame, stages: DataFrame, now: float, workers: int) -> DataFrame:
    """stage, factor: actual by expected seconds.

    From the stage's chunks of the last two hours if there are as many as
    workers, else from all its chunks, else from stages of its algorithm and kind
    (``stages``: stage, algorithm, kind), else 1.
    """
    took = log.withColumn("took", F.col("finished") - F.col("started")).withColumn("recent", F.col("finished") > F.lit(now - RECENT_S))
    ratio = lambda a, b: F.when(b > 0, a / b)
    own = took.groupBy("stage").agg(
        ratio(F.sum("took"), F.sum("expected_s")).alias("own"),
        F.when(F.count_if("recent") >= workers, ratio(F.sum(F.when(F.col("recent"), F.col("took"))), F.sum(F.when(F.col("recent"), F.col("expected_s"))))).alias("new"),
    )
    like = took.join(stages, "stage").groupBy("algorithm", "kind").agg(ratio(F.sum("took"), F.sum("expected_s")).alias("like"))
    return stages.join(own, "stage", "left").join(like, ["algorithm", "kind"], "left").select("stage", F.coalesce("new", "own", "like", F.lit(1.0)).alias("factor"))


def progress(heads: DataFrame, log: DataFrame, stages: DataFrame, now: float, workers: int) -> DataFrame:
    """stage, items, items_done, chunks, chunks_done, remaining_s, duration_s."""
    planned = heads.groupBy("stage").agg(F.sum("count").alias("items"), F.count(F.lit(1)).alias("chunks"), F.sum("expected_s").alias("expected"))
    done = log.groupBy("stage").agg(F.sum("count").alias("items_done"), F.count(F.lit(1)).alias("chunks_done"), F.sum("expected_s").alias("spent"), F.min("started").alias("first_start"), F.max("finished").alias("last_finish"))
    none = F.lit(0)
    joined = planned.join(done, "stage", "left").join(pace(heads, log, stages, now, workers), "stage").withColumn("chunks_done", F.coalesce("chunks_done", none)).withColumn("left", F.col("chunks") - F.col("chunks_done"))
    remaining = F.when(F.col("left") > 0, (F.col("expected") - F.coalesce("spent", F.lit(0.0))) * F.col("factor") / F.least(F.lit(workers), F.col("left"))).otherwise(0.0)
    duration = F.col("expected") * F.col("factor") / F.least(F.lit(workers), F.greatest(F.lit(1), F.col("chunks")))
    return joined.select("stage", "items", F.coalesce("items_done", none).cast("long").alias("items_done"), "chunks", "chunks_done", remaining.alias("remaining_s"), F.greatest(duration, remaining).alias("duration_s"), "first_start", "last_finish")


def overall(table: DataFrame) -> DataFrame:
    """remaining_s, percent of a progress table."""
    share = 100 * (1 - F.sum("remaining_s") / F.sum("duration_s"))
    return table.agg(F.sum("remaining_s").alias("remaining_s"), F.when(F.sum("duration_s") > 0, share).otherwise(100.0).alias("percent"))


def runtime(log: DataFrame) -> DataFrame:
    """stage, items, worker_seconds, first_start, last_finish."""
    return log.groupBy("stage").agg(F.sum("count").alias("items"), F.round(F.sum(F.col("finished") - F.col("started")), 1).alias("worker_seconds"), F.min("started").alias("first_start"), F.max("finished").alias("last_finish"))


def disk_need(table: DataFrame, sizes: DataFrame, margin: float = MARGIN_MB) -> DataFrame:
    """needed_mb: what the items left of a progress table will write; ``sizes`` has stage, item_mb, and a stage without a size writes nothing."""
    left = (F.col("items") - F.col("items_done")) * F.coalesce("item_mb", F.lit(0.0))
    return table.join(sizes, "stage", "left").agg((F.coalesce(F.sum(left), F.lit(0.0)) + F.lit(float(margin))).alias("needed_mb"))


def hours(designs: DataFrame, timings: DataFrame, walls: DataFrame) -> DataFrame:
    """design, images, comparisons, single_thread_hours, parallel_hours.

    timings: kind (extract or compare), seconds of one item in one thread. walls:
    kind, items, seconds of a parallel run. Both give one row of numbers.
    """
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    single = timings.agg(*[F.avg(of(k, F.col("seconds"))).alias(f"{k}_s") for k in ("extract", "compare")])
    rate = walls.agg(*[(F.sum(of(k, F.col("items"))) / F.sum(of(k, F.col("seconds")))).alias(f"{k}_rate") for k in ("extract", "compare")])
    both = designs.join(single.join(rate), how="cross")  # a row
    one = (F.col("images") * F.col("extract_s") + F.col("comparisons") * F.col("compare_s")) / 3600
    many = (F.col("images") / F.col("extract_rate") + F.col("comparisons") / F.col("compare_rate")) / 3600
    return both.select("design", "images", "comparisons", F.round(one, 2).alias("single_thread_hours"), F.round(many, 2).alias("parallel_hours"))
