"""MinHash near-duplicates by bottom-k sketches: one hash function, inverted lists, exact verification.

A document is the set of its runs of four words, with A-Z lower-cased (a text with
fewer words is one shorter run). Documents with equal sets are one vertex.

1. The sketch of a set is its k smallest hashes, all by one hash function. Two sets of
   similarity J share about J * k values of the k smallest of their union; ``least_shared``
   gives the number t that they share but for one pair in ``1 / MISS``.
2. Retained values are inverted into lists. Two sketches that share t values share one of the
   ``size - t + 1`` rarest of each, so a set joins only the lists of those: values that
   one set alone retains need no list, and common passages, whose lists are the longest, serve
   only sets that have hardly anything else. A set with fewer than t values that others
   retain has no near-duplicate and goes no further.
3. Sets that meet in a list are compared block against block (``set_links``): first by the estimate
   from the union of both sketches, then, where that reaches t / k, by the exact Jaccard
   similarity of the full sets. In a large group the exact distance to a pivot settles most
   pairs without a comparison.
4. Components of the links by Spark joins.

Defined cases: null and empty texts have no words, an empty set, and are linked with
nothing; repeated rows are linked; rows with a null doc_id are returned unlinked, kept,
with a null component; several texts under one doc_id are documents of their own, told
apart by their sets; texts are whole, whatever their length; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm import hot_join
from pairlight.llm.components import components
from pairlight.llm.hot_join import spread_join
from pairlight.llm.ngram_join import ngram_sets, set_keys
from pairlight.llm.set_links import linked
from pairlight.llm.text_arrays import Texts, steps
from pairlight.scratch import keep

#: Values a sketch retains; share of the pairs at exactly the threshold that may share fewer than ``least_shared``.
K, MISS = 32, 1e-6
WIDTH, THRESHOLD = 4, 0.8


def least_shared(k: int, threshold: float, miss: float = MISS) -> int:
    """The largest t of which k draws, each kept with chance ``threshold``, keep fewer with a chance of ``miss`` at most; draws without replacement vary less."""
    total, t = 0.0, 0
    while t < k:
        total += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def shingles(width: int):
    """Documents and hashes of the distinct runs of ``width`` lower-cased words."""
    return lambda texts: ngram_sets(Texts(pc.ascii_lower(pc.fill_null(texts, ""))), width)


def sketch(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, text_key (hash of the text), k1, k2 (key of the set, null if empty), n (its size), sketch (its k smallest hashes, ascending as unsigned)."""
    members = shingles(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                rows = batch.num_rows
                doc, hashes = members(batch.column("text"))
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                n = np.bincount(doc, minlength=rows)
                kept = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] < k
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[kept].view(np.int64)))
                keys = [np.zeros(rows, np.int64) for _ in range(2)]
                if len(doc):
                    for full, key in zip(keys, set_keys(doc, hashes)):
                        full[n > 0] = key
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(x, mask=n == 0) for x in keys), pa.array(n, pa.int64()), listed], ["doc_id", "text_key", "k1", "k2", "n", "sketch"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, k1 long, k2 long, n long, sketch array<long>")


def rare_lists(sets: DataFrame, k: int, threshold: float, t: int) -> DataFrame:
    """s, t, n, keys of the sets that can have a near-duplicate: the rarest of their retained values, as many as a similar set cannot miss.

    ``sets`` has s, t, n, sketch.
    """
    need = F.least(F.lit(t), F.ceil(F.col("n") * F.lit(threshold) - 1e-9)).cast("int")
    values = sets.select("s", F.explode("sketch").alias("value"))
    lists = keep(values.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value", "m", F.col("m").alias("held")), "sketch-lists")
    told = spread_join(values, lists, "value", "m").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("told"))  # k values at most
    rare = sets.drop("sketch").join(told, "s").withColumn("need", need).where(F.size("told") >= F.col("need"))
    chosen = F.slice("told", F.lit(1), F.size("told") - F.col("need") + 1)
    return rare.select("s", "t", "n", F.transform(chosen, lambda x: x["value"]).alias("keys"))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text): kept is true for the smallest doc_id of a component."""
    t = least_shared(k, threshold)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    drawn = keep(sketch(texts, width, k), "sketch-rows")
    filled = drawn.where(F.col("k1").isNotNull() & F.col("doc_id").isNotNull())
    sets = filled.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = keep(sets.select(F.struct(F.col("first.doc_id").alias("v"), "k1").alias("s"), F.struct("k1", "k2").alias("set"), F.col("first.text_key").alias("t"), "m", "n", "sketch"), "sketch-sets")
    candidates = keep(rare_lists(sets.select("s", "t", "n", "sketch"), k, threshold, t), "sketch-candidates")
    found = linked(candidates, hot_join.once(texts, filled, ["doc_id", "text_key"]), shingles(width), threshold, sketch=k, least=t / k)
    classes = components(found.select(F.col("s").alias("a"), F.col("to").alias("b")))
    known = sets.select("s", "set", "m").join(classes.select(F.col("v").alias("s"), "root"), "s", "left")
    known = keep(known.select("set", "m", F.coalesce("root.v", "s.v").alias("component_id")), "sketch-known")
    rows = drawn.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & F.col("k1").isNotNull(), F.struct("k1", "k2")).alias("set"))
    out = spread_join(rows, known, "set", "m", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_bottom_k_sketches(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all ``documents``: four words, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
