"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

A document is the set of its runs of ``width`` words (a text with fewer words is
one shorter run). Documents with equal sets are one class with its smallest
doc_id as representative; all further work is on representatives.

1. Signatures are cut into bands; band and row counts are the least selective that
   reach the wanted recall at the threshold. Band hashes are shuffled and buckets
   of two or more kept.
2. Sets that share a bucket are verified on their full n-gram sets (``set_links``), block
   against block. In a large bucket the exact distance to a pivot settles most pairs: close
   copies cost one comparison each, and only pairs on the boundary are compared. Links are
   counted exactly either way, and a pair is counted once.
3. Components of the verified links are the classes of near duplicates.

Defined cases: null and empty texts have no n-grams, are never linked and are
their own class; repeated rows are copies of each other; rows with a null doc_id
are returned unlinked with a null class; several texts under one doc_id are
documents of their own, told apart by their sets; texts are whole, whatever their
length; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm import hot_join
from pairlight.llm.components import components
from pairlight.llm.hot_join import spread_join
from pairlight.llm.set_links import linked
from pairlight.llm.text_arrays import Texts, keyed, mix, repeats, steps, window_hash
from pairlight.scratch import keep

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 256


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows, so the fewest false candidates, that reach ``recall`` at ``threshold`` with ``most`` hashes."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the recall needs more hashes")


def ngram_sets(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the distinct n-grams, ordered by document."""
    words = t.word_hash()
    count = t.words_per_doc()
    first = np.cumsum(count) - count
    if len(words) >= width:
        start = np.flatnonzero(t.doc[: len(words) - width + 1] == t.doc[width - 1 :])
        doc, hashes = t.doc[start], window_hash(words, width)[start]
    else:
        doc, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for n in range(1, width):  # texts too short for one window
        short = np.flatnonzero(count == n)
        if len(short):
            doc = np.concatenate([doc, short])
            hashes = np.concatenate([hashes, window_hash(words, n)[first[short]]])
    order = np.argsort(doc, kind="stable")
    doc, hashes = doc[order], hashes[order]
    new = ~repeats(keyed(doc, hashes), later_only=True)
    return doc[new], hashes[new]


def set_keys(doc: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Two halves of a key of every set that has members."""
    seeds = np.random.default_rng(7).integers(0, 1 << 64, (2, 2), dtype=np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return [np.add.reduceat(mix(hashes ^ seeds[k, 0]), begin).view(np.int64) for k in (0, 1)]


def signatures(t: Texts, width: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents with n-grams; two key halves and the size of their sets; their band hashes."""
    doc, hashes = ngram_sets(t, width)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros((0, bands), np.int64),)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([begin, [len(doc)]]))
    seeds = np.random.default_rng(7).integers(0, 1 << 64, (bands * rows + 2, 2), dtype=np.uint64)
    keys = set_keys(doc, hashes)
    out = np.zeros((bands, len(begin)), np.uint64)
    for k in range(bands * rows):
        a, b = seeds[k + 2]
        low = np.minimum.reduceat((hashes ^ a) * (b | np.uint64(1)), begin)
        out[k // rows] = mix(out[k // rows] + low + np.uint64(k + 1))
    return doc[begin], keys[0], keys[1], size, out.T.copy().view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (hash of the text), k1, k2 (key of the n-gram set, null without n-grams), n, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                at, k1, k2, size, hashes = signatures(Texts(batch.column("text")), width, bands, rows)
                n = batch.num_rows
                missing = np.ones(n, bool)
                missing[at] = False
                full = [np.zeros(n, np.int64) for _ in range(3)]
                for f, v in zip(full, (k1, k2, size)):
                    f[at] = v
                lists = np.zeros(n + 1, np.int32)
                lists[1:][at] = bands
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(lists), pa.int32()), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(full[0], mask=missing), pa.array(full[1], mask=missing), pa.array(full[2]), listed], ["doc_id", "text_key", "k1", "k2", "n", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, k1 long, k2 long, n long, bands array<long>")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, set_id, n_copies, stays, text_key for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the component of verified links, set_id
    the smallest doc_id with an equal n-gram set, n_copies how many rows have that
    set, n_links how many other sets are at least ``threshold`` similar. stays is
    true for the rows of one document of each class (repeated rows all of them) and
    for rows without a class; text_key is xxhash64 of the text.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = keep(sign(docs, width, bands, rows), "ngram-signatures")
    filled = signed.where(F.col("k1").isNotNull() & F.col("doc_id").isNotNull())
    sets = filled.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = keep(sets.select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), "n_copies", "n", "bands"), "ngram-sets")
    named = sets.select(F.struct(F.col("rep").alias("v"), "k1").alias("s"), F.col("rep_key").alias("t"), "n", F.col("bands").alias("keys"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = linked(named, hot_join.once(texts, filled, ["doc_id", "text_key"]), lambda column: ngram_sets(Texts(column), width), threshold)
    links = found.groupBy("s").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("s").alias("a"), F.col("to").alias("b"))).select(F.col("v").alias("s"), "root")
    known = sets.select(F.struct(F.col("rep").alias("v"), "k1").alias("s"), "k1", "k2", "rep", "rep_key", "n_copies").join(links, "s", "left").join(classes, "s", "left")
    known = known.withColumn("own", F.coalesce(F.col("root") == F.col("s"), F.lit(True)))
    known = known.select(F.struct("k1", "k2").alias("set"), "rep", "rep_key", "n_copies", "n_links", "root", "own", F.col("n_copies").alias("m"))
    keyed_rows = signed.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull() & F.col("k1").isNotNull(), F.struct("k1", "k2")).alias("set"))
    out = spread_join(keyed_rows, keep(known, "ngram-known"), "set", "m", "left")
    kept = F.col("rep").isNull() | (F.col("own") & (F.col("doc_id") == F.col("rep")) & F.col("text_key").eqNullSafe(F.col("rep_key")))
    return out.select(
        "doc_id", F.coalesce("root.v", "rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", "doc_id").alias("set_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), kept.alias("stays"), "text_key",
    )


def op7_minhash_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all ``documents``: five words, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
