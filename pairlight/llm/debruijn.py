"""Repeated spans by De Bruijn compaction of word windows, and their removal.

Every window of ``width`` words is an edge between its first and its last
``width - 1`` words. An edge that occurs again is repeated; what is repeated is
kept only where it starts first (smallest doc_id, then smallest start).

1. Windows are grouped into runs that share a minimiser (the smallest hash of the
   shorter word runs inside the window), so equal windows always meet in the
   bucket of their minimiser and a run costs one row. Before the shuffle each step
   of a task drops windows it has seen: only the first of a step travels, so a
   passage that very many documents share sends a row a step and not a row a
   document. What a text repeats of itself refers to its occurrence before, so a word or line
   over and over is one piece; all else refers to the first. A minimiser that more windows share than a bucket may hold is hot, and its
   windows are dealt by minimiser and window together, since only equal windows must
   meet. Which are hot is told by a sample of the documents; it decides how windows are
   dealt and never what is found, and the bound of a bucket is the same for any corpus.
2. A bucket's runs arrive sorted by coordinate. Its first occurrence of an edge is
   the source; every later one is repeated. Successive repeated edges whose
   sources also succeed each other form a path that does not branch between the
   copy and its source, and are compacted to one piece with both coordinates.
3. Pieces that continue each other, in the document and in the source, are compacted into
   paths by joins: one finds where paths begin and end, one puts the two ends together.
4. The texts are dealt once more, with what is asked of each: the words of a span at
   the copy and at the source. Both sides answer with a 128-bit digest of the words
   themselves, in blocks of the source, so that a source answers a bounded number
   of questions a word. The same pass removes the spans.

Edges are told apart by hashes (64 bits of the minimiser, 40 of the window). Two
different windows under one hash would make some span differ from its source, so
when all spans are found equal at both coordinates the result is exact; when one
is not, the work is done again with other hashes.

Defined cases: null and empty texts and texts with fewer than ``width`` words have
no windows and lose nothing; a null doc_id counts as smaller than all others; rows
that share a doc_id and a text are one document given twice, and neither is the
earlier one of the other; different texts under one doc_id, or without one, are
different documents, in the order of their SHA-256; whole texts are used; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.text_arrays import Texts, mix, steps, window_hash
from pairlight.scratch import keep

WIDTH, INNER = 20, 5
#: Bytes of text in one step, inside which repeated windows are dropped before the shuffle.
STEP = 8 << 20
CODE_BYTES = 5
#: Windows of a bucket; one of SAMPLE documents is counted, and a minimiser with an estimate over half of HOT is hot. Beyond MOST hot ones every window is dealt by itself.
HOT, SAMPLE, MOST = 1 << 20, 16, 1 << 20
_CODE = np.uint64((1 << 8 * CODE_BYTES) - 1)
NULL_ID = np.iinfo(np.int64).min
#: Windows of a source in a block of the comparison, and sets of hashes to try.
BLOCK, SEEDS = 64, 8
RUNS = "bucket long, doc long, start int, n int, codes binary, src_doc long, src_start int"
PIECES = "doc long, start int, n int, src_doc long, src_start int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs_of(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``change[i]`` says that entry i + 1 begins a run."""
    begin = np.concatenate([[0], np.flatnonzero(change) + 1])
    return begin, np.diff(np.concatenate([begin, [len(change) + 1]]))


def pieces(doc: np.ndarray, start: np.ndarray, src_doc: np.ndarray, src_start: np.ndarray) -> list[np.ndarray]:
    """Compact windows in order into (doc, start, n, src_doc, src_start)."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 5
    change = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src_start[1:] != src_start[:-1] + 1)
    at, n = runs_of(change)
    return [doc[at], start[at], n, src_doc[at], src_start[at]]


def _batch(bucket, doc, start, n, codes, src_doc, src_start) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([bucket, pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), codes, src_doc, src_start], ["bucket", "doc", "start", "n", "codes", "src_doc", "src_start"])


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in the sorted list."""
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def step_runs(batch: pa.RecordBatch, width: int, inner: int, hot: np.ndarray | None = None, seed: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs to be dealt by bucket, and pieces that the step itself has resolved (codes null). ``hot`` lists the minimisers whose windows are dealt one by one, none of them for all."""
    ids = batch.column("doc").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    t = Texts(batch.column("text").take(pa.array(order)))
    words = t.word_hash(seed)
    if len(words) < width:
        return
    first = np.flatnonzero(t.doc[: len(words) - width + 1] == t.doc[width - 1 :])
    if not len(first):
        return
    edge = window_hash(words, width)[first]
    bucket = sliding_min(window_hash(words, inner), width - inner + 1)[first]
    if hot is not None:
        bucket = np.where(_among(bucket, hot) if len(hot) else True, mix(bucket ^ mix(edge)), bucket)
    count = t.words_per_doc()
    row = t.doc[first]
    doc, start = ids[row], first - (np.cumsum(count) - count)[row]
    # equal edges by one sort of their upper bits with the position below; coordinates ascend with the position
    bits = np.uint64(max(1, int(len(edge) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((edge & ~low) | np.arange(len(edge), dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    begins = np.concatenate([[True], (packed[1:] ^ packed[:-1]) > low])
    source = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
    again = (at != source) & (edge[at] == edge[source])
    # the one before in the same text, if any, goes for the first of all: words that cycle then follow each other at their source too, and are one piece
    before = np.concatenate([at[:1], at[:-1]])
    near = again & (row[at] == row[before]) & (edge[at] == edge[before])
    at, source = at[again], np.where(near, before, source)[again]
    known = np.zeros(len(edge), bool)
    known[at] = True
    later = (doc[at] != doc[source]) | (start[at] != start[source])
    at, source = at[later], source[later]
    order = np.argsort(at)
    at, source = at[order], source[order]
    d, s, n, sd, ss = pieces(doc[at], start[at], doc[source], start[source])
    if len(d):
        yield _batch(pa.array(mix(d.astype(np.uint64)).view(np.int64)), d, s, n, pa.nulls(len(d), pa.binary()), pa.array(sd, pa.int64()), pa.array(ss, pa.int32()))
    fresh = np.flatnonzero(~known)
    if not len(fresh):
        return
    change = (row[fresh][1:] != row[fresh][:-1]) | (first[fresh][1:] != first[fresh][:-1] + 1) | (bucket[fresh][1:] != bucket[fresh][:-1])
    begin, n = runs_of(change)
    body = (edge[fresh] & _CODE).view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()
    offsets = np.concatenate([[0], np.cumsum(n)]) * CODE_BYTES
    codes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
    head = fresh[begin]
    yield _batch(pa.array(bucket[head].view(np.int64)), doc[head], start[head], n, codes, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32()))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a stream of runs sorted by bucket and coordinate. Held over a batch: the sources of one bucket."""
    names = ["doc", "start", "n", "src_doc", "src_start"]
    held_bucket, held = None, None  # held: sorted codes, their documents and starts
    for batch in batches:
        done = batch.filter(pc.is_null(batch.column("codes")))
        if done.num_rows:
            yield done.select(names)
        batch = batch.filter(pc.is_valid(batch.column("codes")))
        if not batch.num_rows:
            continue
        bucket, doc, start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "doc", "start", "n"))
        column = batch.column("codes")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, CODE_BYTES)
        code = np.zeros((len(raw), 8), np.uint8)
        code[:, :CODE_BYTES] = raw
        code = code.view(np.uint64).ravel()
        group = np.concatenate([[0], np.cumsum(bucket[1:] != bucket[:-1])])
        step = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        doc, start, group = np.repeat(doc, n), np.repeat(start, n) + step, np.repeat(group, n)
        if held_bucket == bucket[0]:  # its sources come first again
            code, doc, start, group = (np.concatenate([a, b]) for a, b in ((held[0], code), (held[1], doc), (held[2], start), (np.zeros(len(held[0]), np.int64), group)))
        carried = len(held[0]) if held_bucket == bucket[0] else 0
        key = code | group.astype(np.uint64) << np.uint64(8 * CODE_BYTES)
        order = np.argsort(key, kind="stable")
        begins = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        source = np.empty(len(order), np.int64)
        source[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        later = (doc != doc[source]) | (start != start[source])
        later[:carried] = False
        at = np.flatnonzero(later)
        found = pieces(doc[at], start[at], doc[source[at]], start[source[at]])
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names)
        last = np.flatnonzero((source == np.arange(len(source))) & (group == group[-1]))
        held_bucket, held = bucket[-1], (code[last], doc[last], start[last])


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text: doc orders the documents, and is the doc_id itself unless that is null or names several rows.

    Otherwise rows are ranked by doc_id (nulls first) and text; positions come
    from a range partitioning, so no task holds them all.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    ranged = keep(named.select("key", "digest").distinct().repartitionByRange("key", "digest").withColumn("part", F.spark_partition_id()), "span-documents")
    sizes = ranged.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "digest"))
    ranks = ranged.withColumn("place", place).join(sizes.select("part", before.alias("offset")), "part").select("key", "digest", (F.col("place") + F.col("offset")).cast("long").alias("doc"))
    return named.join(ranks, ["key", "digest"]).select("doc", "doc_id", "text")


def hot_minimisers(texts: DataFrame, width: int = WIDTH, inner: int = INNER, seed: int = 0) -> np.ndarray | None:
    """Sorted minimisers of too many windows, by one of SAMPLE documents and what their steps do not resolve; None if there are none, empty if there are too many to list.

    A minimiser over the bound is missed only if few documents have most of its
    windows, and then these documents bound what its bucket holds.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, limit=STEP):
                for runs in step_runs(batch, width, inner, None, seed):
                    runs = runs.filter(pc.is_valid(runs.column("codes")))
                    bucket, at = np.unique(runs.column("bucket").to_numpy(), return_inverse=True)
                    n = np.bincount(at, weights=runs.column("n").to_numpy(), minlength=len(bucket)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).select("doc", "text")
    counted = some.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") * SAMPLE > HOT / 2).select("bucket").limit(MOST + 1).toPandas().bucket.to_numpy(np.int64)
    return None if not len(got) else np.zeros(0, np.uint64) if len(got) > MOST else np.sort(got.view(np.uint64))


def dealt_runs(texts: DataFrame, width: int = WIDTH, inner: int = INNER, seed: int = 0) -> DataFrame:
    """The runs of all steps; equal windows that are left have equal buckets."""
    hot = hot_minimisers(texts, width, inner, seed)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, limit=STEP):
                yield from step_runs(batch, width, inner, hot, seed)

    return texts.select("doc", "text").mapInArrow(edges, RUNS)


def repeated_spans(texts: DataFrame, width: int = WIDTH, inner: int = INNER, seed: int = 0) -> DataFrame:
    """doc, start, n (windows), src_doc, src_start: the compacted paths that occur earlier by their hashes, words counted from 0.

    ``texts`` has doc and text (see ``numbered``). A span covers the words from start to start + n + width - 2.
    """
    dealt = dealt_runs(texts, width, inner, seed).repartition("bucket").sortWithinPartitions("bucket", "doc", "start")
    return compacted(keep(dealt.mapInArrow(_resolve, PIECES), "span-pieces"))


def compacted(found: DataFrame) -> DataFrame:
    """Paths of ``found`` (PIECES): pieces that continue each other in the document and in the source are one, by joins.

    A piece that no other leads to begins a path and one that leads to no other ends
    it; paths on one diagonal of a document and its source do not overlap, so the k-th
    beginning and the k-th end there are those of one path.
    """
    line = ["doc", "src_doc", "diagonal"]
    piece = found.select("doc", "src_doc", (F.col("src_start") - F.col("start")).alias("diagonal"), "start", (F.col("start") + F.col("n")).alias("stop"))
    side = lambda at, name: piece.select(*line, F.col(at).alias("at"), F.lit(True).alias(name))
    loose = keep(side("start", "begins").join(side("stop", "ends"), [*line, "at"], "full_outer").where("begins is null or ends is null"), "span-ends")
    begins, ends = loose.where("begins").select(*line, F.col("at").alias("start")), loose.where("ends").select(*line, F.col("at").alias("stop"))
    nth = lambda rows, at: rows.withColumn("k", F.row_number().over(Window.partitionBy(*line).orderBy(at)))
    paths = nth(begins, "start").join(nth(ends, "stop"), [*line, "k"])
    return paths.select("doc", "start", (F.col("stop") - F.col("start")).cast("int").alias("n"), "src_doc", (F.col("start") + F.col("diagonal")).cast("int").alias("src_start"))


def questions(spans: DataFrame) -> DataFrame:
    """What is asked of each text, in blocks of the source: kind 1 at the copy, kind 2 at the source (each once)."""
    first, last = F.floor(F.col("src_start") / BLOCK), F.floor((F.col("src_start") + F.col("n") - 1) / BLOCK)
    cut = spans.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("src_start"), F.col("block") * BLOCK)
    high = F.least(F.col("src_start") + F.col("n"), (F.col("block") + 1) * BLOCK)
    cut = cut.select("doc", (F.col("start") + low - F.col("src_start")).cast("int").alias("start"), (high - low).cast("int").alias("n"), "src_doc", low.cast("int").alias("src_start"))
    there = cut.select("src_doc", "src_start", "n").distinct().select(F.col("src_doc").alias("doc"), F.col("src_start").alias("start"), "n", "src_doc", "src_start", F.lit(2).alias("kind"))
    return cut.withColumn("kind", F.lit(1)).unionByName(there)


_ANSWERS = "kind int, doc_id long, n_words long, n_removed long, kept string, src_doc long, src_start int, n int, words binary"


def answered(texts: DataFrame, spans: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """One pass over the texts and what is asked of them.

    Rows of kind 0 are the texts without their spans (``kept``: the words left,
    joined by one space, or its SHA-256 if ``digest``); rows of kind 1 and 2 are
    digests of words at copies and sources. A task holds one text at a time.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = texts.select("doc", F.lit(0).alias("kind"), "doc_id", "text", nothing("int").alias("start"), nothing("int").alias("n"), nothing("long").alias("src_doc"), nothing("int").alias("src_start"))
    asked = questions(spans).select("doc", "kind", nothing("long").alias("doc_id"), nothing("string").alias("text"), "start", "n", "src_doc", "src_start")
    dealt = rows.unionByName(asked).repartition("doc").sortWithinPartitions("doc", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _ANSWERS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        out: list[tuple] = []
        held, size = None, 0  # held: document, ids of its rows, words, which of them stay

        def close():
            _, ids, words, stay = held
            left = b" ".join(words) if stay.all() else b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
            kept = hashlib.sha256(left).hexdigest() if digest else left.decode()
            out.extend((0, i, len(words), int(len(words) - stay.sum()), kept, None, None, None, None) for i in ids)
            return len(kept)

        for batch in batches:
            columns = [batch.column(c) for c in ("doc", "kind", "doc_id", "text", "start", "n", "src_doc", "src_start")]
            docs, kind, starts, ns, src_docs, src_starts = (columns[k].to_numpy(zero_copy_only=False) if k < 2 else columns[k].to_pylist() for k in (0, 1, 4, 5, 6, 7))
            for k in range(batch.num_rows):
                if kind[k] == 0:
                    if held is None or held[0] != docs[k]:
                        if held is not None:
                            size += close()
                        words = (columns[3][k].as_py() or "").encode().split()
                        held = docs[k], [], words, np.ones(len(words), bool)
                    held[1].append(columns[2][k].as_py())
                else:
                    _, _, words, stay = held
                    at, to = starts[k], starts[k] + ns[k] + width - 1
                    if kind[k] == 1:
                        stay[at:to] = False
                    out.append((int(kind[k]), None, None, None, None, src_docs[k], src_starts[k], ns[k], hashlib.blake2b(b" ".join(words[at:to]), digest_size=16).digest()))
                if len(out) >= 4096 or size > STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if held is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return dealt.mapInArrow(run, _ANSWERS)


def differing(answers: DataFrame) -> DataFrame:
    """src_doc, src_start, n of the blocks whose words are not the same at all coordinates."""
    compared = answers.where("kind > 0").groupBy("src_doc", "src_start", "n").agg(F.min("words").alias("low"), F.max("words").alias("high"))
    return compared.where("low != high").select("src_doc", "src_start", "n")


def remove_repeats(docs: DataFrame, width: int = WIDTH, inner: int = INNER, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (or kept_sha256 if ``digest``) of every row of ``docs`` (doc_id, text).

    Runs the search, and the comparison of all spans with the words at their
    sources; where any differs, both once more with other hashes.
    """
    texts = numbered(docs)
    for seed in range(SEEDS):
        spans = keep(repeated_spans(texts, width, inner, seed), "spans")
        answers = keep(answered(texts, spans, width, digest), "span-answers")
        if not differing(answers).limit(1).count():
            return answers.where("kind = 0").select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept"))
    raise RuntimeError("equal hashes of different windows under every seed")


def op3_debruijn_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the windows of 20 words that start earlier elsewhere."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
