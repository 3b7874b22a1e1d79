"""Links between sets that share a candidate key, verified on the full sets, without all pairs of a hot group.

A set is named by ``s``, a struct (v, k1) of its representative's doc_id and a hash
of the set, and comes with its keys (band hashes, retained values of a sketch).

1. A set's home is the largest of its buckets. A home of few sets is one block.
2. A larger home gets a pivot, the set with most company in it, and every member's exact
   Jaccard distance to the pivot: one comparison a member. That distance is a metric,
   so two members whose distances to the pivot add up to no more than the threshold's
   distance are linked, and two whose distances differ by more than it are not. Members are
   dealt to blocks by cells of their distance; pairs of cells that are certain are
   counted and never compared, so a group of close copies costs a comparison a member.
3. What is left, pairs of blocks on the boundary and pairs of blocks of different homes that
   share a bucket, is compared block against block inside a task, on the full sets.

Groups return a number of links for each member and the first member that its links reach,
never pairs of sets. A pair of sets meets once, so links are counted once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.hot_join import spread_join
from pairlight.llm.text_arrays import steps
from pairlight.scratch import keep

#: Bounds of a block: rows, and bytes of member hashes. A home that has the members is dealt to FEW blocks of EVEN rows at least, so that no task has most of it.
BLOCK_ROWS, BLOCK_BYTES, FEW, EVEN = 1024, 24 << 20, 16, 128
#: Cells of a distance between 0 and 1.
CELLS = 50
_COLUMNS = 2048

#: From a column of texts: the document of each member of its set, ascending, and the member's hash.
Members = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sets_of(texts: pa.Array, members: Members) -> list[np.ndarray]:
    """The hashes of each text's set."""
    doc, hashes = members(texts)
    return np.split(hashes, np.searchsorted(doc, np.arange(1, len(texts)))) if len(texts) else []


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by a matrix product over blocks of shared members."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    chosen = shared[column]
    owner, column = owner[chosen], number[column[chosen]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        block = np.zeros((m, _COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def estimated(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Jaccard estimates from the union of two bottom-k sketches: of all values up to the smaller of both sketches' largest, the share that both have."""
    sketches = [np.partition(s, k - 1)[:k] if len(s) > k else s for s in sets]
    last = np.array([s.max() if len(s) == k else np.iinfo(np.uint64).max for s in sketches], np.uint64)
    padded = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(padded, sketches):
        row[: len(s)] = s
    size = np.array([len(s) for s in sketches])
    both = overlaps(sketches)
    out = np.zeros(both.shape, np.float32)
    i, j = np.nonzero(np.triu(both, 1))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        limit = np.minimum(last[a], last[b])[:, None]
        seen = [np.minimum((padded[x] <= limit).sum(1), size[x]) for x in (a, b)]
        common = both[a, b]
        out[a, b] = out[b, a] = common / (seen[0] + seen[1] - common)
    return out


def link_group(block: np.ndarray, sets: list[np.ndarray], cross: bool, threshold: float, sketch: int = 0, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For each member its links (between the two blocks if ``cross``) and the first member its links reach.

    With ``sketch`` only pairs are verified whose estimate from sketches of that size is ``least`` or more.
    """
    m = len(sets)
    maybe = estimated(sets, sketch) >= least if sketch else np.ones((m, m), bool)
    if cross:
        maybe &= block[:, None] != block[None, :]
    np.fill_diagonal(maybe, False)
    some = np.flatnonzero(maybe.any(1))
    linked = np.zeros((m, m), bool)
    if len(some):
        size = np.array([len(sets[k]) for k in some], np.float64)
        inside = overlaps([sets[k] for k in some]).astype(np.float64)
        linked[np.ix_(some, some)] = inside >= threshold * (size[:, None] + size[None, :] - inside) - 1e-9
        linked &= maybe
    reach = np.arange(m)
    while True:
        near = np.where(linked, reach[None, :], m).min(1, initial=m)
        after = np.minimum(reach, near)
        if (after == reach).all():
            return linked.sum(1), reach
        reach = after


def _held(batches: Iterator[pa.RecordBatch], key: list[str], members: Members, rest: list[str]) -> Iterator[tuple[tuple, tuple, np.ndarray]]:
    """Key, the other columns and the set of every row, a step of texts at a time."""
    for whole in batches:
        for batch in steps(whole):
            yield from zip(zip(*(batch.column(c).to_pylist() for c in key)), zip(*(batch.column(c).to_pylist() for c in rest)), sets_of(batch.column("text"), members))


def verified(rows: DataFrame, members: Members, threshold: float, sketch: int = 0, least: float = 0.0) -> DataFrame:
    """s (a member), links, to (the first member it reaches) from rows (i, j, place, v, k1, text), one group for each pair of blocks i, j."""
    names = ["v", "k1", "links", "to_v", "to_k1"]

    def close(key, held):
        if len(held) < 2:
            return None
        named = sorted(held)
        v, k1 = np.array(named, np.int64).T
        block = np.array([held[s][0] == key[0] for s in named])
        links, reach = link_group(block, [held[s][1] for s in named], key[0] != key[1], threshold, sketch, least)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (v, k1, links.astype(np.int64), v[reach], k1[reach])], names) if some.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for here, (place, v, k1), found in _held(batches, ["i", "j"], members, ["place", "v", "k1"]):
            if here != key:
                if (done := close(key, held)) is not None:
                    yield done
                key, held = here, {}
            held.setdefault((v, k1), (place, found))
        if (done := close(key, held)) is not None:
            yield done

    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j").select("i", "j", "place", "v", "k1", "text")
    out = dealt.mapInArrow(run, "v long, k1 long, links long, to_v long, to_k1 long")
    return out.select(F.struct("v", "k1").alias("s"), "links", F.struct(F.col("to_v").alias("v"), F.col("to_k1").alias("k1")).alias("to"))


def measured(rows: DataFrame, members: Members, threshold: float) -> DataFrame:
    """s, cell (of the distance to the pivot) and near (linked to it) from rows (block, first, v, k1, text); the pivot comes with first = 0 in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for here, (first, v, k1), found in _held([batch], ["block"], members, ["first", "v", "k1"]):
                if here != key:
                    if first:
                        raise RuntimeError("a block without its pivot")
                    key, pivot = here, np.sort(found)
                if first:
                    at = np.minimum(np.searchsorted(pivot, found), len(pivot) - 1)
                    common = int((pivot[at] == found).sum())
                    union = len(pivot) + len(found) - common
                    out.append((v, k1, CELLS * (union - common) // union, common >= threshold * union - 1e-9))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["v", "k1", "cell", "near"])

    dealt = rows.repartition("block").sortWithinPartitions("block", "first").select("block", "first", "v", "k1", "text")
    return dealt.mapInArrow(run, "v long, k1 long, cell int, near boolean").select(F.struct("v", "k1").alias("s"), "cell", "near")


def blocks_for(rows: str, hashes: str):
    """How many blocks hold so many sets with so many members."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(hashes) * 8 / BLOCK_BYTES), F.least(F.ceil(F.col(rows) / EVEN), F.lit(FEW))).cast("int")


def _named(*parts) -> F.col:
    return F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def texts_of(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """s and text of the sets in ``homes`` (s, t): of rows with one doc_id and text, any.

    ``docs`` has doc_id, text_key, text. Merged at every size: the sets grow with the corpus, so a broadcast that fits today is no plan for tomorrow.
    """
    named = homes.select("s", F.col("s.v").alias("v"), "t").hint("merge")
    return docs.join(named, (F.col("doc_id") == F.col("v")) & (F.col("text_key") == F.col("t"))).dropDuplicates(["doc_id", "text_key"]).select("s", "text")


def linked(sets: DataFrame, docs: DataFrame, members: Members, threshold: float, *, sketch: int = 0, least: float = 0.0) -> DataFrame:
    """s, links, to: links of sets with the rows of one s to be added up, and edges (s, to) that connect all linked sets.

    ``sets`` has s, t (hash of the text of a document that has the set), n (its
    size) and keys; sets without a common key are not brought together on purpose. ``docs`` has doc_id, text_key, text.
    """
    spread = sets.select("s", "t", "n", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("s").alias("hub"), F.count(F.lit(1)).alias("members"), F.count(F.lit(1)).alias("m")).where("m > 1")
    company = keep(spread_join(spread, keep(buckets, "link-buckets"), "key", "members"), "link-company")
    homes = company.groupBy("s").agg(F.min(F.struct(-F.col("m"), "hub")).alias("h"), F.first("t").alias("t"), F.first("n").alias("n"), F.sum("m").alias("w"))
    homes = keep(homes.select("s", "t", "n", "w", F.col("h.hub").alias("home")), "link-homes")
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes"), F.max_by("s", F.struct("w", "s")).alias("pivot"))
    sizes = keep(sizes.select("home", "m", "pivot", blocks_for("m", "hashes").alias("blocks")), "link-sizes")
    texts = keep(texts_of(docs, homes), "link-texts")
    at_home = spread_join(homes.select("s", "n", "home"), sizes, "home", "m")
    placed = at_home.where("blocks = 1").select("s", "home", _named("home.v", "home.k1").alias("place"))
    inside = sizes.where("blocks = 1 and m > 1").select(_named("home.v", "home.k1").alias("i"), _named("home.v", "home.k1").alias("j"))
    certain = None
    if sizes.where("blocks > 1").limit(1).count():
        hot = keep(cells_of(at_home.where("blocks > 1"), sizes.where("blocks > 1"), texts, members, threshold), "link-cells")
        reach = round(CELLS * (1 - threshold), 6)
        sure, apart = math.floor(reach) - 2, math.ceil(reach) + 1
        counts = keep(hot.groupBy("home", "cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes")), "link-counts")
        other = counts.select("home", F.col("cell").alias("c2"), F.col("m").alias("m2"))
        sums = counts.join(other, "home").groupBy("home", "cell").agg(F.first("m").alias("m"), F.first("hashes").alias("hashes"), F.sum(F.when(F.col("cell") + F.col("c2") <= sure, F.col("m2")).otherwise(0)).alias("sure"))
        alike = F.when(F.col("cell") * 2 <= sure, F.col("sure") - 1).otherwise(F.col("sure"))
        cells = keep(sums.select(F.struct("home", "cell").alias("at"), "m", blocks_for("m", "hashes").alias("blocks"), alike.alias("sure")), "link-sums")
        hot = spread_join(hot.select("s", "near", "pivot", F.struct("home", "cell").alias("at")), cells, "at", "m")
        place = _named("at.home.v", "at.home.k1", "at.cell", F.pmod(F.xxhash64("s.v", "s.k1", F.lit("block")), F.col("blocks")))
        hot = keep(hot.select("s", "near", "pivot", "sure", "at.home", "at.cell", place.alias("place")), "link-places")
        certain = hot.where("near or sure > 0").select("s", F.col("sure").cast("long").alias("links"), F.when(F.col("near"), F.col("pivot")).otherwise(F.col("s")).alias("to"))
        blocks = keep(hot.select("home", "cell", "place").distinct(), "link-blocks")
        a, b = (blocks.select("home", F.col("cell").alias(f"c{k}"), F.col("place").alias(k)) for k in "ij")
        open_ = (F.col("ci") + F.col("cj") > sure) & (F.abs(F.col("ci") - F.col("cj")) < apart) & (F.col("i") <= F.col("j"))
        inside = inside.unionByName(a.join(b, "home").where(open_).select("i", "j"))
        placed = placed.unionByName(hot.select("s", "home", "place"))
    placed = keep(placed, "link-placed")
    pairs = keep(inside.unionByName(across(company, placed)), "link-pairs")
    each = pairs.select(F.col("i").alias("place"), "i", "j").unionByName(pairs.where("i != j").select(F.col("j").alias("place"), "i", "j"))
    rows = each.join(placed.select("s", "place"), "place")
    found = verified(rows.join(texts, "s").select("i", "j", "place", "s.v", "s.k1", "text"), members, threshold, sketch, least)
    return keep(found.unionByName(certain) if certain is not None else found, "link-found")


def cells_of(at_home: DataFrame, sizes: DataFrame, texts: DataFrame, members: Members, threshold: float) -> DataFrame:
    """s, n, home, pivot, cell, near of the sets of large homes."""
    block = lambda b: _named("home.v", "home.k1", b)
    rows = at_home.select("s", block(F.pmod(F.xxhash64("s.v", "s.k1"), F.col("blocks"))).alias("block"), F.lit(1).alias("first"))
    pivots = sizes.select("home", F.col("pivot").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select("s", block(F.col("b")).alias("block"), F.lit(0).alias("first"))
    found = measured(rows.unionByName(pivots).join(texts, "s").select("block", "first", "s.v", "s.k1", "text"), members, threshold)
    return found.join(at_home.select("s", "n", "home", "pivot"), "s")


def across(company: DataFrame, placed: DataFrame) -> DataFrame:
    """i, j: blocks of different homes that have members of one bucket."""
    at = company.select("s", "key").join(placed, "s").select("key", "home", "place").distinct()
    mixed = at.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low != high").select("key")
    at = keep(at.join(mixed, "key"), "link-mixed")
    homes = at.select("key", "home").distinct()
    a, b = (homes.select("key", F.col("home").alias(f"h{k}")) for k in "ij")
    met = a.join(b, "key").where("hi < hj")
    i, j = (at.select("key", F.col("home").alias(f"h{k}"), F.col("place").alias(k)) for k in "ij")
    return met.join(i, ["key", "hi"]).join(j, ["key", "hj"]).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
