"""Scores of image pairs from their descriptors: mutual nearest neighbours with a ratio test.

Descriptors are rows (image_id, row_id, vector). A pair of images is compared in blocks
of at most ``BLOCK`` descriptors a side: a task takes one block against another, tile by
tile, and gives, for each row of both, its two nearest of the other side. These pairs of
nearest are combined over the blocks, by a rank that Spark cuts to two before it
shuffles, and that two rows are each other's nearest is a join. So no row and no task
holds an image, however many descriptors it has. A descriptor is sent once for each block
of each image that its own is paired with, so what is shuffled grows with the descriptors
until images have more than ``BLOCK``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlight.operators.keyed import offsets
from pairlight.scratch import keep

RATIO = 0.7
#: Descriptors of a block (268 million distances for two, some seconds), those of a tile, whose distances are held at once, and images that are listed together.
BLOCK, TILE, LISTED = 16_384, 512, 64
_PAIR = ["probe_image_id", "reference_image_id"]
#: Distances of a matrix product are rounded; what lies this close to the second is computed again from the difference.
_CLOSE = 1e-6


def _first_two(i: np.ndarray, j: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < 2], j[place < 2], exact[place < 2]


def two_nearest(a: np.ndarray, b: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b, squared distance of the two nearest of every row of a; of equally near ones the first.

    Of a tile only what is as near as the second nearest so far, or too close to it to tell, is looked at.
    """
    square, turned, out = (b * b).sum(1), np.ascontiguousarray(-2 * b.T), []
    for x in range(0, len(a), tile):
        part = a[x : x + tile]
        own = (part * part).sum(1)
        slack, limit, near = _CLOSE * (own + square.max() + 1e-300), None, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for y in range(0, len(b), tile):
            d = part @ turned[:, y : y + tile]  # without the row's own square
            d += square[y : y + tile]
            if limit is None:
                limit = (np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else d[:, 0]) + slack
            i, j = np.nonzero(d <= limit[:, None])
            if not len(i):
                continue
            exact = np.concatenate([((part[i[k : k + 65536]] - b[y + j[k : k + 65536]]) ** 2).sum(1) for k in range(0, len(i), 65536)])
            near = _first_two(*(np.concatenate(c) for c in zip(near, (i, j + y, exact))))
            limit = near[2].reshape(len(part), -1)[:, -1] - own + slack
        out.append((near[0] + x, *near[1:]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _nearest_in_blocks(rows: DataFrame) -> DataFrame:
    """pair, side, id, other, d: the two nearest of each row, of each pair of blocks. ``rows`` has the pair, both blocks, side, id, vector."""
    keys = [*_PAIR, "probe_block", "reference_block"]

    def close(key, sides):
        ids, vectors = zip(*((np.array(s[0], np.int64), np.concatenate(s[1]).astype(np.float64, copy=False)) for s in sides))
        out = []
        for side, at, to in ((0, 0, 1), (1, 1, 0)):
            i, j, d = two_nearest(vectors[at], vectors[to])
            out.append((np.full(len(i), side), ids[at][i], ids[to][j], d))
        side, one, other, d = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([*(pa.array([k] * len(d), pa.string()) for k in key[:2]), pa.array(side, pa.int32()), pa.array(one), pa.array(other), pa.array(d)], [*_PAIR, "side", "id", "other", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, None
        for batch in batches:
            found = list(zip(*(batch.column(c).to_pylist() for c in [*keys, "side"])))
            ids, vectors = batch.column("id").to_pylist(), batch.column("vector")
            at = 0
            while at < len(found):
                to = at + 1
                while to < len(found) and found[to] == found[at]:
                    to += 1
                if found[at][:4] != key:
                    if key is not None and sides[0][0] and sides[1][0]:
                        yield close(key, sides)
                    key, sides = found[at][:4], (([], []), ([], []))
                part = vectors.slice(at, to - at)
                held = sides[found[at][4]]
                held[0].extend(ids[at:to])
                held[1].append(part.flatten().to_numpy(zero_copy_only=False).reshape(to - at, -1))
                at = to
        if key is not None and sides[0][0] and sides[1][0]:
            yield close(key, sides)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return dealt.mapInArrow(run, "probe_image_id string, reference_image_id string, side int, id long, other long, d double")


def mutual_matches(pairs: DataFrame, descriptors: DataFrame, ratio: float = RATIO, block: int = BLOCK) -> DataFrame:
    """probe_image_id, reference_image_id, probe_row, reference_row, d: rows that are each other's nearest and clearly so.

    Clearly: ``d`` is below ``ratio`` times the second distance, in both directions.
    Where a side has one row there is no second and only mutuality counts. Of
    equally near rows the smallest row_id is the nearest. pairs: probe_image_id,
    reference_image_id, each once. descriptors: image_id, row_id, vector.
    """
    number = descriptors.schema["vector"].dataType.elementType.simpleString()
    held = F.col("vector") if number in ("float", "double") else F.col("vector").cast("array<double>")  # computed as doubles, sent as they are
    sizes = keep(descriptors.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "descriptor-sizes")
    placed = descriptors.join(sizes, "image_id").select("image_id", F.col("row_id").cast("long").alias("id"), held.alias("vector"), F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int").alias("own"))
    listed = pairs.select(*_PAIR)
    for side in ("probe", "reference"):
        named = sizes.select(F.col("image_id").alias(f"{side}_image_id"), F.col("blocks").alias(f"{side}_blocks"))
        listed = listed.join(named, f"{side}_image_id")
    rows = None
    for k, (side, other) in enumerate((("probe", "reference"), ("reference", "probe"))):
        met = listed.join(placed.withColumnRenamed("image_id", f"{side}_image_id"), f"{side}_image_id")
        met = met.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).withColumn(f"{side}_block", F.col("own"))
        part = met.select(*_PAIR, "probe_block", "reference_block", F.lit(k).alias("side"), "id", "vector")
        rows = part if rows is None else rows.unionByName(part)
    near = _nearest_in_blocks(rows)
    group = Window.partitionBy(*_PAIR, "side", "id").orderBy("d", "other")
    two = near.withColumn("rank", F.row_number().over(group)).where("rank <= 2")
    best = two.groupBy(*_PAIR, "side", "id").agg(F.min(F.struct("d", "other")).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("second"))
    best = keep(best.select(*_PAIR, "side", "id", "b.d", "b.other", "second"), "nearest")
    p = best.where("side = 0").select(*_PAIR, F.col("id").alias("probe_row"), F.col("other").alias("reference_row"), "d", F.col("second").alias("second_p"))
    r = best.where("side = 1").select(*_PAIR, F.col("other").alias("probe_row"), F.col("id").alias("reference_row"), F.col("second").alias("second_r"))
    clear = F.col("second_p").isNull() | F.col("second_r").isNull() | ((F.col("d") < ratio * F.col("second_p")) & (F.col("d") < ratio * F.col("second_r")))
    return p.join(r, [*_PAIR, "probe_row", "reference_row"]).where(clear).select(*_PAIR, "probe_row", "reference_row", "d")


def score_pairs(pairs: DataFrame, descriptors: DataFrame, ratio: float = RATIO, block: int = BLOCK) -> DataFrame:
    """``pairs`` with status, reason, score: the number of mutual matches.

    A pair with an image that has no descriptors fails with a null score; it is kept.
    """
    counts = mutual_matches(pairs.select(*_PAIR).distinct(), descriptors, ratio, block).groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("matched"))
    there = descriptors.select("image_id").distinct()
    for side in ("probe", "reference"):
        pairs = pairs.join(there.select(F.col("image_id").alias(f"{side}_image_id"), F.lit(True).alias(f"has_{side}")), f"{side}_image_id", "left")
    found = F.col("has_probe").isNotNull() & F.col("has_reference").isNotNull()
    joined = pairs.join(counts, _PAIR, "left")
    kept = [c for c in pairs.columns if not c.startswith("has_")]
    return joined.select(*kept, F.when(found, "ok").otherwise("failed").alias("status"), F.when(found, "").otherwise("no features").alias("reason"), F.when(found, F.coalesce("matched", F.lit(0)).cast("double")).alias("score"))


def every_pair(probes: DataFrame, references: DataFrame, listed: int = LISTED) -> DataFrame:
    """probe_image_id, reference_image_id: every probe with every reference, which a closed study lists; references are met in blocks of their order."""
    placed = keep(offsets(references.select(F.col("image_id").alias("reference_image_id")), ["reference_image_id"]), "references")
    blocks = placed.agg((F.floor(F.max("offset") / listed) + 1).alias("n")).first()["n"] or 0
    each = probes.select(F.col("image_id").alias("probe_image_id"), F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))).alias("block")) if blocks else probes.select(F.col("image_id").alias("probe_image_id"), F.lit(-1).alias("block"))
    return each.join(placed.select("reference_image_id", F.floor(F.col("offset") / listed).cast("int").alias("block")), "block").select(*_PAIR)


def differing_features(a: DataFrame, b: DataFrame, column: str = "descriptors") -> DataFrame:
    """image_ids whose features differ between two runs or are in one only."""
    left, right = a.select("image_id", F.col(column).alias("x")), b.select("image_id", F.col(column).alias("y"))
    return left.join(right, "image_id", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("image_id")


def resolved_features(images: DataFrame, tables: list[tuple[str, DataFrame]], order: dict[str, list[str]]) -> DataFrame:
    """``images`` with source and the columns of its feature row: the first table, in the order that its set has, that knows the image.

    ``tables``: name and table (image_id and the same feature columns in each, an
    image once). ``order``: names for each set code; a set without an order has no
    features. All tables are gone over once, in one aggregation of priorities.
    """
    ranked = [(code, name, k) for code, names in order.items() for k, name in enumerate(names)]
    rows = None
    for name, table in tables:
        part = table.select("image_id", F.lit(name).alias("source"), F.struct(*[c for c in table.columns if c != "image_id"]).alias("f"))
        rows = part if rows is None else rows.unionByName(part)
    place = F.lit(None).cast("int")
    for code, name, k in ranked:
        place = F.when((F.substring("image_id", 1, 1) == code) & (F.col("source") == name), k).otherwise(place)
    first = rows.withColumn("place", place).where("place is not null").groupBy("image_id").agg(F.min_by(F.struct("source", "f"), "place").alias("x"))
    return images.join(first, "image_id", "left").select(*[images[c] for c in images.columns], "x.source", "x.f.*")
