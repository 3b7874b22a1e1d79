"""Connected components of an edge table by Spark joins.

Every round hooks each vertex to the smallest label around it and then follows
labels to their labels (pointer jumping), so chains shorten by powers of two.
Each round is a table in the shared folder; only a count of changes reaches the
driver. What meets at a vertex is a partial minimum; where labels travel to the
neighbours of a hub, or to the members of a large component, its rows are spread
(see ``hot_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.hot_join import spread_join
from pairlight.scratch import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` has a, b (of one orderable type). Returns v, root: the smallest vertex of v's component.

    Null ends and loops are ignored, repeated edges do no harm, an empty table
    gives an empty result. Raises if ``rounds`` rounds do not suffice.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = keep(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count(F.lit(1)).alias("degree")), "cc-labels")
    degrees = labels.select("v", "degree")
    labels = labels.select("v", "root")
    for _ in range(rounds):
        # the smallest label among the neighbours, offered to the vertex and to its present root
        named = labels.join(degrees, "v").select(F.col("v").alias("b"), "root", "degree")
        near = spread_join(both, named, "b", "degree").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        offers = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("best"))
        hooked = (
            offers.select(F.explode(F.array(F.struct("v", F.col("best").alias("root")), F.struct(F.col("root").alias("v"), F.col("best").alias("root")))).alias("x"))
            .select("x.v", "x.root").groupBy("v").agg(F.min("root").alias("root"))
        )
        hooked = keep(hooked, "cc-hooked")
        followers = hooked.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        jump = followers.join(hooked.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left")
        after = keep(spread_join(hooked, jump, "root", "n", "left").select("v", F.least("root", F.coalesce("far", "root")).alias("root")), "cc-labels")
        moved = after.join(labels.withColumnRenamed("root", "was"), "v").where(F.col("root") != F.col("was")).limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
