"""Merkle manifest of a table: a tree of digests a source, one over the sources, and a proof for every row.

A row's leaf is the SHA-256 of its fields. The leaves of a source ascend by doc_id;
three consecutive nodes become one, level by level, and the roots of the sources
become the root of the table in the same way.

1. Leaves are computed once and written. They are numbered inside their source by a
   range partitioning with the counts of the partitions before, so no task holds a
   source, and one source may have most rows, or one doc_id: equal rows are told apart
   by where they were written.
2. The levels are cut into blocks of 3^6 = 729 aligned leaves. A task goes through a
   block by postorder recursion: a call returns the digest of its subtree, and while
   the recursion unwinds, what stands beside a subtree is appended to the proofs of the
   leaves inside it. A block that is not the whole tree is always taken through six
   levels, its last runs too, so its root is a node of the tree.
3. The roots of the blocks are the leaves of another traversal, and so on: a tree of N
   leaves takes log_729 N rounds, the number of rows falling to a 729th each. What comes
   back is one path a block, joined to the block's own leaves; leaves and paths
   meet by tree and block, so no key has more than 729 rows.

A proof is a list of steps (before, after): the digests of the run's other nodes on
either side. Folding a leaf through its steps gives the root (``fold``), in Spark's own
functions.

Defined cases: a null field is "-"; null sources are a source of their own, before all
others; a null doc_id comes first in its source; rows with one doc_id are ordered by
their leaf, so repeated rows are leaves of their own with equal digests; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.hot_join import spread_join
from pairlight.scratch import keep

#: Nodes of a run, and levels of a block.
RUN, DEPTH = 3, 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "array<struct<before string, after string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int, run: int = RUN) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // run), out + 1
    return out


def visit(nodes: list[str], low: int, high: int, depth: int, proofs: list[list[tuple[str, str]]] | None, run: int = RUN) -> str:
    """Digest of the subtree of ``depth`` levels over nodes low to high; appends its siblings to the proofs inside each part while unwinding."""
    if not depth:
        return nodes[low]
    part = run ** (depth - 1)
    bounds = [*range(low, high, part), high]
    roots = [visit(nodes, a, b, depth - 1, proofs, run) for a, b in zip(bounds, bounds[1:])]
    if proofs is not None:
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            step = "".join(roots[:k]), "".join(roots[k + 1 :])
            for proof in proofs[a:b]:
                proof.append(step)
    return digest("".join(roots))


def leaf_of(text: Column) -> Column:
    """The digest of a row's fields, with ``text`` as its text."""
    cells = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]), 256)


def leaves(docs: DataFrame, *more: Column) -> DataFrame:
    """tree (the source as a key that is never null and sorts like it), doc_id, digest and ``more``."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", F.unhex(leaf_of(F.col("text"))).alias("digest"), *more)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, digest and others), written, with pos, 0-based in its tree in ``order``, and n, the nodes of the tree."""
    by = ["tree", *order]
    sorted_ = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = keep(sorted_.withColumn("place", F.monotonically_increasing_id()), "merkle-ordered")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    spans = dealt.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    tree = Window.partitionBy("tree")  # a row a partition that the tree reaches
    before = F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    placed = dealt.join(spans, ["tree", "part"]).withColumn("pos", F.col("place") + F.col("shift"))
    return keep(placed.drop("place", "part", "shift"), "merkle-nodes")


def _blocks(nodes: DataFrame, run: int, depth: int) -> DataFrame:
    """Nodes with their block, dealt so that a task sees whole blocks in order."""
    return nodes.withColumn("block", F.floor(F.col("pos") / run**depth)).repartition("tree", "block").sortWithinPartitions("tree", "pos")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another from batches sorted by tree and pos; held: one block."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist()))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != key:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                key, held = keys[at], []
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _subtree(table: pa.Table, run: int, depth: int, proofs: bool) -> tuple[str, list[list[tuple[str, str]]] | None]:
    """Root and proofs of a block, which has to be whole."""
    n, block = (table.column(c)[0].as_py() for c in ("n", "block"))
    nodes = [d.hex() for d in table.column("digest").to_pylist()]
    if len(nodes) != min(run**depth, n - block * run**depth):
        raise RuntimeError("a block is not whole")
    found = [[] for _ in nodes] if proofs else None
    return visit(nodes, 0, len(nodes), depth if n > run**depth else levels(n, run), found, run), found


def block_roots(nodes: DataFrame, run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """tree, pos, n, digest of the roots of all blocks of ``nodes`` (tree, pos, n, digest)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            root, _ = _subtree(table, run, depth, False)
            n = -(-table.column("n")[0].as_py() // run**depth)
            cells = table.column("tree")[0].as_py(), table.column("block")[0].as_py(), n, bytes.fromhex(root)
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["tree", "pos", "n", "digest"])

    return _blocks(nodes.select("tree", "pos", "n", "digest"), run, depth).mapInArrow(go, "tree string, pos long, n long, digest binary")


def with_steps(nodes: DataFrame, above: DataFrame, run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """``nodes`` with the columns of ``above`` (tree, pos of the block, proof and others); the steps inside the block come before those of ``above``."""
    joined = _blocks(nodes, run, depth).join(above.withColumnRenamed("pos", "block").withColumnRenamed("proof", "rest"), ["tree", "block"])
    names = [f for f in joined.schema.fields if f.name not in ("block", "rest")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            _, proofs = _subtree(table, run, depth, True)
            rest = [(s["before"], s["after"]) for s in table.column("rest")[0].as_py()]
            flat = [s for p in proofs for s in (*p, *rest)]
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p) + len(rest))
            steps = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["before", "after"])
            batch = table.to_batches()[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)], [*(f.name for f in names), "proof"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in names), f"proof {_STEP}"])
    return joined.sortWithinPartitions("tree", "pos").mapInArrow(go, schema)


def paths(nodes: DataFrame, run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """tree, pos, root, proof: the root of its tree and the steps to it, for every node of ``nodes`` (tree, pos, n, digest)."""
    roots = keep(block_roots(nodes, run, depth), "merkle-roots")
    above = roots.where("n = 1").select("tree", "pos", F.col("digest").alias("root"), F.array().cast(_STEP).alias("proof"))
    if roots.where("n > 1").limit(1).count():
        above = above.unionByName(paths(roots.where("n > 1"), run, depth))
    return keep(with_steps(nodes, above, run, depth).select("tree", "pos", "root", "proof"), "merkle-paths")


def manifest(docs: DataFrame, *more: Column, run: int = RUN, depth: int = DEPTH) -> DataFrame:
    """doc_id, digest (the leaf), subroot, root (as bytes), proof and ``more``, for every row of ``docs`` (FIELDS)."""
    made = leaves(docs, *more)
    made = keep(made.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")  # written, so that equal rows have an order that stays
    nodes = numbered(made, ["doc_id", "digest", "tie"]).drop("tie")
    blocks = keep(block_roots(nodes, run, depth), "merkle-blocks")
    inside = paths(blocks, run, depth)  # from the blocks of a source to its root
    top = inside.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("named"), F.col("root").alias("digest"))
    top = numbered(top, ["named"])
    over = paths(top.select("tree", "pos", "n", "digest"), run, depth).select("pos", F.col("root").alias("over"), F.col("proof").alias("last"))
    sizes = inside.groupBy("tree").agg(F.count(F.lit(1)).alias("m"))
    named = keep(top.join(over, "pos").select(F.col("named").alias("tree"), "over", "last").join(sizes, "tree"), "merkle-sources")
    above = spread_join(inside, named, "tree", "m").select("tree", "pos", F.col("root").alias("subroot"), F.col("over").alias("root"), F.concat("proof", "last").alias("proof"))
    return with_steps(nodes, keep(above, "merkle-above"), run, depth).drop("tree", "pos", "n")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and the steps of a proof lead to."""
    return F.aggregate(proof, leaf, lambda held, step: F.sha2(F.concat(step["before"], held, step["after"]), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def tampered() -> Column:
    """The leaf of a row whose text lost its newlines, where an even CRC-32 of its doc_id asks for that; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(chosen & F.contains("text", F.lit("\n")), F.unhex(leaf_of(F.replace("text", F.lit("\n"), F.lit("")))))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and what folding its proofs gives when half of the texts lost their newlines."""
    proven = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered().alias("other"))
    leaf = hexed(F.col("digest"))
    folded = fold(hexed(F.coalesce("other", "digest")), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = proven.select("doc_id", leaf.alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _cells(text: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], text])


ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS k, 4294967295 AS crc FROM documents WHERE doc_id IS NOT NULL
         UNION ALL SELECT doc_id, s, k + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)
         FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(crc, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE crc END AS c FROM bits WHERE k < 8 * length(s))),
even AS (SELECT doc_id FROM bits WHERE k = 8 * length(s) AND crc % 2 = 1),
d AS (SELECT *, row_number() OVER () AS uid, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
f AS (SELECT uid, doc_id, coalesce('=' || source, '') AS tree, sha256({_cells("text")}) AS leaf, sha256({_cells("other")}) AS told FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM f),
lv AS (SELECT tree, 0 AS l, pos, leaf AS digest, n FROM p
       UNION ALL SELECT tree, l + 1, pos // {RUN}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM lv WHERE n > 1 GROUP BY tree, l, pos // {RUN}, n),
sub AS (SELECT tree AS named, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tp AS (SELECT tree, 0 AS l, pos, digest, n FROM sub
       UNION ALL SELECT tree, l + 1, pos // {RUN}, sha256(string_agg(digest, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN} FROM tp WHERE n > 1 GROUP BY tree, l, pos // {RUN}, n),
st AS (SELECT part, a.tree, a.l, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
       FROM (SELECT 1 AS part, * FROM lv UNION ALL SELECT 2, * FROM tp) a JOIN (SELECT 1 AS part, * FROM lv UNION ALL SELECT 2, * FROM tp) b USING (part) WHERE a.tree = b.tree AND a.l = b.l AND a.pos // {RUN} = b.pos // {RUN} AND a.n > 1 GROUP BY ALL),
f1 AS (SELECT uid, tree, 0 AS l, pos, told AS acc, '' AS proof FROM p
       UNION ALL SELECT uid, f1.tree, f1.l + 1, f1.pos // {RUN}, sha256(before || acc || after), proof || before || after FROM f1 JOIN st ON part = 1 AND st.tree = f1.tree AND st.l = f1.l AND st.pos = f1.pos),
e1 AS (SELECT uid, any_value(tree) AS named, arg_max(acc, l) AS acc, arg_max(proof, l) AS proof FROM f1 GROUP BY uid),
f2 AS (SELECT uid, 0 AS l, pos, acc, proof FROM e1 JOIN sub USING (named)
       UNION ALL SELECT uid, f2.l + 1, f2.pos // {RUN}, sha256(before || acc || after), proof || before || after FROM f2 JOIN st ON part = 2 AND st.l = f2.l AND st.pos = f2.pos),
e2 AS (SELECT uid, arg_max(acc, l) AS acc, arg_max(proof, l) AS proof FROM f2 GROUP BY uid)
SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM tp WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT digest FROM tp WHERE n = 1) AS verified
FROM p JOIN e2 USING (uid) JOIN sub ON named = p.tree"""
