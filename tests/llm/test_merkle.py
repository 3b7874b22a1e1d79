import hashlib
import random
import zlib

import pytest

from pairlight.llm import hot_join, merkle


SCHEMA_ = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, run=3):
    """Root, and for each node its siblings before and after, level by level."""
    steps, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, steps_of in enumerate(steps):
            low = place[k] // run * run
            steps_of.append(("".join(level[low : place[k]]), "".join(level[place[k] + 1 : low + run])))
            place[k] //= run
        level = [h("".join(level[k : k + run])) for k in range(0, len(level), run)]
    return level[0], steps


def brute(rows, run=3):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows, sorted."""
    by = {}
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(by)
    made = {s: (sorted(by[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], run)) for s in order}
    root, above = tree([made[s][1] for s in order], run) if order else (None, [])
    out = []
    for s, last in zip(order, above):
        members, subroot, steps = made[s]
        for (_, _, own, r), inside in zip(members, steps):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            held = leaf((*r[:4], text))
            for before, after in [*inside, *last]:
                held = h(before + held + after)
            out.append((r[0], own, subroot, root, h("".join(a + b for a, b in [*inside, *last])), held, held == root))
    return sorted(out, key=repr)


def query(docs, run=3, depth=6):
    from pyspark.sql import functions as F

    made = merkle.manifest(docs, merkle.tampered().alias("other"), run=run, depth=depth)
    folded = merkle.fold(merkle.hexed(F.coalesce("other", "digest")), F.col("proof"))
    siblings = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    return made.select("doc_id", merkle.hexed(F.col("digest")), merkle.hexed(F.col("subroot")), merkle.hexed(F.col("root")), siblings, folded, folded == merkle.hexed(F.col("root")))


def corpus(n=260, seed=3):
    r = random.Random(seed)
    sources = [None, "", "a", "b", "é", "Z", *[f"host{k}" for k in range(40)]]
    rows = [(r.randint(0, 150) if k % 9 else None, "hot" if k % 3 == 0 else r.choice(sources), r.choice([None, "en"]), r.choice([None, k]), r.choice([None, "", f"line {k}\nline", f"x{k}", "é\n"])) for k in range(n)]
    return [*rows, *rows[:20], *rows[:3] * 5]


@pytest.mark.parametrize("depth, hot", [(1, 4), (6, 128)])
def test_equals_brute_force(spark, monkeypatch, depth, hot):
    """Blocks of 3 and 729 leaves, so trees take up to five rounds; and spread joins of a tree's blocks."""
    monkeypatch.setattr(hot_join, "HOT_ROWS", hot)
    rows = corpus()
    got = query(spark.createDataFrame(rows, SCHEMA_), depth=depth).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_sizes_around_full_trees(spark):
    rows = [(k, f"s{n}", "en", 1, f"t{k}\n") for n in (1, 2, 3, 4, 9, 10, 27, 28) for k in range(n)]
    got = query(spark.createDataFrame(rows, SCHEMA_), depth=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_visit_returns_the_digest_and_appends_siblings():
    for n in (1, 2, 5, 9, 14, 27):
        nodes = [h(str(k)) for k in range(n)]
        proofs = [[] for _ in nodes]
        assert (merkle.visit(nodes, 0, n, merkle.levels(n), proofs), proofs) == tree(nodes)


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, query(odd_docs).collect()), key=repr) == brute(rows)
    assert query(no_docs).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.01")
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({merkle.ORACLE})").fetchall(), key=repr)
    assert len({r[-1] for r in rows}) == 2
