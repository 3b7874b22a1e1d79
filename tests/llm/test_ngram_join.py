import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import hot_join, ngram_join, set_links
from pairlight.llm.components import components
from tests.llm.conftest import table
from tests.llm.test_words import WORD


def grams(text, width=5):
    words = WORD.findall(text or "")
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, threshold=0.8):
    by = defaultdict(list)
    for i, text in rows:
        by[grams(text)].append(i)
    own = {i: g for g, ids in by.items() for i in ids}
    reps = {min(ids): g for g, ids in by.items() if g}
    links, root = defaultdict(int), {i: min(by[g]) if g else i for i, g in own.items()}
    order = sorted(reps)
    joined = []
    for a in order:
        for b in order:
            if a < b and len(reps[a] & reps[b]) >= threshold * len(reps[a] | reps[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                joined.append((a, b))
    moved = True
    while moved:
        moved = False
        for a, b in joined:
            low = min(root[a], root[b])
            for v in (a, b):
                moved |= root[v] != low
                root[v] = low
    return {i: (root[min(by[g])] if g else i, links[min(by[g])] if g else 0, min(by[g]) if g else i, len(by[g]) if g else 1) for i, g in own.items()}


def corpus(seed=1):
    r = random.Random(seed)
    rows = []
    for family in range(12):
        base = [f"f{family}w{r.randint(0, 400)}" for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"e{r.random()}"
            rows.append(" ".join(words))
    return [*enumerate(rows, 10), (1, ""), (2, None), (3, "two words"), (4, "two  words"), (5, "two words")]


def test_classes_and_links_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    for block, hot in ((1024, 1 << 17), (4, 3)):  # whole buckets in a block, and buckets over many blocks with spread joins
        monkeypatch.setattr(set_links, "BLOCK_ROWS", block)
        monkeypatch.setattr(set_links, "EVEN", 128 if block > 4 else 4)
        monkeypatch.setattr(hot_join, "HOT_ROWS", hot)
        got = {r.doc_id: (r.class_id, r.n_links, r.set_id, r.n_copies) for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
        assert got == want


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.9999)


def test_overlaps():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 6000, n).astype(np.uint64)) for n in (0, 1, 3000, 5000, 2999)]
    got = set_links.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_odd_rows(odd_docs, no_docs):
    rows = ngram_join.near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    assert sorted((r.doc_id, r.class_id, r.n_copies) for r in rows if r.doc_id in (5, 6)) == [(5, 5, 3), (5, 5, 3), (6, 5, 3)]
    assert [(r.class_id, r.n_links) for r in rows if r.doc_id is None] == [(None, 0)]
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 9), (9, 7), (9, 9), (None, 3)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 540)} | {7: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(hot_join, "HOT_ROWS", 50)
    rows = spark.createDataFrame([(k % 3 if k < 300 else k, k) for k in range(400)] + [(None, -1)], "key long, x long")
    named = rows.where("key is not null").groupBy("key").count().withColumn("twice", F.col("key") * 2).where("key != 399")
    inner, left = (sorted(map(tuple, hot_join.spread_join(rows, named, "key", "count", how).select("x", "twice").collect()), key=repr) for how in ("inner", "left"))
    want = sorted(((k, 2 * (k % 3) if k < 300 else 2 * k) for k in range(399)), key=repr)
    assert inner == want and left == sorted([*want, (399, None), (-1, None)], key=repr)


def test_recall_near_the_threshold(spark):
    """Pairs of 0.80 to 0.85, made one by one: their share that is linked."""
    r = random.Random(21)
    rows, pairs = [], []
    for k in range(1500):
        words = [f"w{r.random()}" for _ in range(120)]
        other = list(words)
        at = r.randint(8, 100)
        while len(grams(" ".join(words)) & grams(" ".join(other))) > 0.85 * len(grams(" ".join(words)) | grams(" ".join(other))):
            other[at % 120] = f"e{r.random()}"
            at += 7
        share = len(grams(" ".join(words)) & grams(" ".join(other))) / len(grams(" ".join(words)) | grams(" ".join(other)))
        if share >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {x.doc_id: x.n_links for x in ngram_join.near_duplicates(table(spark, rows)).collect()}
    found = sum(got[a] == got[b] == 1 for a, b in pairs)
    assert len(pairs) > 500 and found >= 0.99 * len(pairs), (found, len(pairs))


def test_several_texts_under_one_id(spark):
    """Each text has the links of its own set, and of one class one document stays."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (5, a + " x"), (5, b), (7, b + " y"), (9, "something else"), (None, a), (5, b)]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.stays) for r in ngram_join.near_duplicates(table(spark, rows)).collect() if r.doc_id is not None)
    assert got == [(3, 3, 1, True), (5, 3, 1, False), (5, 5, 1, True), (5, 5, 1, True), (7, 5, 1, False), (9, 9, 0, True)]


def test_close_copies_cost_one_comparison_each(spark, monkeypatch):
    """A home of M close copies: M sets measured against the pivot, none compared in pairs, all links counted."""
    monkeypatch.setattr(set_links, "EVEN", 16)
    work = {}

    def counted(name):
        plain = getattr(set_links, name)

        def run(rows, *args):
            work[name] = rows.count()
            return plain(rows, *args)

        monkeypatch.setattr(set_links, name, run)

    for name in ("measured", "verified"):
        counted(name)
    base = [f"w{k}" for k in range(600)]
    for m in (60, 120):
        rows = [(i, " ".join([*base[: 5 * i], f"e{i}", *base[5 * i + 1 :]])) for i in range(m)] + [(1000, "on its own " + " ".join(f"x{k}" for k in range(50)))]
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(table(spark, rows)).collect()}
        assert got == {**{i: (0, m - 1) for i in range(m)}, 1000: (1000, 0)}
        assert work["verified"] == 0 and m <= work["measured"] <= m + 16
