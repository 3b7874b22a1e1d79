import random

import numpy as np
import pytest

from pairlight.llm import bottom_k, hot_join, set_links
from tests.llm.conftest import table
from tests.llm.test_ngram_join import corpus
from tests.llm.test_words import WORD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows):
    """doc_id: set size, component, kept; ids are unique."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near(seed=4):
    """A large group of close copies, one of copies near the threshold, texts that share a long passage, and short ones."""
    r = random.Random(seed)
    base = [f"w{r.random()}" for _ in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(r.randint(0, 2) if k % 2 else r.randint(3, 6)):
            words[r.randrange(150)] = f"e{r.random()}"
        rows.append(" ".join(words))
    passage = [f"p{k}" for k in range(60)]
    rows += [" ".join([*passage, *(f"q{r.random()}" for _ in range(r.choice([5, 40, 90])))]) for _ in range(40)]
    rows += [" ".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(60)]
    r.shuffle(rows)
    return [*enumerate(rows, 1000), *corpus(seed)]


@pytest.mark.parametrize("block, even, hot", [(1024, 128, 1 << 17), (4, 4, 3), (8, 1 << 30, 20)])
def test_components_equal_brute_force(spark, monkeypatch, block, even, hot):
    """Whole homes in a block; and homes over many blocks, settled by a pivot, with spread joins."""
    monkeypatch.setattr(set_links, "BLOCK_ROWS", block)
    monkeypatch.setattr(set_links, "EVEN", even)
    monkeypatch.setattr(hot_join, "HOT_ROWS", hot)
    rows = near()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottom_k.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_least_shared():
    assert bottom_k.least_shared(16, 0.5) == 1  # one value has to be shared to be found
    for k, threshold in ((32, 0.8), (64, 0.8)):
        t = bottom_k.least_shared(k, threshold)
        drawn = np.random.default_rng(1).binomial(k, threshold, 1_000_000)
        assert (drawn < t).mean() <= 5e-6 and (drawn < t + 2).mean() > 1e-6


def test_estimates_are_exact_for_small_sets_and_close_for_large_ones():
    r = np.random.default_rng(8)
    universe = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(r.choice(universe[: 20 if k < 4 else 4000], 12 if k < 4 else 3000, replace=False)) for k in range(8)]
    got = set_links.estimated(sets, 64)
    for i in range(8):
        for j in range(i):
            exact = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            assert abs(got[i, j] - exact) < (1e-6 if i < 4 else 0.25)


def test_odd_rows(odd_docs, no_docs):
    rows = bottom_k.near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (5, 6)) == [(5, 5, True), (5, 5, True), (6, 5, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.component_id == r.doc_id and r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert {r.doc_id: r.n_shingles for r in rows if r.doc_id in (1, 2, 3, 8, 9)} == {1: 0, 2: 0, 3: 0, 8: 1, 9: 1}
    assert bottom_k.near_duplicates(no_docs).count() == 0


def test_letters_are_lowered_in_ascii_only(spark):
    rows = [(1, "The Quick Brown Fox Ä"), (2, "the qUICK brown fOX Ä"), (3, "the quick brown fox ä")]
    got = {r.doc_id: r.component_id for r in bottom_k.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_id_with_many_rows_and_texts(spark, monkeypatch):
    """Many rows of one id, some of them equal: texts are told apart, equal ones are dropped before the shuffle."""
    monkeypatch.setattr(hot_join, "SHARE", 10)
    words = [f"w{k}" for k in range(80)]
    rows = [(7, " ".join(words))] * 60 + [(7, " ".join([*words[:-1], f"x{k % 5}"])) for k in range(40)] + [(3, " ".join([*words, "end"])), (9, "nothing like it at all")]
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in bottom_k.near_duplicates(table(spark, rows)).collect()})
    assert got == [(3, 3, True), (7, 3, False), (9, 9, True)]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in bottom_k.op13_bottom_k_sketches(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)
