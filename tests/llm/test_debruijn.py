import hashlib
import random

import numpy as np
import pyarrow as pa

from pairlight.llm import debruijn
from tests.llm.conftest import table
from tests.llm.test_words import WORD


def brute(rows, width=20):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen and seen[window] != (i, k):
                gone.update(range(k, k + width))
            seen.setdefault(window, (i, k))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(r.randint(18, 90))] for k in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            part = r.choice(passages)
            a = r.randint(0, len(part) - 1)
            words += part[a : a + r.randint(1, 90)] if r.random() < 0.7 else [f"u{i}x{r.random()}" for _ in range(r.randint(1, 30))]
        words += ["again"] * (r.randint(15, 60) if i % 9 == 0 else 0)
        rows.append((r.randint(0, 10**6) * 100 + i, " \n".join(words)))
    return [*rows, (-3, rows[0][1]), (-2, ""), (-1, None)]


def removed(docs):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in debruijn.remove_repeats(docs).collect()}


def test_removal_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = table(spark, rows).repartition(7)
        assert removed(docs) == brute(rows)
        assert {r.doc_id: r[1:] for r in debruijn.remove_repeats(docs, digest=True).collect()} == brute(rows)
        texts = debruijn.numbered(docs)
        spans = debruijn.repeated_spans(texts).cache()
        assert spans.count() and all((r.src_doc, r.src_start) < (r.doc, r.start) for r in spans.collect())
        assert debruijn.differing(debruijn.answered(texts, spans)).count() == 0


def test_words_decide_where_hashes_collide(spark, monkeypatch):
    """With hashes of few values different windows meet as equal; the comparison finds it and other hashes are taken."""
    rows = corpus(4)
    docs = table(spark, rows)
    tried, whole = [], debruijn.Texts.word_hash

    def weak(t, seed=0):
        return whole(t, seed) % (3 if seed == 0 else 1 << 63)

    deal = debruijn.dealt_runs

    def with_weak_first(texts, width, inner, seed):
        tried.append(seed)
        if seed:
            return deal(texts, width, inner, seed)
        batch = texts.select("doc", "text").toArrow().combine_chunks().to_batches()[0]
        with monkeypatch.context() as patch:
            patch.setattr(debruijn.Texts, "word_hash", weak)
            runs = pa.Table.from_batches(list(debruijn.step_runs(batch, width, inner)))
        return spark.createDataFrame(runs, debruijn.RUNS)

    monkeypatch.setattr(debruijn, "dealt_runs", with_weak_first)
    assert removed(docs) == brute(rows) and tried == [0, 1]


def test_words_of_one_pattern_are_different_words(spark):
    """A Thue-Morse word of 1,024 letters and its complement, which a polynomial of the letters does not tell apart."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    same = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, other])), (3, " ".join([*same, one, "x"]))]
    assert removed(table(spark, rows)) == brute(rows)


def test_rows_of_one_id_and_without_an_id(spark):
    """Different texts under one doc_id or none are different documents; a row given twice is one document."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, passage), (None, "x " + passage), (None, "nothing of it"), (5, passage + " y"), (5, "z " + passage), (5, "z " + passage), (6, "short")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in debruijn.remove_repeats(table(spark, rows).repartition(3)).collect())
    assert sorted(r[2:] for r in got if not r[0]) in ([(3, 0), (40, 0), (41, 40)], [(3, 0), (40, 40), (41, 0)])
    assert [r for r in got if r[0]] == [(True, 5, 41, 40)] * 3 + [(True, 6, 1, 0)]


def test_steps_of_any_size_give_the_same(spark):
    """Buckets resolve what a step has not, wherever steps and batches are cut."""
    rows = corpus(3)
    want = brute(rows)

    def removed(step_bytes, batch_rows):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc", "text"])
        runs = [b for part in debruijn.steps(batch, limit=step_bytes) for b in debruijn.step_runs(part, 20, 5)]
        whole = pa.Table.from_batches(runs).sort_by([("bucket", "ascending"), ("doc", "ascending"), ("start", "ascending")]).combine_chunks()
        cover = {}
        for found in debruijn._resolve(b for b in whole.to_batches(max_chunksize=batch_rows)):
            for doc, start, n in zip(*(found.column(c).to_pylist() for c in ("doc", "start", "n"))):
                cover.setdefault(doc, set()).update(range(start, start + n + 19))
        return {i: len(cover.get(i, ())) for i, _ in rows}

    for step_bytes, batch_rows in ((1, 1), (500, 3), (1 << 20, 10_000), (3000, 50)):
        assert removed(step_bytes, batch_rows) == {i: w[1] for i, w in want.items()}


def test_spans_are_compact(spark):
    words = [f"w{k}" for k in range(300)]
    docs = table(spark, [(1, " ".join(words)), (2, "x y " + " ".join(words[40:200]) + " z"), (3, " ".join(words[:100]))])
    spans = {(r.doc, r.start, r.n, r.src_doc, r.src_start) for r in debruijn.repeated_spans(debruijn.numbered(docs)).collect()}
    assert spans == {(2, 2, 141, 1, 40), (3, 0, 81, 1, 0)}


def test_words_that_cycle_are_one_span(spark):
    """A word, a line or both over and over, and a copy of them, cost some rows and not one for each window."""
    cycles = [["spam"] * 500, ["buy", "now"] * 300, [f"l{k}" for k in range(30)] * 12]
    rows = [(k, " ".join(words)) for k, words in enumerate(cycles)] + [(10, " ".join([f"w{k}" for k in range(25)] + cycles[0] + cycles[2])), (11, " ".join(cycles[1][1:]))]
    docs = debruijn.numbered(table(spark, rows))
    spans = [tuple(x) for x in debruijn.repeated_spans(docs).collect()]
    assert sorted(spans)[:3] == [(0, 1, 480, 0, 0), (1, 2, 579, 1, 0), (2, 30, 311, 2, 0)]
    assert len(spans) < 30
    assert removed(table(spark, rows)) == brute(rows)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 5, 16, 17):
        assert debruijn.sliding_min(x, width).tolist() == [x[k : k + width].min() for k in range(51 - width)]


def test_odd_rows(odd_docs, no_docs):
    rows = debruijn.remove_repeats(odd_docs).collect()
    assert len(rows) == 13 and sum(r.n_removed for r in rows) == 0
    assert {r.n_words for r in rows if r.doc_id == 4} == {60_000}
    assert debruijn.remove_repeats(no_docs).count() == 0


def test_hot_buckets_are_dealt_by_window(spark, monkeypatch):
    """A five-word phrase in very many surroundings does not meet in one bucket; the result stays the same."""
    options = [[f"phrase{k}word{j}" for j in range(5)] for k in range(500)]
    words = debruijn.Texts(pa.array([" ".join(w for p in options for w in p)])).word_hash()
    phrase = options[int(np.argmin(debruijn.window_hash(words, 5)[::5]))]  # the phrase that is most often the minimiser
    r = random.Random(5)
    own = lambda i: [f"d{i}x{j}" for j in range(20)]
    rows = [(i, " ".join([*own(i), *phrase, *own(-i)])) for i in range(400)]
    rows += [(1000 + k, rows[r.randrange(400)][1] + " tail") for k in range(30)]
    docs = debruijn.numbered(table(spark, rows).repartition(5))
    largest = lambda docs=docs: debruijn.dealt_runs(docs).where("codes is not null").groupBy("bucket").sum("n").toPandas()["sum(n)"].max()
    assert largest() > 3000
    plain = {tuple(x) for x in debruijn.repeated_spans(docs).collect()}
    monkeypatch.setattr(debruijn, "SAMPLE", 1)
    monkeypatch.setattr(debruijn, "HOT", 200)
    assert largest() <= 200
    assert plain == {tuple(x) for x in debruijn.repeated_spans(docs).collect()}
    got = removed(table(spark, rows))
    assert got == brute(rows) and sum(v[1] for v in got.values()) >= 30 * 45
    # the bound stays as the corpus grows around the phrase
    more = [(5000 + i, " ".join(f"m{i}x{j}" for j in range(300))) for i in range(200)]
    assert largest(debruijn.numbered(table(spark, rows + more).repartition(5))) <= 200
    monkeypatch.setattr(debruijn, "MOST", 0)  # too many to list: every window by itself
    assert largest() <= 30 and plain == {tuple(x) for x in debruijn.repeated_spans(docs).collect()}
