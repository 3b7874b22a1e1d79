import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from pairlight.llm import pii_crf
from pairlight.llm.text_arrays import Texts
from tests.llm.conftest import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789 .-+@()ab") for _ in range(r.randint(0, 50)))
        assert pii_crf.base_spans(text) == brute(text), text
    assert pii_crf.luhn("4539578763621486") and not pii_crf.luhn("4539578763621487")
    assert pii_crf.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def exact(field, g):
    """Marginals by summing over all labellings."""
    n, k = len(g.doc), len(pii_crf.LABELS)
    unary = field.unary(g.shape)
    unary[np.arange(n), g.label] += np.where(g.label > 0, pii_crf.OBSERVED, 0.0)
    grids = np.meshgrid(*[np.arange(k)] * n, indexing="ij")
    score = sum(unary[i][grids[i]] for i in range(n))
    for links, power in ((g.near, field.near), (g.skip, field.skip)):
        for a, b in links:
            score = score + power[grids[a], grids[b]]
    p = np.exp(score - score.max())
    p /= p.sum()
    return np.array([[p[grids[i] == y].sum() for y in range(k)] for i in range(n)])


def some_field(seed):
    r = np.random.default_rng(seed)
    return pii_crf.Field(r.normal(size=(len(pii_crf.FEATURES), 5)) * 0.3, r.normal(size=(5, 5)) * 0.3, (lambda m: (m + m.T) / 4)(r.normal(size=(5, 5))))


def test_messages_are_exact_on_trees_and_close_on_loops():
    column = pa.array(["a1 b2 c3 x d4", "k9 x k9 y 5552485 z 5552485 k9"])
    g = pii_crf.graph(Texts(column), column)
    for seed in range(4):
        field = some_field(seed)
        got = field.posteriors(g)
        for d, tolerance in ((0, 1e-3), (1, 0.05)):
            at = np.flatnonzero(g.doc == d)
            local = lambda links: links[np.isin(links[:, 0], at)] - at[0]
            part = pii_crf.Graph(g.doc[at], g.start[at], g.end[at], g.shape[at], g.label[at], local(g.near), local(g.skip), {})
            assert np.abs(got[at] - exact(field, part)).max() < tolerance


def test_links_join_equal_and_similar_words():
    column = pa.array(["call +1 (988) 555-2485, or 5552485; AB12 and ab12.", None, ""])
    g = pii_crf.graph(Texts(column), column)
    words = [column[0].as_py()[a:b] for a, b in zip(g.start, g.end)]
    assert words == ["+1", "(988)", "555-2485,", "5552485;", "AB12", "ab12."]
    assert g.near.tolist() == [[0, 1], [1, 2], [3, 4]] and g.skip.tolist() == [[2, 3], [4, 5]]


def test_consistency_adds_a_repeated_mention(spark):
    rows = [(k, f"text {k}. reach me at +1 ({200 + k}) 555-{1000 + k} or u{k}@mail{k}.example.com from 10.0.{k}.7 version 2.{k} page {k}") for k in range(120)]
    rows.append((500, "ring +1 (988) 555-2485 now, again 555-2485 please"))
    docs = table(spark, rows)
    found = {r.doc_id: r for r in pii_crf.find_spans(docs).collect()}
    for i, text in rows:
        assert [tuple(s) for s in found[i].base] == brute(text)
    assert [(s.kind, rows[-1][1][s.start : s.end]) for s in found[500].added] == [("phone", "555-2485")]
    assert not any(found[k].added for k in range(120))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii_crf.find_spans(odd_docs).collect()
    assert len(rows) == 13 and not any(r.base for r in rows if r.doc_id in (1, 2, 3))
    assert pii_crf.find_spans(no_docs).count() == 0


def test_agreement_reaches_every_mention_of_a_long_document():
    """One full form anchors all 60 later short forms alike; agreement does not fade with the number of mentions between."""
    column = pa.array(["ring +1 (988) 555-2485 now " + "or 555-2485 then " * 60, "555-2485 or " * 30 + "+1 (988) 555-2485"])
    g = pii_crf.graph(Texts(column), column)
    labels = len(pii_crf.LABELS)
    field = pii_crf.Field(np.zeros((len(pii_crf.FEATURES), labels)), np.zeros((labels, labels)), 5 * np.eye(labels))
    phone = field.posteriors(g)[:, pii_crf.LABELS.index("phone")]
    assert phone.min() > 0.9
    assert len(g.skip) == 60 + 30


def test_messages_stand_still_whatever_else_is_in_the_step():
    texts = ["a1 b2 c3 x d4", "k9876 x k9876 y 5552485 z 5552485 k9876", "7 8 9 " * 40, "nothing"]
    column = pa.array(texts)
    for seed in range(4):
        field = some_field(seed)
        g = pii_crf.graph(Texts(column), column)
        together = field.posteriors(g)
        for d, text in enumerate(texts):
            alone = pa.array([text])
            one = pii_crf.graph(Texts(alone), alone)
            assert np.array_equal(field.posteriors(one), together[g.doc == d])


def test_training_counts_all_documents(spark):
    rows = [(k, f"page {k}") for k in range(6_500)] + [(None, "from 10.0.3.7")]
    seen = []
    keep, pii_crf.fit = pii_crf.fit, lambda shapes, labels, counts, pairs: seen.append(counts.sum())
    try:
        pii_crf.train(table(spark, rows))
    finally:
        pii_crf.fit = keep
    assert seen == [6_501]


def test_blocks_of_any_size_give_the_same(monkeypatch):
    texts = ["a1 b2 c3 x d4", "k9876 x k9876 y 5552485 z 5552485 k9876", "7 8 9 " * 40, "nothing", "1 22 1 333 22 4444 4444"]
    column = pa.array(texts)
    g = pii_crf.graph(Texts(column), column)
    field = some_field(1)
    whole = field.posteriors(g)
    for nodes in (1, 7, 50):
        monkeypatch.setattr(pii_crf, "NODES", nodes)
        assert np.array_equal(field.posteriors(g), whole)


def test_tables_of_numbers_stay_cheap():
    """Two megabytes of one-digit words: seconds, and memory by the word and not by the link's matrix."""
    r = random.Random(6)
    column = pa.array([" ".join(str(r.randint(0, 9)) for _ in range(1_000_000))])
    field = some_field(2)
    began = time.time()
    tracemalloc.start()
    g = pii_crf.graph(Texts(column), column)
    assert pii_crf.added_spans(g, field.posteriors(g), column) is not None
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert time.time() - began < 60


def test_what_the_field_adds_over_the_base_spans(spark):
    """Planted short forms of a number that the text gives in full elsewhere, and numbers of the same shape that it does not."""
    r = random.Random(31)
    number = lambda: f"{r.randint(200, 999)}-{r.randint(1000, 9999)}"
    rows, planted, decoys = [], [], []
    for k in range(400):
        own, other = number(), number()
        words = [f"word{r.randint(0, 50)}".rstrip("0123456789") for _ in range(60)]
        for at, text in sorted(((r.randint(0, 60), f"+1 ({r.randint(200, 999)}) {own}"), (r.randint(0, 60), f"ring {own} again"), (r.randint(0, 60), f"order {other} shipped")), reverse=True):
            words.insert(at, text)
        text = " ".join(words)
        rows.append((k, text))
        planted.append((k, text.index(f"ring {own}") + 5, len(own)))
        decoys.append((k, text.index(f"order {other}") + 6, len(other)))
    added = {x.doc_id: [(s.start, s.end) for s in x.added] for x in pii_crf.find_spans(table(spark, rows)).collect()}
    hit = lambda marks: sum(any(a <= at and b >= at + n for a, b in added[k]) for k, at, n in marks) / len(marks)
    assert hit(planted) >= 0.9 and hit(decoys) <= 0.02, (hit(planted), hit(decoys))
    print("recall of the planted short forms", hit(planted), "decoys", hit(decoys))
