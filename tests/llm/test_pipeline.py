import re

import corpus_pipeline
import sentencepiece
from pairlight.llm import boosting, mixing, ngram_join, piece_bpe, secret_scan
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = seen[name] = stage(spark, docs, SF).cache()
        if name != "encode":
            assert rows.columns == columns
            before, docs = docs, rows
            ids = {r.doc_id for r in docs.collect()}
            assert ids <= {r.doc_id for r in before.collect()}
    start = spark.read.parquet(f"{SF}/documents.parquet")
    # 1: exactly the documents that the classifier keeps
    scores = boosting.score(start, boosting.train(start, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {r.doc_id for r in seen["quality"].collect()} == {r.doc_id for r in scores if r.score >= 0.3}
    # 2: one document of each class
    texts = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    classes = brute(texts)
    assert sorted(r.doc_id for r in seen["near_duplicates"].collect()) == sorted(i for i, c in classes.items() if c[0] == i)
    # 3: no base secret is left, and nothing else is touched
    clean = {r.doc_id: r for r in seen["secrets"].collect()}
    for r in seen["near_duplicates"].collect():
        spans = [m for rule, group, least in ((secret_scan.ASSIGN, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24)) for m in re.finditer(rule, r.text or "") if len(m.group(group)) >= least]
        if not spans and "[SECRET]" not in (clean[r.doc_id].text or ""):
            assert clean[r.doc_id].text == r.text
        for m in spans:
            assert m.group() not in clean[r.doc_id].text
    # 4: documents as often as the mix takes them
    taken = {r.doc_id: r.copies for r in mixing.pareto_mix(seen["secrets"]).collect()}
    counts = {r.doc_id: r["count"] for r in seen["mix"].groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    # 5: ids of every text
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    lengths = {r.doc_id: len(library.encode(r.text or "")) for r in seen["mix"].collect()}
    encoded = seen["encode"].collect()
    assert len(encoded) == sum(counts.values()) and all(r.n_tokens == lengths[r.doc_id] for r in encoded)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "encode":
                assert out.columns == docs.columns
            n = out.count()
            assert n >= 0 if docs is odd_docs else n == 0
    kept = sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, odd_docs, SF).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_near_duplicates_use_the_stated_rule():
    assert (ngram_join.WIDTH, ngram_join.THRESHOLD) == (5, 0.8)


def test_the_first_of_rows_with_one_id_and_text_stays(spark):
    """Rows that differ only in source or in another column: the same one stays in any order; rows without an id all stay."""
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(5, text, "en", s, n) for s in ("c", "b", None, "a") for n in (2, 1)] + [(None, text, "en", "x", 1), (None, text, "en", "y", 1), (None, text, "en", "y", 1), (9, text + " and again", "en", "z", 3), (9, "short", "en", "z", 3)] + [(7, "other words", "en", "k", 1)] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, schema).repartition(3)
        found.append(sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=repr))
    assert found[0] == found[1] == found[2]
    assert [r for r in found[0] if r[0] == 5] == [(5, text, "en", None, 1)]
    assert len([r for r in found[0] if r[0] is None]) == 3 and len([r for r in found[0] if r[0] == 7]) == 1 and len([r for r in found[0] if r[0] == 9]) == 2
