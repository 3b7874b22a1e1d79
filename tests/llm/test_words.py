import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pairlight.llm import fertility
from pairlight.llm.text_arrays import Texts, repeated_rows, steps, window_hash

WORD = re.compile("[^\x20\x09-\x0d]+")


def expected(text):
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    seen, covered = Counter(triples), set()
    for k, triple in enumerate(triples):
        if seen[triple] > 1:
            covered |= {k, k + 1, k + 2}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def random_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice("ab c\n\t#é世🎉|  \x0b") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_counts_equal_brute_force():
    texts = [*random_texts(400), None, "", "a a a a\na a a a\n\n\n"]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    got = []
    for part in steps(batch, limit=700):
        base = fertility.base_counts(Texts(part.column("text")))
        got += list(zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [expected(t or "") for t in texts]


def test_words_and_lines_of_one_pattern_are_told_apart():
    """Thue-Morse words and their complements, alone, as lines, and as the words of a line."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{other}\n{one}", f"{' '.join(one)}\n{' '.join(other)}", f"x {one} y x {other} y x {one} y"]
    base = fertility.base_counts(Texts(pa.array(texts)))
    assert list(zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [expected(t) for t in texts]


def test_bytes_decide_whatever_the_hashes_say():
    texts = random_texts(60, seed=5)
    t = Texts(pa.array(texts))
    for hashes in (t.word_hash(), t.word_hash() % 2, np.zeros(len(t.start), np.uint64)):
        numbers = t.numbers(t.start, t.end, hashes)
        words = [t.data[a:b].tobytes() for a, b in zip(t.start, t.end)]
        assert len(set(zip(words, numbers.tolist()))) == len(set(words)) == len(set(numbers.tolist()))
    columns = [np.random.default_rng(k).integers(0, 4, 500) for k in (1, 2, 3)]
    rows = list(zip(*columns))
    assert repeated_rows(*columns).tolist() == [rows.count(r) > 1 for r in rows]
    assert repeated_rows(*columns, later_only=True).tolist() == [r in rows[:k] for k, r in enumerate(rows)]


def test_window_hashes_depend_on_their_entries_alone():
    h = np.random.default_rng(0).integers(0, 1 << 63, 60, dtype=np.uint64)
    for width in (1, 2, 3, 5, 7, 16, 19, 20, 60):
        whole = window_hash(h, width)
        assert whole.tolist() == [window_hash(h[k : k + width], width)[0] for k in range(61 - width)]
    assert len(window_hash(h[:3], 4)) == 0


def test_measures_equal_the_library():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["hello there hello 世界 ﷽ again", "", "x"]
    t = Texts(pa.array(texts))
    base = fertility.base_counts(t)
    n, per, share, entropy = fertility.measures(t, "piece_bpe_32k.model", base["word_chars"])
    for k, text in enumerate(texts):
        ids = [i for w in text.split() for i in model.encode(w)]
        assert n[k] == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(entropy[k] + (p * np.log2(p)).sum()) < 1e-9
            assert share[k] == sum(model.is_byte(i) for i in ids) / len(ids)
            assert per[k] == sum(map(len, text.split())) / len(ids)


def test_scripts():
    t = Texts(pa.array(["plain words", "слова здесь", "日本語です", "123 !!", None, "한국어"]))
    assert fertility.scripts(t).tolist() == ["latin", "cyrillic", "cjk", "other", "other", "hangul"]


def test_bands_reject_and_odd_rows(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in fertility.fertility_rules(odd_docs).collect()}
    assert len(rows) == 12 and not rows[1].kept and rows[1].base_failed and rows[4].n_words == 60_000
    assert rows[2].measures[0].chars_per_token is None
    assert fertility.fertility_rules(no_docs).count() == 0
    good = (
        "The garden behind the old house had been left alone for years, and nobody in the village could say who owned it. Every spring the apple trees "
        "flowered as if someone still cared for them, while brambles slowly covered the stone paths and the well. Children climbed over the low wall to "
        "pick fruit in autumn, and their parents pretended not to notice."
    )
    docs = spark.createDataFrame([(1, good, "en"), (2, " ".join("q$%^&*zx" + c + "%%" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in fertility.fertility_rules(docs).collect()} == {1: True, 2: False}
