import hashlib
import random

import pytest
import sentencepiece

from pairlight.llm import piece_bpe
from tests.llm.test_words import random_texts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())


def test_ids_and_decoding_equal_the_library(library):
    model, r = piece_bpe.load(piece_bpe.model_path()), random.Random(5)
    pieces = [p.replace(piece_bpe.MARK, " ") for p in model.ids]
    texts = [*random_texts(300, 9), "", " ", "  two  spaces ", "▁ ▁▁x", "<s></s><0x0A>", "\x00​ ﷽ 🎉", "a" * 500, " " * 70 + "\n" * 9]
    texts += ["".join(r.choices(pieces, k=r.randint(1, 40))) for _ in range(300)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_queries_rows(spark, odd_docs, no_docs, library):
    for row, (i, text) in zip(
        sorted(piece_bpe.encode_digest(odd_docs, piece_bpe.model_path()).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens)),
        sorted([(r.doc_id, r.text) for r in odd_docs.collect()], key=lambda r: (r[0] or 0, len(library.encode(r[1] or "")))),
    ):
        ids = library.encode(text or "")
        assert (row.doc_id, row.n_tokens) == (i, len(ids))
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_table(no_docs, piece_bpe.model_path()).count() == 0
