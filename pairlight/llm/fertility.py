"""Tokeniser fertility rules: how well public vocabularies fit a text.

For every text and vocabulary three measures are taken over its words, each
encoded with one leading space: characters per token, the share of tokens that
are fallback bytes (for byte-level vocabularies: tokens that are not whole
characters) and the entropy of the token distribution in bits; and one over both
vocabularies: the first one's characters per token by the second one's. A
document is rejected where any of them leaves the band of its language, or of its
dominant script where the language has none. The bands come from text in many
languages that has nothing to do with the corpus: the message catalogues of
installed free software.

Counts are exact: words and lines are told apart by their bytes. Each distinct
word is encoded once by the library and its tokens are then gathered by array
indexing; words already encoded are known by 64-bit hashes.

Defined cases: a null or empty text has no words, fails the base rule and is not
kept; its measures are null. Texts are taken whole, whatever their length. Ties
and repeated rows give equal results; an empty table gives an empty result; only
doc_id, text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairlight.llm.text_arrays import Texts, repeated_rows, steps

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
#: Words that a worker keeps encoded.
MEMO_WORDS = 600_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: Scripts by the first code point of each range they cover.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "cjk"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "cjk"))
#: Entropy is judged by what so many tokens can have at most, so that long texts, which repeat their words, are judged like short ones.
ENTROPY_TOKENS = 512
#: By language or script: for both vocabularies the 1st and 99th percentile of characters per token, the 99th of the byte share and the
#: 1st of entropy by its room, and the 1st and 99th of the ratio of both. Measured over passages of 120 words of message catalogues.
MEASURED = {
    "en": ((2.807, 3.856, 0.000, 0.786), (2.774, 4.043, 0.141, 0.777), (0.907, 1.051)),
    "de": ((2.241, 2.816, 0.009, 0.830), (2.045, 2.423, 0.049, 0.822), (1.042, 1.242)),
    "fr": ((2.193, 2.868, 0.040, 0.811), (2.092, 2.657, 0.050, 0.806), (0.986, 1.143)),
    "es": ((2.239, 2.869, 0.000, 0.812), (2.072, 2.561, 0.038, 0.808), (1.025, 1.185)),
    "it": ((2.280, 2.885, 0.000, 0.838), (2.205, 2.673, 0.042, 0.827), (0.998, 1.135)),
    "nl": ((2.170, 2.668, 0.002, 0.806), (2.086, 2.491, 0.041, 0.793), (0.993, 1.149)),
    "pl": ((1.884, 2.265, 0.011, 0.819), (1.583, 1.912, 0.190, 0.787), (1.112, 1.295)),
    "pt": ((2.136, 2.745, 0.000, 0.813), (1.978, 2.453, 0.073, 0.797), (1.014, 1.197)),
    "latin": ((1.255, 3.348, 0.038, 0.747), (0.920, 3.451, 0.491, 0.676), (0.939, 1.396)),
    "greek": ((0.877, 1.079, 0.007, 0.535), (0.768, 0.966, 0.513, 0.579), (1.094, 1.173)),
    "cyrillic": ((1.428, 2.322, 0.015, 0.737), (0.741, 1.092, 0.543, 0.568), (1.749, 2.644)),
    "hebrew": ((0.807, 1.348, 0.138, 0.526), (0.608, 1.197, 0.860, 0.505), (1.092, 1.355)),
    "arabic": ((0.753, 1.071, 0.212, 0.485), (0.642, 0.956, 0.751, 0.517), (1.076, 1.332)),
    "indic": ((0.329, 0.900, 0.936, 0.396), (0.326, 0.596, 0.979, 0.383), (0.696, 2.315)),
    "cjk": ((0.875, 1.174, 0.181, 0.797), (0.517, 0.968, 0.881, 0.778), (1.129, 1.784)),
    "hangul": ((0.733, 1.013, 0.179, 0.697), (0.399, 0.598, 0.929, 0.630), (1.624, 1.923)),
    "other": ((0.354, 1.054, 0.849, 0.462), (0.333, 0.572, 1.000, 0.368), (1.060, 2.561)),
}
#: How far a band reaches beyond those percentiles, as a factor.
SLACK = 0.7


def bands_of(measured, slack: float = SLACK) -> dict[str, np.ndarray]:
    """(low, high) of each judged value, in the order of ``judged``."""

    def band(by_vocabulary, ratio):
        rows = []
        for low, high, share, entropy in by_vocabulary:
            rows += [(low * slack, high / slack), (0.0, 1 - (1 - share) * slack), (entropy * slack, np.inf)]
        return np.array([*rows, (ratio[0] * slack, ratio[1] / slack)])

    return {key: band(values[:-1], values[-1]) for key, values in measured.items()}


def judged(by: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """One row a text: characters per token, byte share and entropy by its room of each vocabulary, then the first one's characters per token by the second one's."""
    columns = []
    for n, per, share, entropy in by:
        columns += [per, share, entropy / np.log2(np.clip(n, 2, ENTROPY_TOKENS))]
    return np.stack([*columns, by[0][1] / by[1][1]], axis=1)


class WordTokens:
    """Tokens of distinct words under one vocabulary, kept as flat arrays."""

    def __init__(self, name: str):
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            self.encode = lambda words: model.encode(words, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            coder = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            for piece, i in ranks.items():
                try:
                    piece.decode()
                except UnicodeDecodeError:
                    self.is_byte[i] = True
            self.encode = lambda words: [coder.encode_ordinary(" " + w) for w in words]
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def rows(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """The rows of distinct words, encoding those not yet known; ``word_at(i)`` gives a word."""
        if len(self.row) + len(hashes) > MEMO_WORDS and self.row:
            self.clear()
        known = self.row
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in known]
        if new:
            tokens = self.encode([word_at(i) for i in new])
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            first, total = len(known), int(lengths.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(new) > len(self.begin):
                self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
            self.flat[self.used : self.used + total] = np.fromiter((t for ts in tokens for t in ts), np.int32, total)
            self.count[first : first + len(new)] = lengths
            self.begin[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.used += total
            known.update((keys[i], first + k) for k, i in enumerate(new))
        return np.fromiter((known[h] for h in keys), np.int64, len(keys))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of a sequence of rows, and how many each row has."""
        n = self.count[rows]
        shift = np.repeat(self.begin[rows] - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))], n


@lru_cache(maxsize=4)
def word_tokens(name: str) -> WordTokens:
    return WordTokens(name)


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """The word, symbol, line and repetition counts of each text."""
    words = t.numbers(t.start, t.end, t.word_hash())
    in_words = np.zeros(len(t.data) + 1, np.int64)
    in_words[t.start] += 1
    in_words[t.end] -= 1
    letters = (np.cumsum(in_words[:-1]) > 0) & ((t.data & 0xC0) != 0x80)
    start, end, doc = t.lines()
    has_word = np.searchsorted(t.start, end, "left") > np.searchsorted(t.start, start, "left")
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    again = repeated_rows(doc, t.numbers(start, end, t.span_hash(start, end)), later_only=True)
    first = np.flatnonzero(t.doc[:-2] == t.doc[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    twice = first[repeated_rows(t.doc[first], words[first], words[first + 1], words[first + 2])] if len(first) else first
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": t.words_per_doc(),
        "word_chars": t.per_doc(letters),
        "n_symbols": t.per_doc(SYMBOLS[t.data]),
        "n_dup_lines": np.bincount(doc[again], minlength=t.n),
        "n_repeat_words": t.words_per_doc(covered),
    }


def measures(t: Texts, vocabulary: str, word_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, characters per token, byte share and entropy in bits of each text; NaN without tokens."""
    coder = word_tokens(vocabulary)
    hashes = t.word_hash()
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    raw, start, end = t.data, t.start, t.end
    rows = coder.rows(distinct, lambda i: raw[start[at[i]] : end[at[i]]].tobytes().decode("utf-8", "replace"))
    tokens, n = coder.gather(rows[back])
    doc = np.repeat(t.doc, n)
    total = np.bincount(doc, minlength=t.n)
    fallback = np.bincount(doc[coder.is_byte[tokens]], minlength=t.n)
    cells, seen = np.unique(doc * np.int64(len(coder.is_byte)) + tokens, return_counts=True)
    logs = np.bincount(cells // len(coder.is_byte), weights=seen * np.log2(seen), minlength=t.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total, word_chars / total, fallback / total, np.maximum(0.0, np.log2(total) - logs / total)


def scripts(t: Texts) -> np.ndarray:
    """The script that most letters of each text have, by the lead of their code points."""
    names = sorted({name for _, name in SCRIPTS})
    lead = np.flatnonzero((t.data & 0xC0) != 0x80)
    byte = t.data[lead].astype(np.int64)
    pad = np.concatenate([t.data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    point = np.where(byte < 0x80, byte, np.where(byte < 0xE0, (byte & 0x1F) << 6 | pad[lead + 1], np.where(byte < 0xF0, (byte & 0x0F) << 12 | pad[lead + 1] << 6 | pad[lead + 2], (byte & 7) << 18 | pad[lead + 1] << 12 | pad[lead + 2] << 6 | pad[lead + 3])))
    letter = (point >= 0x80) | ((point | 0x20) >= 0x61) & ((point | 0x20) <= 0x7A)
    lead, point = lead[letter], point[letter]
    codes = np.array([names.index(name) for _, name in SCRIPTS])
    which = codes[np.maximum(0, np.searchsorted([p for p, _ in SCRIPTS], point, "right") - 1)]
    votes = np.bincount(t.doc_of(lead) * len(names) + which, minlength=t.n * len(names)).reshape(t.n, len(names))
    return np.where(votes.sum(1) > 0, np.array(names, object)[votes.argmax(1)], "other")


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, measures array<struct<vocabulary:string,n_tokens:long,chars_per_token:double,byte_share:double,token_entropy:double>>"
_MEASURE = pa.struct([("vocabulary", pa.string()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64())])


def fertility_rules(docs: DataFrame, *, vocabularies=VOCABULARIES, measured=MEASURED, slack: float = SLACK, min_words: int = MIN_WORDS, max_repeat_share: int = MAX_REPEAT_SHARE) -> DataFrame:
    """Base counts, fertility measures and the verdict for every document.

    ``measured`` has, for a language code or a script name, what prose usually
    measures under the two vocabularies; ``slack`` widens it to the bands.
    """
    bands = bands_of(measured, slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                t = Texts(batch.column("text"))
                base = base_counts(t)
                failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_share * base["n_words"])
                by = [measures(t, v, base["word_chars"]) for v in vocabularies]
                script = scripts(t)
                langs = batch.column("lang").to_pylist()
                band = np.stack([bands.get(lang, bands.get(s, bands["other"])) for lang, s in zip(langs, script)])
                with np.errstate(invalid="ignore"):
                    value = judged(by)
                    good = ((value >= band[:, :, 0]) & (value <= band[:, :, 1])).all(1)
                cells = [pa.StructArray.from_arrays([pa.array([v] * t.n, pa.string()), pa.array(m[0], pa.int64()), *(pa.array(x, pa.float64(), mask=m[0] == 0) for x in m[1:])], fields=list(_MEASURE)) for v, m in zip(vocabularies, by)]
                order = np.arange(t.n * len(cells)).reshape(len(cells), t.n).T.ravel()
                listed = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * len(cells), pa.int32()), pa.concat_arrays(cells).take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & good), pa.array(script.tolist(), pa.string()), listed], names=[f.split(" ")[0] for f in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "measures")])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, SCHEMA)


def op1_tokenizer_fertility(spark, sf_dir: str) -> DataFrame:
    """The fertility rules over every whole text of ``documents``."""
    return fertility_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
