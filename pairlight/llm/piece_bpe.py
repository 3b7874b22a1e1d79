"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is what the merges produce exactly if every neighbouring
pair is: so the longest piece at each place, found by an Aho-Corasick automaton,
is tried first; a pair is accepted if merging its joined characters again gives
that pair; where nothing fits, the place is marked in a bitfield as failed and
the last piece is replaced by its next shorter one. No piece has a space mark
after another character (checked on loading), so merges never cross from a word
into the next word's space mark and words are encoded independently; frequent
ones are memoised.

Defined cases: a null text is an empty text, with no ids and an empty decoding;
characters outside the vocabulary become byte pieces; texts of any length are
encoded whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Memoised segments of a worker, and the longest that is memoised.
MEMO_SEGMENTS, MEMO_CHARS = 400_000, 48
MEMO_PAIRS = 2_000_000


class PieceBpe:
    """Encoder and decoder for one public BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if library.normalize("ﬁ  x") != f"{MARK}ﬁ{MARK}{MARK}x":
            raise ValueError("only identity normalisation with a leading space mark is supported")
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        self.id_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if library.is_control(i)}
        if len(self.byte_id) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if i in self.id_byte or i in self.control or library.is_unknown(i):
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} joins words")
            self.ids[piece], self.rank[piece] = i, -library.get_score(i)
            if len(piece) > 1:  # single characters are always candidates
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | self.id_byte | {i: b"" for i in self.control}
        self.unknown = next(i for i in range(n) if library.is_unknown(i))
        self.raw[self.unknown] = " ⁇ ".encode()
        self.decimal = {p: str(i) for p, i in self.ids.items()}
        self.raw_of = {str(i): b for i, b in self.raw.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.memo: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Merge characters by rank, leftmost first: for pairs of pieces, which are short."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def compatible(self, left: str, right: str) -> bool:
        if (known := self.fits.get((left, right))) is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a normalised segment; characters outside the vocabulary stand alone."""
        n, whole, fits = len(text), self.whole, self.fits
        found: list[list[str]] = [[c] for c in text]
        for end, (back, piece) in self.automaton.iter(text):
            known = whole.get(piece)
            if self.reachable(piece) if known is None else known:
                found[end - back].append(piece)
        failed: bytearray | None = None  # made when a place fails first
        taken: list[str] = []
        tried: list[int] = []  # index of the candidate taken at each place on the way
        last, at, k = None, 0, len(found[0]) - 1 if n else -1
        while at < n:
            options = found[at]
            while k >= 0:
                piece = options[k]
                to = at + len(piece)
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    if last is None:
                        break
                    known = fits.get((last, piece))
                    if self.compatible(last, piece) if known is None else known:
                        break
                k -= 1
            if k >= 0:
                taken.append(piece)
                tried.append(k)
                last, at = piece, to
                k = len(found[at]) - 1 if at < n else -1
            else:
                if not taken:
                    raise ValueError("no encoding")  # single characters always fit at the start
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                last = taken[-1] if taken else None
                k = tried.pop() - 1
        return taken

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.byte_id[b] for b in piece.encode())
            else:
                out.append(i)
        return out

    def segment_ids(self, segment: str) -> str:
        """Decimal ids joined by commas."""
        pieces = self.split(segment)
        try:
            ids = ",".join([self.decimal[p] for p in pieces])
        except KeyError:  # characters outside the vocabulary
            ids = ",".join(map(str, self.to_ids(pieces)))
        if len(segment) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SEGMENTS:
                self.memo.clear()
                self.back.clear()
            self.memo[segment] = ids
        return ids

    def encode_joined(self, text: str) -> list[str]:
        """The ids of each segment, as joined decimals."""
        if not text:
            return []
        memo = self.memo
        return [memo.get(s) or self.segment_ids(s) for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.encode_joined(text or "") for i in part.split(",")]

    def bytes_of(self, joined: str) -> bytes:
        if (known := self.back.get(joined)) is None:
            known = b"".join([self.raw_of[i] for i in joined.split(",")])
            if len(joined) <= 4 * MEMO_CHARS and len(self.back) < MEMO_SEGMENTS:
                self.back[joined] = known
        return known

    def decode_joined(self, parts: list[str]) -> str:
        """The text of joined ids; the leading space mark goes, broken byte runs give U+FFFD."""
        out = b"".join(map(self.bytes_of, parts)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined([str(i) for i in ids])


@lru_cache(maxsize=2)
def load(model_file: str) -> PieceBpe:
    """One model for each worker process."""
    return PieceBpe(model_file)


def encode_table(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text, ids and decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [model.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(i) for i in ids], pa.string())], ["doc_id", "text", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and of the decoded text, encoded and decoded as above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = load(model_file), hashlib.sha256
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1):
                parts = model.encode_joined(text.as_py() or "")
                joined = ",".join(parts)
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(sha(joined.encode()).hexdigest())
                texts.append(sha(model.decode_joined(parts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece_backtracking(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded with the 32k piece model."""
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
