"""Media columns: bytes stored as baseline JPEG, read back as DC-only luminance thumbnails.

Writing: one payload byte is one flat 8x8 block. Its DC coefficient is the only
one that is not zero and is quantised by 8, so the block's mean sample is the
byte itself and nothing is lost. 64 blocks make a row of the picture and one
restart interval; payloads of more than ``MAX_ROWS`` rows become several pictures
one after another.

Reading: any baseline JPEG. Markers are parsed, the entropy-coded scan is split at
its restart markers and all intervals of a step are Huffman-decoded in lockstep
with numpy; AC coefficients are skipped, DC differences are summed and dequantised,
and the luminance means form a thumbnail with one pixel a block.

Defined cases: a null text is an empty text, stored as 64 zero bytes; equal texts
give equal pictures and features; a null or broken picture raises ``ValueError``
in ``thumbnails`` and is never skipped; texts are stored whole; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairlight.llm.text_arrays import Texts, steps

#: Blocks in a row, and rows in a picture (65,528 pixels).
WIDTH, MAX_ROWS = 64, 8191
#: Fixed values of the format: DC code lengths of the standard luminance table, and the order of coefficients.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: One AC code, for the end of the block.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])
_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of a Huffman table as DHT states it."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(counts, symbols).items():
        symbol[code << 16 - n : code + 1 << 16 - n] = s
        length[code << 16 - n : code + 1 << 16 - n] = n
    return symbol, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big")
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, b"\0" + bytes([8] + [1] * 63)),
        _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, WIDTH.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit counts of a block by its DC difference + 255, the end-of-block code included."""
    dc, (end, end_n) = codes(DC_COUNTS, DC_SYMBOLS), codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, counts = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = dc[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        bits[diff + 255] = ((code << size | extra) << end_n) | end
        counts[diff + 255] = n + size + end_n
    return bits, counts


_BITS, _COUNTS = _encode_tables()


def encode_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan of each payload row, stuffed, as one byte array; and where each row's part ends."""
    diff = np.diff(rows.astype(np.int64) - 128, axis=1, prepend=0)
    bits, count = _BITS[diff + 255], _COUNTS[diff + 255]
    used = count.sum(1)
    fill = -used % 8
    bits = np.concatenate([bits, ((1 << fill) - 1).astype(np.uint64)[:, None]], axis=1)
    count = np.concatenate([count, fill[:, None]], axis=1)
    size = (used + fill) // 8
    at = (np.cumsum(count, axis=1) - count + 8 * (np.cumsum(size) - size)[:, None]).ravel()
    window = bits.ravel() << (32 - count.ravel() - (at & 7)).astype(np.uint64)
    packed = np.zeros(int(size.sum()) + 4, np.float64)
    for k in range(4):
        part = (window >> np.uint64(24 - 8 * k)) & np.uint64(0xFF)
        packed += np.bincount((at >> 3) + k, weights=part, minlength=len(packed))[: len(packed)]
    packed = packed[: int(size.sum())].astype(np.uint8)
    full = packed == 0xFF
    before = np.cumsum(full) - full
    out = np.zeros(len(packed) + int(full.sum()), np.uint8)
    out[np.arange(len(packed)) + before] = packed
    stuffed = np.concatenate([[0], np.cumsum(full)])
    ends = np.cumsum(size)
    return out, ends + stuffed[ends]


def encode_payloads(rows: np.ndarray, n_rows: np.ndarray) -> list[bytes]:
    """Pictures of payloads given as rows of 64 bytes, ``n_rows`` for each payload."""
    scan, ends = encode_rows(rows)
    body, starts = scan.tobytes(), np.concatenate([[0], ends[:-1]])
    starts, ends = starts.tolist(), ends.tolist()
    out, at = [], 0
    for n in n_rows.tolist():
        frames = []
        for first in range(0, n, MAX_ROWS):
            height = min(MAX_ROWS, n - first)
            frames.append(_head(height))
            for k in range(height):
                r = at + first + k
                frames.append(body[starts[r] : ends[r]])
                if k + 1 < height:
                    frames.append(bytes([0xFF, 0xD0 + k % 8]))
            frames.append(b"\xff\xd9")
        out.append(b"".join(frames))
        at += n
    return out


@dataclass
class Frame:
    """What the markers of one picture say."""

    width: int = 0
    height: int = 0
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of the part, DC table, AC table
    body: bytes = b""

    def blocks(self) -> tuple[tuple[int, int, int], ...]:
        """(part, DC table, AC table) of the blocks of one unit of the scan."""
        if len(self.scan) == 1:
            return ((*self.scan[0],),)
        return tuple((p, d, a) for p, d, a in self.scan for _ in range(self.parts[p][1] * self.parts[p][2]))

    def grid(self) -> tuple[int, int, int, int]:
        """Units across and down, and blocks of luminance in a unit across and down."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.scan) == 1:
            _, ph, pv, _ = self.parts[self.scan[0][0]]
            return -(-self.width * ph // (8 * h)), -(-self.height * pv // (8 * v)), 1, 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), self.parts[0][1], self.parts[0][2]


def parse(data: bytes) -> list[Frame]:
    """The pictures in ``data``, which may hold several one after another."""
    frames, at, frame = [], 0, None
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise ValueError("a marker is missing")
        marker, at = data[at + 1], at + 2
        if marker == 0xFF:  # fill byte
            at -= 1
        elif marker == 0xD8:
            frame = Frame()
        elif frame is None:
            raise ValueError("no start of image")
        elif marker == 0xD9:
            frames.append(frame)
            frame = None
        else:
            n = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + n], at + n
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, t = body[k] >> 4, body[k] & 15
                    frame.quant[t] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    frame.tables[body[k]] = counts, body[k + 17 : k + 17 + sum(counts)]
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body, "big")
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("8-bit samples are needed")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif marker == 0xDA:
                if not frame.parts:
                    raise ValueError("a scan without a frame")
                ids = [p[0] for p in frame.parts]
                scan = [(ids.index(body[k]), body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
                end = _END.search(data, at)
                stop = end.start() if end else len(data)
                if not frame.scan and scan[0][0] == 0:  # the scan with luminance
                    frame.scan, frame.body = scan, data[at:stop]
                at = stop
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline picture")
    if frame is not None or not frames or any(not f.scan for f in frames):
        raise ValueError("the picture ends early")
    return frames


def _intervals(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and restart markers; starts of the intervals; intervals in each body."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    begins = np.cumsum([0] + [len(b) for b in bodies[:-1]])
    full = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) > 1 else np.zeros(0, np.int64)
    follows = raw[full + 1]
    restarts = full[(follows >= 0xD0) & (follows <= 0xD7)]
    drop = np.zeros(len(raw), bool)
    drop[full[follows == 0] + 1] = True
    drop[restarts] = drop[restarts + 1] = True
    shift = np.concatenate([[0], np.cumsum(drop)])
    starts = np.sort(np.concatenate([begins, restarts + 2]))
    per = np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(bodies))
    return np.concatenate([raw[~drop], np.full(8, 0xFF, np.uint8)]), starts - shift[starts], per


def _dc(frames: list[Frame]) -> list[np.ndarray]:
    """Quantised luminance DC values of frames with equal tables and layout, in scan order."""
    layout, lead = frames[0].blocks(), frames[0].scan[0][0]
    data, starts, per = _intervals([f.body for f in frames])
    wide = data.astype(np.uint64)
    wide = wide[:-3] << np.uint64(24) | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(8) | wide[3:]
    last = len(wide) - 1

    def peek(at: np.ndarray) -> np.ndarray:
        return ((wide[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64)) >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)

    units = []
    for f, n in zip(frames, per.tolist()):
        across, down, _, _ = f.grid()
        total, step = across * down, f.restart or across * down
        count = np.minimum(step, total - step * np.arange(n))
        if step * n < total or (count <= 0).any():
            raise ValueError("restart intervals and picture size disagree")
        units.append(count)
    units = np.concatenate(units)
    order = np.argsort(-units, kind="stable")
    at, left = starts[order] * 8, units[order]
    tables = {t: lookup(*frames[0].tables[t]) for t in {d for _, d, _ in layout} | {16 + a for _, _, a in layout}}
    mine = sum(p == lead for p, _, _ in layout)
    out = np.zeros((len(units), int(left[0]) * mine), np.int16)
    level = {p: np.zeros(len(units), np.int64) for p, _, _ in layout}
    for unit in range(int(left[0])):
        live = int(np.searchsorted(-left, -unit, "left"))
        pos, k = at[:live], 0
        for part, d, a in layout:
            symbol, length = tables[d]
            bits = peek(pos)
            size, n = symbol[bits], length[bits]
            if not n.all() or (size > 11).any():
                raise ValueError("a code is not in the table")
            pos = pos + n
            extra = peek(pos) >> (16 - size)
            level[part][:live] += np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
            pos = pos + size
            if part == lead:
                out[:live, unit * mine + k] = level[part][:live]
                k += 1
            symbol, length = tables[16 + a]
            index, seen = np.arange(live), np.zeros(live, np.int64)
            while len(index):
                bits = peek(pos[index])
                both, n = symbol[bits], length[bits]
                if not n.all():
                    raise ValueError("a code is not in the table")
                run, size = both >> 4, both & 15
                pos[index] += n + size
                seen[index] += np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
                index = index[seen[index] < 63]
        at[:live] = pos
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    ends, result = np.cumsum(per), []
    for f, hi, n in zip(frames, ends.tolist(), per.tolist()):
        rows, count = out[back[hi - n : hi]], units[hi - n : hi] * mine
        result.append(rows.ravel() if (count == rows.shape[1]).all() else np.concatenate([r[:c] for r, c in zip(rows, count)]))
    return result


def thumbnails(pictures: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stored value its pictures: width, height and the luminance mean of every block."""
    parsed = [parse(p) if p is not None else parse(b"") for p in pictures]
    groups: dict = defaultdict(list)
    for i, frames in enumerate(parsed):
        for k, f in enumerate(frames):
            groups[tuple(sorted(f.tables.items())), f.blocks(), tuple(f.parts)].append((i, k, f))
    found: dict = {}
    for members in groups.values():
        for (i, k, f), dc in zip(members, _dc([f for _, _, f in members])):
            across, down, bw, bh = f.grid()
            if bw * bh > 1:
                dc = dc.reshape(down, across, bh, bw).transpose(0, 2, 1, 3)
            level = dc.reshape(down * bh, across * bw).astype(np.int64) * f.quant[f.parts[0][3]]
            h, v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            rows, columns = -(-f.height * f.parts[0][2] // (8 * v)), -(-f.width * f.parts[0][1] // (8 * h))
            found[i, k] = f.width, f.height, np.clip(np.floor_divide(level + 4, 8) + 128, 0, 255).astype(np.uint8)[:rows, :columns]
    return [[found[i, k] for k in range(len(frames))] for i, frames in enumerate(parsed)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8x8 reduction are lighter than the mean cell."""
    rows, columns = ((np.arange(9) * n) // 8 for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    low, high, left, right = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    cell = total[np.ix_(high, right)] - total[np.ix_(low, right)] - total[np.ix_(high, left)] + total[np.ix_(low, left)]
    mean = cell / ((high - low)[:, None] * (right - left)[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def payload_rows(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of 64 bytes, zero-filled to a positive number of rows each."""
    size = np.diff(t.off)
    n = np.maximum(1, -(-size // WIDTH))
    first = np.cumsum(n) - n
    rows = np.zeros(int(n.sum()) * WIDTH, np.uint8)
    rows[np.arange(len(t.data)) + np.repeat(first * WIDTH - t.off[:-1], size)] = t.data
    return rows.reshape(-1, WIDTH), n


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as JPEG bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, limit=1 << 20):
                t = Texts(batch.column("text"))
                media = encode_payloads(*payload_rows(t)) if t.n else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(t.off), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and payload digests of stored media (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for whole in batches:
            for batch in steps(whole, "media", 1 << 21):
                stored = batch.column("media").to_pylist()
                rows = []
                for value, frames in zip(stored, thumbnails(stored)):
                    payload = b"".join(thumb.tobytes() for _, _, thumb in frames)
                    feature = ";".join(f"{w}x{h}:{thumbnail_hash(thumb)}" for w, h, thumb in frames)
                    rows.append((len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(value), sha(value).hexdigest(), feature))
                cells = list(zip(*rows))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cells, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_baseline_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as baseline JPEG and read back."""
    return read(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
