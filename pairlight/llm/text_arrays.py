"""Words, lines and their hashes over Arrow string columns, in numpy.

Texts are read straight from Arrow buffers as UTF-8 bytes. A word is a run of
bytes other than space and 0x09-0x0D; UTF-8 never uses those inside a character.
A byte range is hashed eight bytes at a time through two chained states, the one
mixed non-linearly after every lane, so no pattern of letters makes different
words equal by construction; ranges beyond ``LANES`` lanes take BLAKE2b. Where a
count has to be exact, equal hashes are followed by a comparison of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one array step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 21
#: Lanes of eight bytes that are hashed and compared by array operations; longer ranges one by one.
LANES = 8

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """The bytes, words and hashes of an Arrow string column; nulls are empty texts."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.off = offsets - offsets[0]
        self._hashes: dict[int, np.ndarray] = {}
        self._lanes: np.ndarray | None = None
        self._words()

    def _words(self) -> None:
        inside = ~SEPARATOR[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.off] = True
        if not len(self.data):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            return
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = self.doc_of(self.start)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words_per_doc(self, chosen: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if chosen is None else self.doc[chosen], minlength=self.n)

    def lane(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as a number, of which ``left`` bytes count."""
        if self._lanes is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        return self._lanes[at] & _MASKS[np.minimum(left, 8)]

    def span_hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of byte ranges, the same wherever a range lies."""
        size = end - start
        one = mix(size.astype(np.uint64) * _ODD + np.uint64(seed))
        two = one ^ _SECOND
        active = np.arange(len(size))
        for k in range(LANES):
            active = active[size[active] > 8 * k]
            if not len(active):
                break
            lane = self.lane(start[active] + 8 * k, size[active] - 8 * k)
            one[active] = mix(one[active] ^ lane)
            two[active] = (two[active] + lane) * _SECOND
        out = mix(one + (two ^ (two >> np.uint64(29))))
        for i in np.flatnonzero(size > 8 * LANES).tolist():
            digest = hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def word_hash(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hashes:
            self._hashes[seed] = self.span_hash(self.start, self.end, seed)
        return self._hashes[seed]

    def same_bytes(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes from a are those from b."""
        same = np.ones(len(size), bool)
        active = np.flatnonzero(a != b)
        for k in range(LANES):
            active = active[size[active] > 8 * k]
            if not len(active):
                break
            left = size[active] - 8 * k
            same[active] &= self.lane(a[active] + 8 * k, left) == self.lane(b[active] + 8 * k, left)
        for i in np.flatnonzero(same & (size > 8 * LANES) & (a != b)).tolist():
            same[i] = np.array_equal(self.data[a[i] : a[i] + size[i]], self.data[b[i] : b[i] + size[i]])
        return same

    def numbers(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A number for each byte range, equal if and only if the bytes are: ``hashes`` only sort, bytes decide."""
        if not len(start):
            return np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        size = end - start
        here, before = order[1:], order[:-1]
        alike = hashes[here] == hashes[before]
        h, b = here[alike], before[alike]
        out = np.empty(len(order), np.int64)
        if ((size[h] == size[b]) & self.same_bytes(start[h], start[b], np.minimum(size[h], size[b]))).all():
            out[order] = np.concatenate([[0], np.cumsum(~alike)])
            return out
        known: dict[bytes, int] = {}  # different bytes met under one hash
        for i, (x, y) in enumerate(zip(start.tolist(), end.tolist())):
            out[i] = known.setdefault(self.data[x:y].tobytes(), len(known))
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines, which ``\\n`` splits."""
        cut = np.flatnonzero(self.data == 0x0A)
        start = np.concatenate([self.off[:-1], cut + 1])
        end = np.concatenate([self.off[1:], cut])
        doc = np.concatenate([np.arange(self.n), self.doc_of(cut)])
        order = np.lexsort((start, doc))
        start = start[order]
        end = np.sort(end) if not self.n else end[np.lexsort((end, doc))]
        return start, end, doc[order]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring runs from the hashes of both; not symmetric and not linear."""
    return mix(a * _SECOND + (b ^ (b >> np.uint64(32)) ^ _ODD))


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive entries, over document borders too, by doubling."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n, have, out = len(hashes), 0, None  # out: runs of the first ``have`` entries
    size, power = 1, hashes
    while size <= width:
        if width & size:
            runs = n - have - size + 1
            out = power if out is None else _join(out[:runs], power[have : have + runs])
            have += size
        power = _join(power[: n - 2 * size + 1], power[size:]) if 2 * size <= width else power
        size *= 2
    return mix(out + np.uint64(width))


def windows(doc: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows that lie inside one document."""
    if len(doc) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    return first, window_hash(hashes, width)[first]


def repeats(keys: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Which keys occur twice or more; or, in order, which have occurred before."""
    flags = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return flags
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags[order[1:][same]] = True
    if not later_only:
        flags[order[:-1][same]] = True
    return flags


def repeated_rows(*columns: np.ndarray, later_only: bool = False) -> np.ndarray:
    """``repeats`` of rows of several columns, decided by the columns themselves and not by a hash of them."""
    n = len(columns[0])
    flags = np.zeros(n, bool)
    if n < 2:
        return flags
    key = np.zeros(n, np.uint64)
    for c in columns:
        key = mix(key * _SECOND + c.astype(np.uint64))
    equal = lambda order: np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    order = np.argsort(key, kind="stable")
    same = equal(order)
    if (same != (key[order[1:]] == key[order[:-1]])).any():
        order = np.lexsort(columns[::-1])
        same = equal(order)
    flags[order[1:][same]] = True
    if not later_only:
        flags[order[:-1][same]] = True
    return flags


def keyed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell documents apart."""
    return mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * _ODD)
