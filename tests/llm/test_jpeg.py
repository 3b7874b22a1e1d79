import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pairlight.llm import jpeg
from pairlight.llm.text_arrays import Texts


def stored(texts):
    return jpeg.encode_payloads(*jpeg.payload_rows(Texts(pa.array(texts, pa.string()))))


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_round_trip():
    r = np.random.default_rng(1)
    texts = [None, "", "x", "a" * 64, "é世🎉" * 500, "\x7f\x00" * 99, bytes(r.integers(1, 127, 40_000, dtype=np.uint8)).decode(), "tall" * 140_000]
    for text, frames in zip(texts, jpeg.thumbnails(stored(texts))):
        assert b"".join(t.tobytes() for _, _, t in frames) == payload(text)
        assert all((w, h) == (512, 8 * len(t)) for w, h, t in frames)
    assert len(jpeg.parse(stored(["tall" * 140_000])[0])) == 2


def colour_picture(levels, restart):
    """A 4:2:0 picture with AC coefficients, written bit by bit."""
    dc, ac = jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS), {0x00: (0b0, 1), 0x21: (0b10, 2), 0xF0: (0b110, 3)}
    height, width = levels.shape[0] * 8, levels.shape[1] * 8
    bits, chunks, level = "", [], [0, 0, 0]

    def block(part, value, busy):
        nonlocal bits
        diff, level[part] = value - level[part], value
        size = abs(diff).bit_length()
        code, n = dc[size]
        bits += format(code, f"0{n}b") + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "")
        for symbol, extra in ((0xF0, ""), (0x21, "1")) if busy else ():
            code, n = ac[symbol]
            bits += format(code, f"0{n}b") + extra
        bits += "0"

    units = [(y, x) for y in range(0, levels.shape[0], 2) for x in range(0, levels.shape[1], 2)]
    for k, (y, x) in enumerate(units):
        for dy in (0, 1):
            for dx in (0, 1):
                block(0, int(levels[y + dy, x + dx]), dx)
        block(1, 3, 0)
        block(2, -7, 1)
        if (k + 1) % restart == 0 or k + 1 == len(units):
            bits += "1" * (-len(bits) % 8)
            raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
            chunks.append(raw + (bytes([0xFF, 0xD0 + k // restart % 8]) if k + 1 < len(units) else b""))
            bits, level = "", [0, 0, 0]
    seg = jpeg._segment
    return b"".join([
        b"\xff\xd8", seg(0xDB, b"\0" + bytes([16] + [1] * 63)), seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        seg(0xC4, b"\x00" + jpeg.DC_COUNTS + jpeg.DC_SYMBOLS), seg(0xC4, b"\x10" + bytes([1, 1, 1] + [0] * 13) + bytes([0x00, 0x21, 0xF0])),
        *([seg(0xDD, restart.to_bytes(2, "big"))] if restart < len(units) else []), seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), *chunks, b"\xff\xd9",
    ])


@pytest.mark.parametrize("restart", [1, 3, 1000])
def test_colour_with_subsampling(restart):
    levels = np.random.default_rng(2).integers(-60, 60, (6, 10))
    [[(w, h, thumb)]] = jpeg.thumbnails([colour_picture(levels, restart)])
    assert (w, h) == (80, 48)
    assert (thumb == np.clip((levels * 16 + 4) // 8 + 128, 0, 255)).all()


def test_broken_pictures_are_errors():
    good = stored(["hello"])[0]
    for bad in (b"", good[:-2], good[10:], good.replace(b"\xff\xc0", b"\xff\xc2"), None):
        with pytest.raises(ValueError):
            jpeg.thumbnails([bad])


def test_columns(odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = jpeg.read(jpeg.store(odd_docs)).collect()
    assert len(rows) == 13
    for r in rows:
        want = payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(want))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    assert jpeg.read(jpeg.store(no_docs)).count() == 0


def read_plainly(data):
    """Pictures of a stored value, decoded bit by bit from the standard's own description: width, height and the level of every block."""
    pictures, at = [], 0
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at, tables, quant, restart = at + 2, {}, {}, 0
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                quant[body[0] & 15] = body[1]
            elif marker == 0xC0:
                height, width, parts = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
                assert parts == 1
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xC4:
                while body:
                    counts, code, k, table = body[1:17], 0, 17, {}
                    for n in range(1, 17):
                        for _ in range(counts[n - 1]):
                            table[n, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    tables[body[0]], body = table, body[k:]
            elif marker == 0xDA:
                break
        chunks, begin = [], at  # between restart marks
        while True:
            if data[at] == 0xFF and data[at + 1] != 0:
                chunks.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
                mark, at = data[at + 1], at + 2
                begin = at
                if mark == 0xD9:
                    break
                assert mark == 0xD0 + (len(chunks) - 1) % 8
            else:
                at += 1
        bits, place, level, blocks = "", 0, 0, []

        def symbol(table):
            nonlocal place
            code = 0
            for n in range(1, 17):
                code = code << 1 | (bits[place] == "1")
                place += 1
                if (n, code) in table:
                    return table[n, code]
            raise AssertionError

        for k in range(width // 8 * (height // 8)):
            if k % (restart or 1 << 62) == 0:
                bits, place, level = "".join(f"{b:08b}" for b in chunks.pop(0)), 0, 0
            size = symbol(tables[0x00])
            extra = int(bits[place : place + size] or "0", 2)
            place += size
            level += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
            blocks.append(min(255, max(0, (level * quant[0] + 4) // 8 + 128)))
            assert symbol(tables[0x10]) == 0  # no other coefficients
        pictures.append((width, height, blocks))
    return pictures


def plain_hash(width, height, blocks):
    """Which cells of an 8 x 8 reduction are lighter than the mean cell."""
    across, down = width // 8, height // 8
    cells = []
    for r in range(8):
        for c in range(8):
            rows, columns = range(r * down // 8, max(r * down // 8 + 1, (r + 1) * down // 8)), range(c * across // 8, max(c * across // 8 + 1, (c + 1) * across // 8))
            values = [blocks[y * across + x] for y in rows for x in columns]
            cells.append(sum(values) / len(values))
    mean = sum(cells) / 64
    return f"{int(''.join('1' if v > mean + 1e-9 else '0' for v in cells), 2):016x}"


def test_query_equals_an_independent_decoder(spark, sf_dir):
    """The whole result: every stored value read by a plain decoder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, media = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: bytes(r.media) for r in jpeg.store(docs).collect()}
    rows = jpeg.op8_baseline_jpeg(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) == set(media)
    for r in rows:
        want, value = payload(texts[r.doc_id]), media[r.doc_id]
        pictures = read_plainly(value)
        assert bytes(b for *_, blocks in pictures for b in blocks) == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(value), hashlib.sha256(value).hexdigest())
        assert r.feature == ";".join(f"{w}x{h}:{plain_hash(w, h, blocks)}" for w, h, blocks in pictures)
