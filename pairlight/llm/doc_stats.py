"""Statistics of whole texts as numbers, computed by the step in numpy."""

from __future__ import annotations

import numpy as np

from pairlight.llm.text_arrays import Texts, keyed, repeats, windows

#: Byte classes counted by share of the text's bytes.
_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyz", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "vowels": b"aeiouAEIOU",
    "spaces": b" ", "newlines": b"\n", "tabs": b"\t\r\x0b\x0c", "stops": b".!?", "commas": b",;:", "quotes": b"\"'`", "brackets": b"()[]{}",
    "angles": b"<>", "bars": b"|", "hashes": b"#", "stars": b"*", "dollars": b"$", "percents": b"%", "ampersands": b"&", "ats": b"@",
    "slashes": b"/\\", "equals": b"=", "dashes": b"-_", "pluses": b"+~^", "others": bytes(range(0x80, 0x100)),
}
NAMES = [
    "log_words", "log_bytes", "word_bytes", "word_bytes_spread", "log_longest_word", "lines_per_word", "dup_lines", "repeat_pairs", "repeat_triples", "repeat_fives",
    "distinct_words", "short_words", "long_words", "top_word", "byte_entropy", "capital_words", "stop_ends", "symbol_ends", "digit_words", "symbol_only_words", *_CLASSES,
]
_FLAGS = np.zeros((len(_CLASSES), 256), bool)
for _k, _set in enumerate(_CLASSES.values()):
    _FLAGS[_k, list(_set)] = True
_CAPITAL, _DIGIT, _STOP = (_FLAGS[list(_CLASSES).index(c)] for c in ("capitals", "digits", "stops"))
_ALNUM = _FLAGS[0] | _FLAGS[1] | _FLAGS[2] | _FLAGS[-1]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@=+~^")] = True


def statistics(t: Texts) -> np.ndarray:
    """One row a text, one column for each of ``NAMES``; an empty text has zeros."""
    n, size = t.n, np.diff(t.off)
    words = t.words_per_doc().astype(np.float64)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    length = t.end - t.start
    hashes = t.word_hash()
    out = np.zeros((n, len(NAMES)))

    def put(name: str, value: np.ndarray) -> None:
        out[:, NAMES.index(name)] = value

    def share(flags: np.ndarray) -> np.ndarray:
        return t.words_per_doc(flags) / per_word

    put("log_words", np.log1p(words))
    put("log_bytes", np.log1p(size))
    mean = np.bincount(t.doc, weights=length, minlength=n) / per_word
    put("word_bytes", mean)
    put("word_bytes_spread", np.sqrt(np.maximum(0, np.bincount(t.doc, weights=length.astype(float) ** 2, minlength=n) / per_word - mean**2)))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, t.doc, length)
    put("log_longest_word", np.log1p(longest))
    start, end, doc = t.lines()
    filled = np.searchsorted(t.start, end, "left") > np.searchsorted(t.start, start, "left")
    start, end, doc = start[filled], end[filled], doc[filled]
    lines = np.bincount(doc, minlength=n)
    put("lines_per_word", lines / per_word)
    put("dup_lines", np.bincount(doc[repeats(keyed(doc, t.span_hash(start, end)), later_only=True)], minlength=n) / np.maximum(lines, 1))
    for width, name in ((2, "repeat_pairs"), (3, "repeat_triples"), (5, "repeat_fives")):
        first, h = windows(t.doc, hashes, width)
        put(name, np.bincount(t.doc[first[repeats(keyed(t.doc[first], h))]], minlength=n) / per_word)
    own = keyed(t.doc, hashes)
    _, at, seen = np.unique(own, return_index=True, return_counts=True)
    put("distinct_words", np.bincount(t.doc[at], minlength=n) / per_word)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t.doc[at], seen)
    put("top_word", most / per_word)
    put("short_words", share(length <= 3))
    put("long_words", share(length >= 12))
    if len(length):
        put("capital_words", share(_CAPITAL[t.data[t.start]]))
        put("stop_ends", share(_STOP[t.data[t.end - 1]]))
        put("symbol_ends", share(_SYMBOL[t.data[t.end - 1]]))
        inside = lambda flags: (lambda c: c[t.end] > c[t.start])(np.concatenate([[0], np.cumsum(flags[t.data])]))
        put("digit_words", share(inside(_DIGIT)))
        put("symbol_only_words", share(~inside(_ALNUM)))
    owner = np.repeat(np.arange(n), size)
    cells = np.bincount(owner * 256 + t.data, minlength=n * 256).reshape(n, 256)
    for k, name in enumerate(_CLASSES):
        put(name, cells[:, _FLAGS[k]].sum(1) / per_byte)
    p = cells / per_byte[:, None]
    put("byte_entropy", -(p * np.log2(np.where(p > 0, p, 1))).sum(1))
    return out
