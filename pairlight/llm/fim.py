"""Fill-in-middle: texts cut at line boundaries into prefix, middle and suffix, by arithmetic on big integers.

A text is one integer a byte class, bit i for byte i, made by ``bytes.translate``
and read in base 2:

1. ``newline`` marks "\\n". Lines start at byte 0 and after every newline, so
   ``(newline << 1 | 1)`` cut to the text's length marks them, and ``bit_count`` of it
   is the number of lines n.
2. The byte where line k starts is the set bit of rank k. It is found by recursive
   halving: the bits of the lower half are counted, and the search goes on in the half
   that has the bit, so a text costs a geometric series of its length.
3. Code points are counted as set bits of the class of UTF-8 bytes that begin one. A
   control mark is present where the class of its first byte, that of its second
   shifted down by one and that of its third shifted by two have a common bit.

Every row is cut on its own, where it lies: there is no shuffle, and a task holds one
text with a few integers of an eighth of its size.

Defined cases: a null or empty text is plain and empty; a text that contains a mark is
plain, so that restoring is unambiguous; a null doc_id draws as an empty id; repeated
rows are cut alike; an empty table gives an empty result; other columns stay as they
are, unless they have the name of a result, which then replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.llm.text_arrays import steps

SEED, SPM_PERCENT, FIM_PERCENT = 7, 50, 100
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def byte_class(members: bytes) -> bytes:
    """A table for ``bytes.translate`` that gives "1" for the members and "0" for the rest."""
    return bytes(0x31 if b in members else 0x30 for b in range(256))


_NEWLINE = byte_class(b"\n")
_BEGINS = byte_class(bytes(b for b in range(256) if b & 0xC0 != 0x80))
_MARK = [byte_class(bytes(set(column))) for column in zip(PREFIX, SUFFIX, MIDDLE)]


def mask(text: bytes, table: bytes) -> int:
    """The integer whose bit i says whether byte i is of the class."""
    return int(text.translate(table)[::-1], 2) if text else 0


def select(bits: int, rank: int, width: int) -> int:
    """Place of the set bit that has ``rank`` set bits below it, among the ``width`` lowest."""
    if width <= 1:
        return 0
    half = width // 2
    low = bits & ((1 << half) - 1)
    below = low.bit_count()
    return select(low, rank, half) if rank < below else half + select(bits >> half, rank - below, width - half)


def has_mark(text: bytes) -> bool:
    """Whether one of the three control marks is in the text."""
    if b"<" not in text:
        return False
    first, second, third = (mask(text, table) for table in _MARK)
    return bool(first & (second >> 1) & (third >> 2))


def cut(text: bytes, h: tuple[int, int, int, int], spm_percent: int = SPM_PERCENT, fim_percent: int = FIM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """n lines, form, code points of prefix and middle, and the output of one text under four draws."""
    starts = (mask(text, _NEWLINE) << 1 | 1) & ((1 << len(text)) - 1)
    n = starts.bit_count()
    if not text or h[2] % 100 >= fim_percent or has_mark(text):
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    at, to = (select(starts, k, len(text)) if k < n else len(text) for k in (a, b))
    begins = mask(text, _BEGINS)
    chars = [(begins & ((1 << place) - 1)).bit_count() for place in (at, to)]
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    spm = h[3] % 100 < spm_percent
    output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, "spm" if spm else "psm", chars[0], chars[1] - chars[0], output


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, seed: int = SEED, spm_percent: int = SPM_PERCENT, fim_percent: int = FIM_PERCENT) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any other) with n, form, prefix_chars, middle_chars and output."""
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [f for f in docs.schema.fields if f.name not in made]
    other = [f.name for f in kept if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                texts = batch.column("text").cast(pa.binary())
                rows = [cut(t.as_py() or b"", draws(i, seed), spm_percent, fim_percent) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
                n, form, prefix, middle, output = zip(*rows)
                found = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *found], [*(f.name for f in kept), *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n long, form string, prefix_chars long, middle_chars long, output string"])
    return docs.select("doc_id", "text", *other).select(*[f.name for f in kept]).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form; a mark occurs in an output only where it was put."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE.decode(), 1)
        return one, F.substr(rest, F.length(two) + len(MIDDLE) + 1), two

    suffix_last = F.concat(*parts(SUFFIX.decode()))
    suffix, middle, prefix = parts(PREFIX.decode())
    return F.when(form == "plain", output).when(form == "psm", suffix_last).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` cut, put together and restored."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_WORD = lambda k: f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM t),
c AS (SELECT *, len(lines) AS n, {_WORD(0)} % (len(lines) + 1) AS x, {_WORD(1)} % (len(lines) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_WORD(2)} % 100 >= {FIM_PERCENT} THEN 'plain' WHEN {_WORD(3)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(lines[:least(x, y)], '') AS a, array_to_string(lines[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(lines[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
