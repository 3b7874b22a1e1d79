"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The
turns' prefixes are rendered one after another; what each output adds to the one
before is the span of its turn, and a template whose output does not begin with
the one before rewrites history and is reported. A turn's text inside its span is
found without knowing the template: the turn is rendered again with two different
texts, and what these renderings share at both ends of the span is marking.

The template given here marks turns with control strings and escapes control
strings inside texts reversibly. Rows are dealt by conversation and sorted inside
their partition, so a worker streams them and holds one conversation at a time,
which is the unit that a template renders.

Defined cases: a null text or role is empty; a null conv_id is a conversation of
its own; turns sort by turn (nulls first), then role and text, so ties and
repeated rows have one order; an empty table gives an empty result; texts are
rendered whole; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPENS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\([\\:])")
#: Escaped texts that a worker remembers, and the longest of them: some 20 million characters at most.
REMEMBERED, REMEMBERED_CHARS = 4096, 2048
#: Conversations, and characters of output, of one Arrow batch.
BATCH_ROWS, BATCH_CHARS = 256, 4 << 20
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)


def _escape(text: str) -> str:
    return _OPENS.sub(lambda m: m.group() + "\\:", text.replace("\\", "\\\\"))


_remembered = lru_cache(maxsize=REMEMBERED)(_escape)


def escape(text: str) -> str:
    """Double backslashes, and break control strings after their first character with ``\\:``."""
    return _remembered(text) if len(text) <= REMEMBERED_CHARS else _escape(text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m.group(1) == "\\" else "", text)


def marked(turns: list[Turn]) -> str:
    """The package's own template."""
    return "<s>" + "".join([f"<|{escape(role)}|>\n{escape(text)}</s>\n" for role, text in turns])


def read_back(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked``."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@dataclass
class Rendering:
    """An output with, for each turn, its span and the span of its text, in code points."""

    formatted: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewritten_at: int | None  # the first turn whose rendering changed earlier output


def shared_start(a: str, b: str) -> int:
    """How many characters two strings share at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # the answer is at least low and below or at high
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render_incrementally(template: Template, turns: list[Turn]) -> Rendering:
    """Render successive prefixes and locate every turn.

    If a step rewrites history, the span of its turn begins where the two outputs
    part, and ``rewritten_at`` names the first such turn; earlier spans then refer
    to the output as it was.
    """
    before, spans, texts, rewritten = template([]), [], [], None
    for k, (role, text) in enumerate(turns):
        after = template(turns[: k + 1])
        start = len(before) if after.startswith(before) else shared_start(before, after)
        if start < len(before) and rewritten is None:
            rewritten = k
        one, two = (template([*turns[:k], (role, probe)]) for probe in ("A", "B"))
        left = max(start, shared_start(one, two))
        right = shared_start(one[left:][::-1], two[left:][::-1])
        spans.append((start, len(after)))
        texts.append((min(left, len(after)), max(left, len(after) - right)))
        before = after
    return Rendering(before, spans, texts, rewritten)


def loss_text(r: Rendering, turns: list[Turn], role: str = "assistant") -> list[str]:
    """What of the output lies under the loss mask, one string a turn of ``role``."""
    return [r.formatted[a:b] for (a, b), (who, _) in zip(r.texts, turns) if who == role]


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of a stream sorted by conv_id."""
    held: tuple[int | None, list[Turn]] | None = None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if held is None or held[0] != conv:
                if held is not None:
                    yield held
                held = conv, []
            held[1].append((role or "", text or ""))
    if held is not None:
        yield held


def _by_conversation(chats: DataFrame) -> DataFrame:
    return chats.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(chats: DataFrame, template: Template = marked) -> DataFrame:
    """conv_id, formatted, spans, text_spans, roles and rewrites of each conversation."""

    pair = pa.list_(pa.list_(pa.int64()))
    kinds = {"conv_id": pa.int64(), "formatted": pa.string(), "spans": pair, "text_spans": pair, "roles": pa.list_(pa.string()), "rewrites": pa.bool_()}
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    def run(batches):
        rows, chars = [], 0
        for conv, turns in conversations(batches):
            r = render_incrementally(template, turns)
            rows.append((conv, r.formatted, r.spans, r.texts, [role for role, _ in turns], r.rewritten_at is not None))
            chars += len(r.formatted)
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield batch(rows)
                rows, chars = [], 0
        if rows:
            yield batch(rows)

    return _by_conversation(chats).mapInArrow(run, "conv_id long, formatted string, spans array<array<long>>, text_spans array<array<long>>, roles array<string>, rewrites boolean")


def digest_chats(chats: DataFrame) -> DataFrame:
    """Digests read back from ``format_chats`` with the package's own template."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for conv, out, spans, rewrites in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "text_spans", "rewrites"))):
                turns = read_back(out)
                if len(turns) != len(spans) or rewrites:
                    raise ValueError(f"conversation {conv} cannot be read back")
                masked = "".join([unescape(out[a:b]) for (a, b), (role, _) in zip(spans, turns) if role == "assistant"])
                rows.append((conv, len(turns), sha("".join([f"{role}\n{text}\n" for role, text in turns])), len(masked), sha(masked), len(out), rewrites))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return format_chats(chats).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def op4_incremental_rendering(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, whose two turns say a control sequence."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return digest_chats(chats.unionByName(extra))
