"""Personal data by patterns and by a skip-chain conditional random field.

Patterns give the base spans. The field then labels every word that holds a digit
or ``@`` (no other word can begin or end an entity of these kinds) as one of the
kinds or as nothing. Its potentials are a word's shape, the labels of words next
to each other, and, over any distance, the labels of equal words and of words that
end in the same seven digits. Loopy belief propagation passes messages over all
documents of a step at once until mentions of one thing agree; runs of words with
a confident label that touch no base span are added.

The field is trained piecewise: the base spans of all documents label their
words, but for words outside them whose likes are inside: what those are is not
known, and they teach nothing. Spark counts shapes and label pairs, and the driver
fits a softmax on shape counts and takes pair potentials from the counts. A shape is a combination of the
features, of which some thousands occur however large the corpus is.

Every occurrence of a key is linked to one of them, the first that a base span
covers or else the first, so a word that occurs n times costs n - 1 links and no
mention is more than two links from another. Messages are passed until none of a
document changes by TOLERANCE. Defined cases: a null text is an empty text without spans;
texts are searched whole; repeated rows give equal results; without training
words the field adds nothing; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.text_arrays import Texts, steps

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: OBSERVED is what a base span adds to its words' potentials, which links then carry to their likes.
#: AGREE is how many agreeing links a label starts with: likes are labelled alike unless the corpus says otherwise.
DAMPING, COUPLING, SURE, OBSERVED, AGREE = 0.5, 0.7, 0.9, 8.0, 25.0
#: Largest change of a message that counts as none; a document that still swings after STEADY rounds gets steps that shrink by SHRINK a round.
TOLERANCE, STEADY, SHRINK = 1e-4, 1000, 0.98
#: Nodes whose messages are passed together, if no document has more.
NODES = 1 << 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted domain: found from each ``@``, so long runs cost one pass."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            found.append((start, m.end()))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


FEATURES = (
    "bias", "at", "at_dot", "plus", "paren", "dash", "dashes", "dot", "dots", "dots3", "equals", "quote", "lower", "upper", "other", "hexish", "digits_only",
    "d0", "d1", "d3", "d5", "d9", "d13", "d20", "short", "long", "ends_stop", "octets",
)
_AT = {name: 1 << k for k, name in enumerate(FEATURES)}


@lru_cache(maxsize=50_000)
def shape(word: str) -> int:
    """The word's features as bits."""
    core = word.strip(_EDGE)
    digits = sum("0" <= c <= "9" for c in core)
    dots, dashes = core.count("."), core.count("-")
    head, at, tail = core.partition("@")
    on = {
        "bias": True, "at": at, "at_dot": at and head and "." in tail, "plus": word.startswith("+"), "paren": "(" in word or ")" in word,
        "dash": dashes == 1, "dashes": dashes > 1, "dot": dots == 1, "dots": dots > 1, "dots3": dots == 3, "equals": "=" in core or ":" in core,
        "quote": '"' in word or "'" in word, "lower": re.search("[a-z]", core), "upper": re.search("[A-Z]", core), "other": re.search(r"[^A-Za-z0-9@.+()-]", core),
        "hexish": re.search("[a-f]", core) and digits > 2, "digits_only": core and digits == len(core),
        "d0": digits == 0, "d1": 1 <= digits <= 2, "d3": 3 <= digits <= 4, "d5": 5 <= digits <= 8, "d9": 9 <= digits <= 12, "d13": 13 <= digits <= 19, "d20": digits >= 20,
        "short": len(core) <= 4, "long": len(core) > 19, "ends_stop": word[-1:] in ".,", "octets": dots == 3 and all(len(p) <= 3 and p.isdigit() for p in core.split(".")),
    }
    return sum(_AT[k] for k, v in on.items() if v)


@lru_cache(maxsize=50_000)
def likeness(word: str) -> tuple[str, ...]:
    """Keys that words share if they may mean the same thing."""
    core = word.strip(_EDGE).lower()
    digits = _NOT_DIGIT.sub("", core)
    return ("w" + core, "d" + digits[-7:]) if len(digits) >= 7 else ("w" + core,) if len(core) >= 4 else ()


@dataclass
class Graph:
    """Words of several documents, their links, and the base spans of the documents that have any."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    label: np.ndarray  # by the base spans
    near: np.ndarray  # (links, 2): neighbours
    skip: np.ndarray  # (links, 2): equal or similar words
    base: dict[int, list[tuple[str, int, int]]]


def graph(t: Texts, column: pa.Array) -> Graph:
    """The graph of a step's texts; positions are code points of their text. Distinct words are looked at once."""
    marks = np.concatenate([[0], np.cumsum((t.data >= 0x30) & (t.data <= 0x39) | (t.data == 0x40), dtype=np.int32)])
    active = np.flatnonzero(marks[t.end] > marks[t.start]) if len(t.start) else np.zeros(0, np.int64)
    low, high = t.start[active], t.end[active]
    doc = t.doc[active] if len(active) else np.zeros(0, np.int64)
    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int32)])
    first = points[t.off[doc]]
    start, end = points[low] - first, points[high] - first
    number = t.numbers(low, high, t.span_hash(low, high))
    _, at, number = np.unique(number, return_index=True, return_inverse=True)
    words = [t.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(low[at].tolist(), high[at].tolist())]
    kinds = np.fromiter(map(shape, words), np.int64, len(words))[number]
    label, base = np.zeros(len(active), np.int8), {}
    heads = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for a, b in zip(heads, [*heads[1:], len(doc)]):
        d = int(doc[a])
        spans = base_spans(column[d].as_py())
        if spans:
            base[d] = spans
            s, e = start[a:b], end[a:b]
            for kind, x, y in spans:
                label[a + np.searchsorted(e, x, "right") : a + np.searchsorted(s, y, "left")] = LABELS.index(kind)
    near = np.flatnonzero((active[1:] == active[:-1] + 1) & (doc[1:] == doc[:-1])) if len(active) else np.zeros(0, np.int64)
    return Graph(doc, start, end, kinds, label, np.stack([near, near + 1], axis=1), alike(doc, number, words, label), base)


def alike(doc: np.ndarray, number: np.ndarray, words: list[str], label: np.ndarray) -> np.ndarray:
    """Links of words of one document that share a key, each to the key's first labelled word or else its first; ``number`` says which of ``words`` each is."""
    known: dict[str, int] = {}
    keys = np.full((len(words) + 1, 2), -1, np.int64)
    for k, word in enumerate(words):
        for c, key in enumerate(likeness(word)):
            keys[k, c] = known.setdefault(key, len(known))
    own = keys[number]
    node, which = np.nonzero(own >= 0)
    key = own[node, which]
    order = np.lexsort((node, key, doc[node]))
    node, key = node[order], key[order]
    if not len(node):
        return np.zeros((0, 2), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[node[1:]] != doc[node[:-1]])]))
    size = np.diff([*begin.tolist(), len(node)])
    labelled = np.minimum.reduceat(np.where(label[node] > 0, node, len(label)), begin)
    hub = np.repeat(np.where(labelled < len(label), labelled, node[begin]), size)
    other = node != hub
    return np.unique(np.stack([np.minimum(hub, node)[other], np.maximum(hub, node)[other]], axis=1), axis=0)


@dataclass
class Field:
    """Potentials: shapes (features x labels), neighbours and likeness (labels x labels)."""

    shape: np.ndarray
    near: np.ndarray
    skip: np.ndarray

    def unary(self, shapes: np.ndarray) -> np.ndarray:
        on = (shapes[:, None] >> np.arange(len(FEATURES))) & 1
        return (on[:, :, None] * self.shape).sum(1)

    def posteriors(self, g: Graph) -> np.ndarray:
        """Label probabilities by loopy belief propagation, each document until its messages stand still; documents are taken in blocks of NODES."""
        out = np.empty((len(g.doc), len(LABELS)), np.float32)
        heads = np.flatnonzero(np.diff(g.doc, prepend=-1)).tolist()
        low = 0
        for head, end in zip(heads, [*heads[1:], len(g.doc)]):
            if end - low > NODES and head > low:
                out[low:head] = self._block(g, low, head)
                low = head
        if len(g.doc):
            out[low:] = self._block(g, low, len(g.doc))
        return out

    def _block(self, g: Graph, low: int, high: int) -> np.ndarray:
        """Probabilities of the nodes from low to high, which are whole documents. Arrays have a row a label."""
        shapes, number = np.unique(g.shape[low:high], return_inverse=True)
        unary = self.unary(shapes).T.astype(np.float32)[:, number]
        label, doc = g.label[low:high], (g.doc[low:high] - g.doc[low]).astype(np.int32)
        unary[label, np.arange(high - low)] += np.where(label > 0, OBSERVED, 0).astype(np.float32)
        belief = unary.copy()
        sides = []
        for links, power in ((g.near, self.near), (g.skip, self.skip)):
            a, b = np.searchsorted(links[:, 0], [low, high])
            part = (links[a:b] - low).astype(np.int32)
            sides.append([part[:, 0], part[:, 1], np.exp(power).astype(np.float32), np.zeros((len(LABELS), b - a), np.float32), np.zeros((len(LABELS), b - a), np.float32)])
        looped = np.zeros(int(doc[-1]) + 1, bool)
        looped[doc[sides[1][0]]] = True  # without such links a document is chains, which need no damping
        rate = np.where(looped, np.float32(1 - DAMPING), np.float32(1))
        going, shrink, rounds = np.ones(len(looped), bool), np.float32(1), 0
        live = np.ones(len(label), bool)
        while any(len(side[0]) for side in sides):
            change = np.zeros(len(looped), np.float32)
            for a, b, power, forth, back in sides:
                for at in range(0, len(a), NODES):  # a slice of links needs only its own messages and the beliefs
                    x, y, there, here = a[at : at + NODES], b[at : at + NODES], back[:, at : at + NODES], forth[:, at : at + NODES]
                    step = rate[doc[x]] * shrink
                    more = [step * (_passed(belief[:, x] - there, power) - here), step * (_passed(belief[:, y] - here, power.T) - there)]
                    here += more[0]
                    there += more[1]
                    np.maximum.at(change, doc[x], np.maximum(np.abs(more[0]).max(0, initial=0), np.abs(more[1]).max(0, initial=0)))
            for k in range(len(LABELS)):
                sums = sum(np.bincount(x, weights=m[k], minlength=len(label)) for a, b, _, forth, back in sides for x, m in ((b, forth), (a, back)))
                belief[k] = np.where(live, unary[k] + sums, belief[k])
            rounds += 1
            shrink *= np.float32(SHRINK if rounds > STEADY else 1)
            still = change >= TOLERANCE
            if not (still | ~going).all():  # documents that stand still leave
                going &= still
                live = going[doc]
                for side in sides:
                    left = live[side[0]]
                    side[0], side[1], side[3], side[4] = side[0][left], side[1][left], side[3][:, left], side[4][:, left]
        p = np.exp(belief - belief.max(0))
        return (p / p.sum(0)).T


def _passed(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Messages of beliefs ``x`` (labels x links) through exponentiated potentials, the largest entry 0. Term by term, so a link's message does not depend on its block."""
    e = np.exp(x - x.max(0, initial=-np.inf))
    out = e[0] * power[0][:, None]
    for k in range(1, len(power)):
        out += e[k] * power[k][:, None]
    out = np.log(out)
    return out - out.max(0, initial=-np.inf)


def fit(shapes: np.ndarray, labels: np.ndarray, counts: np.ndarray, pairs: dict[str, np.ndarray], steps: int = 400) -> Field:
    """Softmax weights by gradient steps on shape counts; pair potentials from smoothed pointwise mutual information."""
    on = ((shapes[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
    want = np.zeros((len(shapes), len(LABELS)))
    want[np.arange(len(shapes)), labels] = 1
    weight = np.sqrt(counts)[:, None] / max(1.0, np.sqrt(counts).sum())  # common shapes count less than in proportion
    w, moment, scale = np.zeros((3, len(FEATURES), len(LABELS)))
    for step in range(1, steps + 1):
        z = on @ w
        p = np.exp(z - z.max(1, keepdims=True))
        grad = on.T @ (weight * (p / p.sum(1, keepdims=True) - want)) + 1e-4 * w
        moment, scale = 0.9 * moment + 0.1 * grad, 0.99 * scale + 0.01 * grad**2
        w -= 0.2 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)

    def mutual(n: np.ndarray) -> np.ndarray:
        p = (n + 0.5) / (n + 0.5).sum()
        return COUPLING * np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -4, 4)

    return Field(w, mutual(pairs["near"]), mutual(pairs["skip"] + pairs["skip"].T + AGREE * np.eye(len(LABELS))))


def observed(g: Graph) -> np.ndarray:
    """Which words have a known label: a base span's, or none where no like of the word is in a base span."""
    known = np.ones(len(g.label), bool)
    for a, b in (g.skip.T, g.skip[:, ::-1].T):
        known[b[(g.label[a] > 0) & (g.label[b] == 0)]] = False
    return known


def train(docs: DataFrame) -> Field | None:
    """The field from the base spans of all documents; None if they have no word to label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                column = batch.column("text")
                g = graph(Texts(column), column)
                known = observed(g)
                linked = lambda links: tuple(g.label[links[known[links].all(1)]].T)  # noqa: E731, B023
                for kind, (x, y) in (("word", (g.shape[known], g.label[known])), ("near", linked(g.near)), ("skip", linked(g.skip))):
                    cells, n = np.unique(x.astype(np.int64) * len(LABELS) + y, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array(cells // len(LABELS)), pa.array(cells % len(LABELS)), pa.array(n, pa.int64())], ["kind", "x", "y", "n"])

    counted = docs.select("text").mapInArrow(count, "kind string, x long, y long, n long").groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
    got = counted.orderBy("kind", "x", "y").toPandas()  # a row a shape and label, and a row a pair of labels
    words = got[got.kind == "word"]
    if words.empty:
        return None
    pairs = {}
    for kind in ("near", "skip"):
        pairs[kind] = np.zeros((len(LABELS), len(LABELS)))
        part = got[got.kind == kind]
        pairs[kind][part.x.to_numpy(int), part.y.to_numpy(int)] = part.n
    return fit(words.x.to_numpy(np.int64), words.y.to_numpy(int), words.n.to_numpy(float), pairs)


def added_spans(g: Graph, p: np.ndarray, column: pa.Array) -> dict[int, list[tuple[str, int, int]]]:
    """Runs of neighbouring words with one confident label that touch no base span."""
    best = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    chosen = np.flatnonzero(best)
    joined = np.zeros(len(best) + 1, bool)  # to the word before
    joined[g.near[:, 1]] = True
    begins = ~joined[chosen] | (best[chosen - 1] != best[chosen]) if len(chosen) else np.zeros(0, bool)
    heads = chosen[begins]
    tails = chosen[np.flatnonzero(np.concatenate([begins[1:], [True]]))] if len(chosen) else heads
    out: dict[int, list[tuple[str, int, int]]] = {}
    texts: dict[int, str] = {}
    taken = {d: sorted((x, y) for _, x, y in spans) for d, spans in g.base.items()}
    for k, to in zip(heads.tolist(), tails.tolist()):
        d, a, b = int(g.doc[k]), int(g.start[k]), int(g.end[to])
        if d not in texts:
            texts = {d: column[d].as_py()}
        text = texts[d][a:b]
        a, b = a + len(text) - len(text.lstrip(_EDGE)), b - (len(text) - len(text.rstrip(_EDGE)))
        if a < b and not _touches(taken.get(d, []), a, b):
            out.setdefault(d, []).append((LABELS[best[k]], a, b))
    return out


def _touches(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether any of sorted spans, of which at most one a kind covers a place, overlaps a to b."""
    at = bisect.bisect_left(spans, (b, 0))
    return any(y > a for _, y in spans[max(0, at - 2 * len(KINDS)) : at])


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added: spans (kind, start, end) of every whole text."""
    field = field if field is not None else train(docs)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for whole in batches:
            for batch in steps(whole):
                column = batch.column("text")
                g = graph(Texts(column), column)
                more = added_spans(g, field.posteriors(g), column) if field is not None and len(g.doc) else {}
                both = [pa.array([rows(by.get(d, ())) for d in range(batch.num_rows)], span) for by in (g.base, more)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *both], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def op5_skip_chain_crf(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, listed = [], [], []
            for base, added in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist()):
                key = lambda s: (KINDS.index(s["kind"]), s["start"])
                say = lambda spans: ",".join([f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=key)])
                counts.append([sum(s["kind"] == k for s in base) for k in KINDS])
                hashes.append(hashlib.sha256(say(base).encode()).hexdigest())
                listed.append(say(base + added))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in numbers.T), pa.array(hashes, pa.string()), pa.array(listed, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
