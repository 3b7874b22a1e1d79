"""Secrets by patterns and by a battery of randomness tests, in DataFrame operations only.

Three patterns give the base spans. Beyond them every long run of token
characters is a candidate, cut at "=" and, where it mixes both base64 alphabets,
into its maximal parts of each: its encoding (alphabet) is inferred from the
characters it has, and three tests ask whether it could be uniformly random in
that encoding: chi-squared uniformity of the alphabet, runs of character classes,
and lag-one serial correlation of alphabet positions. Fisher's method combines
them into one value: near 0 for words and names, uniform for random tokens.

A candidate's p-value is the share of ordinary tokens of its length class (long
tokens give the tests more power than short ones) whose value is as large: a
stated table, from text outside the corpus. Benjamini-Hochberg control over all
candidates of a class decides which are declared secret, so at most ``level`` of
the method's secrets are expected to be ordinary tokens. The p-values are steps
of the table, so only a count for each step and class reaches the driver.

Positions come from splitting a text by the pattern that its matches were
extracted with: a match starts after all earlier gaps and matches. Sums and
maxima over a text's matches are taken in blocks, and characters from one split,
so the work grows with the length of a text and not with its square.

Defined cases: a null text is an empty text without spans; whole texts are
scanned; the same span found twice is one span; method spans that touch a base
span are left out; repeated rows give repeated results; an empty table gives an
empty result; only doc_id and text are read unless other columns are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.scratch import keep

#: The base patterns, fixed by the contract: kind, pattern, group whose length counts, least length.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the method: maximal runs of token characters with their padding, and the least length judged. Another "=" separates.
_PAD = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
RUN, LEAST = r"[A-Za-z0-9+/_-]{20,}" + _PAD, 20
#: A run with characters of both base64 alphabets has no encoding of its own: its maximal parts of either one are judged, those of the second if they have any of its signs.
URL_SIGNS, SIGNS = "[_-]", "[+/]"
PARTS = (r"[A-Za-z0-9_-]{20,}" + _PAD, r"[A-Za-z0-9+/]{20,}" + _PAD)
#: Lower ends of the length classes, and the level of the false-discovery control.
LENGTH_CLASSES, LEVEL = (20, 28, 40, 64, 128), 0.05
#: Points of the battery's p-value, and for each length class the share of ordinary tokens that reach them: 182,000 names, paths and long words of
#: installed software, which are made of common words, and joins of them for the two longest classes; one is added to both counts.
GRID = (1e-8, 1e-6, 1e-5, 1e-4, 3e-4, 1e-3, 3e-3, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ORDINARY = {
    20: (0.84, 0.48, 0.32, 0.21, 0.16, 0.11, 0.079, 0.048, 0.035, 0.019, 0.01, 0.0071, 0.0051, 0.0028, 0.0016, 0.00077, 0.00035, 0.00015, 5.9e-05, 2e-05),
    28: (0.48, 0.15, 0.062, 0.029, 0.021, 0.014, 0.0094, 0.005, 0.0031, 0.0014, 0.00089, 0.00061, 0.00043, 0.00018, 0.0001, 5.9e-05, 3e-05, 1.5e-05, 1.5e-05, 1.5e-05),
    40: (0.12, 0.053, 0.029, 0.013, 0.0085, 0.0041, 0.0019, 0.00068, 0.00032, *[4.6e-05] * 11),
    64: (0.015, 0.0036, 0.0013, 0.00027, 0.00013, 5e-05, *[1.7e-05] * 14),
    128: (2.5e-05,) * 20,
}
#: Arrays are folded in blocks of so many entries; texts with more spans than MANY are cut through their characters.
BLOCK, MANY, LAST = 64, 64, 2**31 - 1
#: Encodings, the narrowest first: name, what a token must match, alphabet in order of position.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def running(values: Column, op, first: int) -> Column:
    """For each entry of an int array what ``op`` makes, from ``first`` on, of all entries before it.

    Folded in blocks, then over the blocks' totals, so no array grows entry by entry over the whole length.
    """
    empty = F.array().cast("array<int>")

    def fold(items: Column, start: Column) -> Column:
        step = lambda held, x: F.struct(op(held["at"], x).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), empty.alias("out")), step, lambda held: held["out"])

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, lambda x: F.aggregate(x, F.lit(first), op)), F.lit(first)), fold)))

    return F.when(F.size(values) > 0, let(values, blocked)).otherwise(empty)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches as structs of start, end (code points), the length of ``group`` and the match itself."""
    hits, chosen, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))

    def placed(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gap"], 1, F.size(x["hit"])), F.transform(x["hit"], lambda h: F.length(h)), lambda g, h: g + h)
        return F.arrays_zip(running(both, lambda a, b: a + b, 0).alias("at"), F.slice(x["gap"], 1, F.size(x["hit"])).alias("gap"), x["hit"].alias("hit"), x["size"].alias("size"))

    def named(m: Column) -> Column:
        return let(m["at"] + m["gap"], lambda start: F.struct(start.alias("start"), (start + F.length(m["hit"])).alias("end"), m["size"].alias("size"), m["hit"].alias("hit")))

    found = F.transform(let(F.struct(hits.alias("hit"), lengths(chosen).alias("size"), lengths(gaps).alias("gap")), placed), named)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,end:int,size:int,hit:string>>"))


def _kept(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    found = F.filter(matches(text, pattern, group), lambda m: m["size"] >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Base spans as structs of start, kind number, end; in order of start and kind."""
    return F.array_sort(F.concat(*[_kept(text, KINDS.index(kind), *rule) for kind, *rule in BASE]))


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution (Abramowitz and Stegun 7.1.26)."""

    def of(x: Column) -> Column:
        poly = lambda t: reduce(lambda held, c: (held + F.lit(c)) * t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(0.0))
        tail = let(1 / (1 + F.lit(0.3275911) * F.abs(x)), poly) * F.exp(-x * x) / 2
        return let(F.greatest(F.lit(1e-14), tail), lambda t: F.when(x >= 0, t).otherwise(1 - t))

    return let(z / F.lit(2**0.5), of)


def _uniformity(core: Column, alphabet: Column, n: Column, a: Column) -> Column:
    """Chi-squared over the alphabet, in Wilson and Hilferty's normal form."""
    count = lambda i: let(n - F.length(F.replace(core, F.substr(alphabet, i, F.lit(1)), F.lit(""))), lambda c: c * c)
    squares = F.aggregate(F.transform(F.sequence(F.lit(1), a.cast("int")), count), F.lit(0.0), lambda s, c: s + c)
    return let(2 / (9 * (a - 1)), lambda v: normal_tail((F.pow((squares * a / n - n) / (a - 1), F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)))


def _runs(chars: Column, alphabet: Column, n: Column, a: Column) -> Column:
    """Neighbours of different character class, against what independent characters give."""
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)
    changes = let(F.transform(chars, kind), lambda k: F.size(F.filter(F.zip_with(F.slice(k, 2, F.size(k)), k, lambda x, y: F.coalesce(x != y, F.lit(False))), lambda d: d)))
    shares = F.array(*[F.length(F.regexp_replace(alphabet, f"[^{c}]", "")) / a for c in ("0-9", "A-Z", "a-z", "+/_-")])
    power = lambda k: F.aggregate(shares, F.lit(0.0), lambda s, q: s + F.pow(q, F.lit(float(k))))

    def score(x: Column) -> Column:
        spread = (n - 1) * (1 - x["two"]) * x["two"] + 2 * (n - 2) * (x["three"] - x["two"] * x["two"])
        return F.abs(x["changes"] - (n - 1) * (1 - x["two"])) / F.sqrt(F.greatest(F.lit(1e-9), spread))

    return F.least(F.lit(1.0), 2 * normal_tail(let(F.struct(changes.alias("changes"), power(2).alias("two"), power(3).alias("three")), score)))


def _serial(chars: Column, alphabet: Column, n: Column, a: Column) -> Column:
    """Lag-one correlation of positions in the alphabet."""
    places = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - (a + 1) / 2)
    products = let(places, lambda q: F.aggregate(F.zip_with(F.slice(q, 2, F.size(q)), q, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
    return F.least(F.lit(1.0), 2 * normal_tail(F.abs(products) / ((a * a - 1) / 12 * F.sqrt(n - 1))))


def p_value(token: Column) -> Column:
    """Combined p-value of the three tests under "uniformly random in its encoding"; null without an encoding."""

    def of(core: Column) -> Column:
        alphabet = reduce(lambda other, e: F.when(core.rlike(e[1]), F.lit(e[2])).otherwise(other), ENCODINGS[::-1], F.lit(None).cast("string"))
        judged = (F.length(core) >= LEAST) & core.rlike("[^0-9]")
        return F.when(judged, let(alphabet, lambda alphabet: tests(core, alphabet)))

    def tests(core: Column, alphabet: Column) -> Column:
        chars = F.split(core, "")
        n, a = F.length(core).cast("double"), F.length(alphabet).cast("double")
        three = let(chars, lambda c: F.array(_uniformity(core, alphabet, n, a), _runs(c, alphabet, n, a), _serial(c, alphabet, n, a)))
        # Fisher's method; chi-squared with six degrees has a closed tail
        half = F.aggregate(three, F.lit(0.0), lambda s, p: s - F.log(F.greatest(F.lit(1e-14), p)))
        return F.when(alphabet.isNotNull(), let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2)))

    return let(F.rtrim(token, F.lit("=")), of)


def _length_class(size: Column) -> Column:
    return reduce(lambda other, low: F.when(size >= low, F.lit(low)).otherwise(other), LENGTH_CLASSES, F.lit(LENGTH_CLASSES[0]))


def _parts(run: Column) -> Column:
    """Maximal parts of a run in one encoding, as structs of start, end, size, hit."""
    move = lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["size"].alias("size"), m["hit"].alias("hit"))
    signed = F.filter(matches(run["hit"], PARTS[1]), lambda m: m["hit"].rlike(SIGNS))
    mixed = run["hit"].rlike(URL_SIGNS) & run["hit"].rlike(SIGNS)
    return F.when(mixed, F.transform(F.concat(matches(run["hit"], PARTS[0]), signed), move)).otherwise(F.array(run))


def candidates(text: Column) -> Column:
    """Judged runs and parts as structs of start, end, cell (how many points of GRID their p-value reaches) and length class."""
    reached = lambda p: reduce(lambda other, k: F.when(p >= F.lit(GRID[k - 1]), F.lit(k)).otherwise(other), range(1, len(GRID) + 1), F.when(p.isNotNull(), F.lit(0)))
    judge = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), let(p_value(m["hit"]), reached).alias("cell"), _length_class(m["size"]).alias("klass"))
    return F.filter(F.transform(F.flatten(F.transform(matches(text, RUN), _parts)), judge), lambda c: c["cell"].isNotNull())


def _free(base: Column, random: Column) -> Column:
    """The random spans that overlap no base span, overlapping ones of them as one; structs of start, kind, end in order."""

    def clear(every: Column) -> Column:
        ends = F.transform(every, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0))
        starts = F.reverse(F.transform(every, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(LAST)))
        before, after = running(ends, larger, 0), F.reverse(running(starts, smaller, LAST))
        known = F.arrays_zip(every.alias("s"), before.alias("before"), after.alias("after"))
        return F.transform(F.filter(known, lambda x: (x["s"]["kind"] == 3) & (x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"])), lambda x: x["s"])

    def joined(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), larger, 0)
        known = F.arrays_zip(spans.alias("s"), reach.alias("reach"))
        heads = F.filter(known, lambda x: x["reach"] <= x["s"]["start"])  # a new span begins where all before it have ended
        tails = F.concat(F.slice(F.transform(heads, lambda x: x["reach"]), 2, F.greatest(F.size(heads), F.lit(1))), F.array(F.array_max(F.transform(spans, lambda s: s["end"]))))
        return F.zip_with(heads, tails, lambda x, end: F.struct(x["s"]["start"].alias("start"), F.lit(3).alias("kind"), end.alias("end")))

    every = F.array_sort(F.concat(base, random))
    return let(let(every, clear), lambda spans: F.when(F.size(spans) > 0, joined(spans)).otherwise(spans))


def least_cells(counts: list[tuple[int, int, int]], level: float = LEVEL, null=ORDINARY) -> dict[int, int]:
    """For each length class the lowest cell that is declared secret, by Benjamini and Hochberg, from (class, cell, candidates)."""
    cuts: dict[int, int] = {}
    for klass in {k for k, _, _ in counts}:
        inside = {cell: n for k, cell, n in counts if k == klass}
        total, above = sum(inside.values()), 0
        for cell in sorted(inside, reverse=True):
            above += inside[cell]
            if cell and null[klass][cell - 1] <= level * above / total:
                cuts[klass] = cell
    return cuts


def found(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of ``docs``, base spans and candidates of every whole text; written, so texts are searched once."""
    text = F.coalesce("text", F.lit(""))
    return keep(docs.select(*[F.col(f"`{c}`") for c in columns], base_spans(text).alias("__base"), candidates(text).alias("__tokens")), "secret-candidates")


def with_secrets(marked: DataFrame, level: float = LEVEL) -> DataFrame:
    """``found`` rows with __secrets: base spans and the method's, in order of start and kind."""
    tokens = marked.select(F.explode("__tokens").alias("c")).groupBy("c.klass", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    cuts = least_cells([tuple(r) for r in tokens.collect()], level)  # a row a length class and cell at most
    limit = lambda c: reduce(lambda other, item: F.when(c["klass"] == item[0], F.lit(item[1])).otherwise(other), cuts.items(), F.lit(len(GRID) + 1))
    random = F.transform(F.filter("__tokens", lambda c: c["cell"] >= limit(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    secrets = let(random, lambda r: F.when(F.size(r) > 0, F.array_sort(F.concat("__base", _free(F.col("__base"), r)))).otherwise(F.col("__base")))
    return marked.withColumn("__secrets", secrets).drop("__base", "__tokens")


def scan(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), level: float = LEVEL) -> DataFrame:
    """``columns`` and ``secrets``: array of (start, kind number, end) of each whole text."""
    return with_secrets(found(docs, columns), level).withColumnRenamed("__secrets", "secrets")


def redact(docs: DataFrame, mark: str = "[SECRET]", level: float = LEVEL) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans are replaced once."""
    text = F.col("text")

    def left(spans: Column) -> Column:
        """The stretches before, between and after spans that overlap no other."""
        reach = running(F.transform(spans, lambda s: s["end"]), larger, 0)
        heads = F.filter(F.arrays_zip(spans.alias("s"), reach.alias("reach")), lambda x: x["reach"] <= x["s"]["start"])
        stretches = F.transform(heads, lambda x: F.struct(x["reach"].alias("start"), x["s"]["start"].alias("end")))
        return F.concat(stretches, F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end"))))

    cut = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])
    by_characters = lambda g: let(F.split(text, ""), lambda chars: F.transform(g, lambda s: F.array_join(F.slice(chars, s["start"] + 1, s["end"] - s["start"]), "")))
    clean = let(left(F.col("__secrets")), lambda g: F.array_join(F.when(F.size(g) > MANY, by_characters(g)).otherwise(F.transform(g, cut)), mark))
    marked = with_secrets(found(docs, tuple(docs.columns)), level)
    return marked.withColumn("text", F.when(F.size("__secrets") > 0, clean).otherwise(text)).drop("__secrets")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def op10_secret_randomness(spark, sf_dir: str) -> DataFrame:
    """Base and random-looking secrets in every whole text of ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"), count(3).alias("n_random"),
    )
