"""The base columns of three operators beside SQL that computes them in another way.

The operators return more than SQL can express; these queries are their own results
without the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairlight.llm import fertility, pii_crf, secret_scan

_SEP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def base_quality_counts(spark, sf_dir: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of op1 for every document."""
    return fertility.op1_tokenizer_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, unnest(regexp_extract_all(text, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS pos FROM d),
v AS (SELECT uid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY uid ORDER BY pos)),
r AS (SELECT uid, pos, three IS NOT NULL AND count(*) OVER (PARTITION BY uid, three) > 1 AS again FROM v),
n AS (SELECT uid, count(*) FILTER (again OR one OR two) AS n_repeat_words FROM (SELECT uid, again, coalesce(lag(again) OVER o, false) AS one, coalesce(lag(again, 2) OVER o, false) AS two FROM r WINDOW o AS (PARTITION BY uid ORDER BY pos)) GROUP BY uid),
l AS (SELECT uid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY uid),
b AS (SELECT doc_id, len(regexp_extract_all(text, '{_WORD}'))::BIGINT AS n_words, length(regexp_replace(text, '{_SEP}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN n USING (uid) LEFT JOIN l USING (uid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""


def _found(kinds: dict[str, str], order: str) -> str:
    """Table expressions down to s (uid, kind, k, m, start): the matches of every pattern with their starts, from the pieces between them; ``d`` has uid and text."""
    parts = " UNION ALL ".join(
        f"SELECT uid, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(text, '{rule}')) AS m, unnest(string_split_regex(text, '{rule}')[:len(regexp_extract_all(text, '{rule}'))]) AS before, "
        f"generate_subscripts(regexp_extract_all(text, '{rule}'), 1) AS pos FROM d"
        for k, (kind, rule) in enumerate(kinds.items())
    )
    return f"""
f AS ({parts}),
s AS (SELECT uid, kind, k, m, (sum(length(before)) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS start FROM f WINDOW o AS (PARTITION BY uid, k ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{order}"""


def base_personal_spans(spark, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 of op5 for every document."""
    return pii_crf.op5_skip_chain_crf(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


_PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
{_found(_PERSONAL, '''
c AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM s),
luhn AS (SELECT uid, start, sum(CASE WHEN (size - i) % 2 = 0 THEN x WHEN x < 5 THEN 2 * x ELSE 2 * x - 9 END) % 10 = 0 AS fits
         FROM (SELECT uid, start, length(digits) AS size, unnest(range(1, length(digits) + 1)) AS i, unnest(string_split(digits, ''))::INT AS x FROM c WHERE kind = 'card' AND length(digits) BETWEEN 13 AND 19) GROUP BY 1, 2),
''')}
g AS (SELECT c.uid, kind, k, c.start, m FROM c LEFT JOIN luhn ON kind = 'card' AND luhn.uid = c.uid AND luhn.start = c.start
      WHERE kind = 'email' OR kind = 'ip' AND length(ltrim(split_part(m, '.', 1), '0')) < 4 AND length(ltrim(split_part(m, '.', 2), '0')) < 4 AND length(ltrim(split_part(m, '.', 3), '0')) < 4 AND length(ltrim(split_part(m, '.', 4), '0')) < 4
        AND coalesce(try_cast(split_part(m, '.', 1) AS HUGEINT), 0) <= 255 AND coalesce(try_cast(split_part(m, '.', 2) AS HUGEINT), 0) <= 255 AND coalesce(try_cast(split_part(m, '.', 3) AS HUGEINT), 0) <= 255 AND coalesce(try_cast(split_part(m, '.', 4) AS HUGEINT), 0) <= 255
         OR kind = 'card' AND fits OR kind = 'phone' AND length(digits) BETWEEN 9 AND 15)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start::VARCHAR || ':' || (start + length(m))::VARCHAR, ',' ORDER BY k, start), '')) AS base_sha256
FROM d LEFT JOIN g USING (uid) GROUP BY uid, doc_id"""


def base_secret_spans(spark, sf_dir: str) -> DataFrame:
    """n_assign, n_access, n_hex and base_sha256 of op10 for every document."""
    return secret_scan.op10_secret_randomness(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"(?:{_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
_SECRETS = {"assign": _ASSIGN + r"[A-Za-z0-9+/_.=-]+", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
SECRET_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
{_found(_SECRETS, "")}
g AS (SELECT * FROM s WHERE kind = 'assign' AND length(regexp_extract(m, '{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6 OR kind = 'access' AND length(m) >= 20 OR kind = 'hex' AND length(m) >= 24)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start::VARCHAR || ':' || (start + length(m))::VARCHAR, ',' ORDER BY start, k), '')) AS base_sha256
FROM d LEFT JOIN g USING (uid) GROUP BY uid, doc_id"""
