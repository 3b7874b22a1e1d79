import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairlight.llm import fim
from tests.llm.conftest import table

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(i, text, seed=7, spm=50, share=100):
    text = text or ""
    units = LINE.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(n=400):
    r = random.Random(5)
    out = ["", None, "\n", "\n\n\n", "no newline", "<", "a\r\nb\r\n", "x<P", "a<M>b\nc", "<S\n>", "é\n世界\n🎉", "<\n<S", "M>\n>", "\x00\n\x00", "ab" * 300_000 + "\n" + "é\n" * 50_000]
    return [*out, *("".join(r.choice(["\n", "\n", "a", "é", "世", "🎉", "<", "P", "S", "M", ">", " ", " ", "\x85"]) for _ in range(r.randint(0, 60))) for _ in range(n))]


def test_equals_brute_force(spark):
    rows = [*enumerate(texts()), (-7, "a\nb\nc"), (None, "a\nb\nc"), (3, "\n\n\n")]
    for spm, share in ((50, 100), (0, 40)):
        made = fim.fill_in_middle(table(spark, rows), spm_percent=spm, fim_percent=share)
        got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, spm=spm, share=share)
            assert r.back == (r.text or "")
        assert {r.form for r in got} == ({"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_select_by_halving():
    r = random.Random(2)
    for _ in range(200):
        width = r.randint(1, 400)
        bits = r.getrandbits(width) & r.getrandbits(width) | 1 << r.randrange(width)
        places = [k for k in range(width) if bits >> k & 1]
        assert [fim.select(bits, k, width) for k in range(len(places))] == places


@pytest.mark.parametrize("text", ["<P>", "a<S>", "<M>b", "<<M>", "x<Px<S>"])
def test_marks_are_seen(text):
    assert fim.has_mark(text.encode())
    assert not fim.has_mark(text.replace(">", ")").encode())


def test_odd_rows(odd_docs, no_docs):
    made = fim.fill_in_middle(odd_docs)
    assert made.columns[: len(odd_docs.columns) - 1] == [c for c in odd_docs.columns if c != "n"]  # n is a result here
    rows = made.collect()
    assert len(rows) == 13 and all(r.n == brute(r.doc_id, r.text)[0] and r.output == brute(r.doc_id, r.text)[-1] for r in rows)
    assert fim.fill_in_middle(no_docs).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for sf in ("sf0.001", "sf0.01"):
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        got = fim.op11_fill_in_middle(spark, f"/root/testdata/{sf}")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({fim.ORACLE})").fetchall(), key=repr)
