"""Source divergence, exact search and fill-in-middle against plain Python and SQL."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import divergence, exact_search, fill_in_middle

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
on_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@on_data
@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_top_k", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    from scriptorium.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found) == want and want


# Divergence


def audit_of(docs, least):
    """The audit of (text, lang, source) rows, straight from its definition."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found, held, out = {}, {}, []
    for text, lang, source in docs:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        own = found.setdefault(lang, {}).setdefault(source, {})
        for w in words:
            own[w] = own.get(w, 0) + 1
        for w in set(words):
            held[lang, w] = held.get((lang, w), 0) + 1
    for lang, groups in found.items():
        kept = [w for (other, w), n in held.items() if other == lang and n >= least]
        price = lambda c, total, v=len(kept): 1 + 1_000_000_000 * (c + 5) // (total + 5 * v)
        priced = {s: {w: price(c.get(w, 0), sum(c.get(x, 0) for x in kept)) for w in kept} for s, c in groups.items()}
        total = {w: sum(c.get(w, 0) for c in groups.values()) for w in kept}
        for s, p in priced.items():
            pairs = [(sum(abs(p[w] - priced[t][w]) for w in kept), t, "pair") for t in groups if t != s]
            over = [(p[w] - price(total[w], sum(total.values())), w, "term") for w in kept if groups[s].get(w)]
            for part in (pairs, [x for x in over if x[0] > 0]):
                part.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, k, item, value, n) for n, (value, item, k) in enumerate(part[: len(pairs) if part is pairs else 50], 1)]
    return sorted(out, key=str)


def test_divergence_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MIN_DOCS", 3)
    rng = random.Random(4)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "ijkl"] + ["Straße", "ÉTÉ", "été", "naïve", "日本"]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(9), 5)}") for _ in range(160)]
    docs += [(None, "en", None), ("", "fr", "only"), ("12 34", "fr", "digits"), ("", "en", "silent"), ("A.b_C-d'e", "en", "s1")] * 2
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "count": F.lit("x"), "p": F.lit(2.0)})
    found = divergence.audit(df).select("lang", "source", "part", "item", "value", "rank")
    assert sorted((tuple(r) for r in found.collect()), key=str) == audit_of(docs, 3)


def test_divergence_counts_in_small_memory(spark, monkeypatch):
    docs = spark.createDataFrame([("ab cd ab " * 50, "en", "s")] * 40, "text string, lang string, source string").coalesce(1)
    whole = {tuple(r) for r in divergence.term_counts(docs).collect()}
    batches = lambda: iter([b for b in docs.toArrow().to_batches()] * 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 0)
    monkeypatch.setattr(divergence, "OUT_ROWS", 1)
    parts = [r for b in divergence._count(batches()) for r in b.to_pylist()]
    assert whole == {("en", "s", None, 0, 0), ("en", "s", "ab", 4000, 40), ("en", "s", "cd", 2000, 40)}
    assert sum(r["count"] for r in parts if r["term"] == "ab") == 12_000 and sum(r["docs"] for r in parts if r["term"] == "ab") == 120


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# Search


def best_of(rows, k):
    """The k best of every query row by whole numbers of Python."""
    bad = lambda v: v is None or any(x is None or not np.isfinite(x) for x in v)
    live = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and not bad(v)]
    out = []
    for n, (q, a) in enumerate(live):
        if q % 50 == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for m, (i, b) in enumerate(live) if m != n]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "v": F.lit(1), "row_no": F.lit(None).cast("int")})
    found = exact_search.top_k(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), **more)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_search_equals_all_products(spark, monkeypatch, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 40))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=40)).tolist()) for i in range(700)]
    monkeypatch.setattr(exact_search, "SEED_ROWS", 50)
    assert searched(spark, rows) == best_of(rows, 5)
    assert searched(spark, rows, query_bytes=8 * 40 * 4, k=3) == best_of(rows, 3)  # four slabs


def test_search_of_odd_rows(spark):
    """Nulls, non-finite and huge components, ties, repeated ids, short vectors."""
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-0.001, 0.0])]
    rows += [(7, None), (8, [1.0, None]), (9, [float("nan"), 9.0]), (100, [float("inf"), 1.0]), (None, [5.0, 5.0]), (11, [3.0]), (12, [])]
    rows += [(150, [1e9, 1e9]), (14, [1e300, -1e300]), (200, [1e300, 1.0]), (16, [3e7, 1e-3])]
    assert searched(spark, rows) == best_of(rows, 5)
    assert searched(spark, []) == []
    assert searched(spark, [(50, [1.0])]) == []


def test_bounds_hold_and_prune(spark):
    """No bound lies below its product; blocks of far rows are not scored."""
    rng = np.random.default_rng(5)
    a, b = np.floor(rng.normal(size=(60, 64)) * 256), np.floor(rng.normal(size=(80, 64)) * 256)
    exact, last = a @ b.T, None
    for length in exact_search.LENGTHS:
        bound = exact_search.segments(a, length) @ exact_search.segments(b, length).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()  # closer with every level
        last = bound
    near, far = np.repeat(a[:1], 50, 0), np.floor(rng.normal(size=(4000, 64)) * 8)
    slab = exact_search.Slab(np.array([-1]), np.array([0]), a[:1], np.array([int(exact[0].max())]))
    best, n = exact_search.Best(1, 5), np.arange(4050)
    assert exact_search.search_block(slab, best, n, n, np.vstack([near, far])) == 50
    assert best.id.tolist() == [0, 1, 2, 3, 4]


# Fill-in-middle


def middle_of(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, len(units), form, len(pre), len(mid), out, text)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 15])
def test_middle_equals_plain_cutting(spark, size):
    """Every size of chunk, down to one byte, gives the same cuts."""
    rng = random.Random(size)
    letters = "ab é漢😀<>PSM\t\n\r\x0b\x0c  "
    docs = [(n, "".join(rng.choices(letters, k=rng.randrange(60 if size < 64 else 600)))) for n in range(120)]
    docs += [(200, ""), (201, None), (202, "   "), (203, "a"), (204, " a "), (205, "<P>x y"), (None, "one two three"), (207, " x y z")]
    docs += [(208, "same words here")] * 3 + [(None, "one two three")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(1), "__body": F.lit(2)})
    found = fill_in_middle.transform(df, size=size)
    found = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((middle_of(*d) for d in docs), key=str)


def test_middle_of_a_long_text(spark):
    """A text of many chunks, without any white space and with much, and an empty table."""
    docs = [(4, "x" * 300_000), (9, "word é " * 60_000), (1, " " * 100_000 + "end"), (12, "a b " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = fill_in_middle.transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((middle_of(*d) for d in docs), key=str)
    assert fill_in_middle.transform(df.limit(0)).count() == 0
