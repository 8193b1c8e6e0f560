"""Near-duplicates, components, url filters and shards on small cases, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from scriptorium.llm import components, near_dup, sharding, url_filter

DOCS = "doc_id long, text string, score string"


def naive_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed=1, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(1, 120))]
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 8)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 20) + 1)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    return [*out, None, "", " \n", "one", "One", out[0]]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    roots, sizes = naive_components(texts, k, 80)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, k=k).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(roots))
    assert {i: r["n_shingles"] for i, r in got.items()} == dict(enumerate(sizes))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_large_nodes_are_split_without_losing_links(spark, monkeypatch):
    """With small limits the paths for large and dense nodes run on the same data."""
    monkeypatch.setattr(near_dup, "BIG", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    monkeypatch.setattr(near_dup, "FIRST_LEVEL", 2)
    monkeypatch.setattr(near_dup, "LAST_LEVEL", 3)
    texts = corpus(2, 8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, k=2).collect()}
    assert got == dict(enumerate(naive_components(texts, 2, 80)[0]))


def test_deep_nodes_of_a_templated_group_lose_no_links(spark, monkeypatch):
    """Texts that share three quarters of their words part only on deep levels, where ten trees
    lose about two links in a hundred."""
    monkeypatch.setattr(near_dup, "BIG", 4)
    monkeypatch.setattr(near_dup, "DENSE", 257)
    monkeypatch.setattr(near_dup, "LAST_LEVEL", 7)
    template, pairs = [f"t{i}" for i in range(75)], 150
    texts = []
    for i in range(pairs):
        own = [f"o{i}_{j}" for j in range(25)]
        texts += [" ".join(template + own), " ".join(template + own[11:] + [f"n{i}_{j}" for j in range(11)])]  # 89 of 111 words in both
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, k=1).collect()}
    assert got == {i: i - i % 2 for i in range(2 * pairs)}


def test_computed_miss_is_that_of_the_branching_law():
    assert 6e-3 < near_dup.missed(8, 10) < 1e-2 and near_dup.missed(near_dup.safe_level(10, 80), 10) <= near_dup.MISS / 2
    r = np.random.default_rng(4)

    def meets(p, level):
        return level == 0 or any(r.random() < p and meets(p, level - 1) for _ in range(1 + (r.random() < 0.25)))

    lost = sum(not any(meets(p, 6) for _ in range(3)) for p in r.binomial(near_dup.TOKENS, 0.8, 8000) / near_dup.TOKENS)
    assert abs(lost / 8000 / near_dup.missed(6, 3) - 1) < 0.1


def test_one_of_each_keeps_other_columns_and_rows_without_ids(spark):
    rows = [(None, "a b c d e f", "p"), (2, "a b c d e f", "q"), (None, "z y x w v u", "r"), (None, "z y x w v u", "r"), (5, None, "s"), (6, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    left = near_dup.one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter(r["row_key"] for r in left.collect()) == Counter("qrst")
    assert near_dup.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 150)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for u, v in pairs:
        if u is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    expected = {}
    for n in sorted(near):
        stack = [n] if n not in expected else []
        while stack:
            x = stack.pop()
            if x not in expected:
                expected[x] = n
                stack += near[x]
    edges = spark.createDataFrame(pairs, "u long, v long")
    assert {r["node"]: r["component"] for r in components.connected_components(edges).collect()} == expected
    assert components.connected_components(edges.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, verdict string"


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<link href="{u}" rel="canonical">'
    rows = [
        (1, "http://A.Example.com/en/x?q#f", ""),
        (2, "https://www.example.com/en/y", ""),
        (3, "https://other.org/a", '<LINK rel=canonical href="https://shop.net/fr/1">'),
        (4, "https://shop.net/fr/1#top", None),
        (5, "https://third.org/b", '<meta http-equiv="refresh" content="0; url=https://other.org/a#z">'),
        (6, "https://ok.com/c", link("https://shop.net/fr/1")),
        (7, None, "x"),
        (8, "no scheme", link("/x")),
        (9, "https://notexample.com/en/", ""),
        (10, "https://com", ""),
        (11, "https://free.org/", link("/q")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[4][2:] == ("net/fr/", "block")
    assert got[6][2:] == ("com/", "allow")  # an allow rule of its own
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("com/", "allow") and got[10] == ("com", "", None, "allow") and got[11][3] == "allow"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0
    many = url_filter.RULES + [(f"h{i}.org", "/", "allow") for i in range(100)]
    joined = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, many).collect()}
    assert joined == got
    moved = spark.createDataFrame([("https://free.org/q", "https://shop.net/es/")], "source_url string, target_url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.RULES, moved).collect()}[11] == "block"


def test_targets_of_links(spark):
    base = "https://a.org/x/y.html?p=1#f"
    cases = {
        "?q=2&amp;r=3": "https://a.org/x/y.html?q=2&r=3", "#top": "https://a.org/x/y.html#top", "../z/./w": "https://a.org/z/w", "../../..": "https://a.org/",
        "/a/../b?c=../d": "https://a.org/b?c=../d", "z": "https://a.org/x/z", "//h.net/i": "https://h.net/i", "http://j.com/../k": "http://j.com/../k", " ": None,
    }
    rows = spark.createDataFrame([(base, t) for t in cases], "base string, target string")
    got = {r["target"]: r["to"] for r in rows.select("target", url_filter._absolute(F.col("base"), F.col("target")).alias("to")).collect()}
    assert got == cases


def test_repeated_pages_are_judged_alike(spark):
    row = (1, "https://other.org/a", '<link rel="canonical" href="https://shop.net/fr/1">', "clash")
    pages = spark.createDataFrame([row, row, (2, "https://shop.net/fr/1", None, "x")], PAGES)
    assert sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES).collect()) == [(1, "block"), (1, "block"), (2, "block")]


def test_communication_matrix_is_exact():
    counts = [100, 0, 37, 1, 62]
    m = sharding.communication_matrix(counts, 7, 3)
    assert m.sum(axis=1).tolist() == counts
    assert max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    draws = np.array([sharding.communication_matrix([50, 50], 2, s)[0, 0] for s in range(2000)])
    assert abs(draws.mean() - 25) < 0.3 and abs(draws.var() - 50 * 0.25 * 50 / 99) < 0.6


def test_large_populations_follow_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 10)
    rng = np.random.default_rng(1)
    for good, bad, sample in ((300, 700, 100), (700, 300, 100), (300, 700, 900), (5, 200, 50)):
        x = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000)])
        n, p = good + bad, good / (good + bad)
        sd = (sample * p * (1 - p) * (n - sample) / (n - 1)) ** 0.5
        assert abs(x.mean() - sample * p) < 5 * sd / 4000**0.5 and abs(x.std() / sd - 1) < 0.08
        assert x.min() >= max(0, sample - bad) and x.max() <= min(good, sample)


def test_shards(spark, tmp_path):
    texts = [None, "", "é", "same", "same"] + [f"t{i}" for i in range(400)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op9_hypergeometric_shards(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert {len(s) for s in shards.values()} <= {10, 11}
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(sharding.op9_hypergeometric_shards(spark, str(tmp_path)).collect(), key=str)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op9_hypergeometric_shards(spark, f"{tmp_path}/none").count() == 0


def test_rows_of_one_id_are_dealt_like_others(spark):
    rows = spark.range(2000).selectExpr("7L AS doc_id", "id AS size", "id % 3 AS text_crc32")
    got = sharding.assign(rows, 40, [F.col(c) for c in rows.columns]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(50)) for x in by.values()) and len(by) == 40
    means = [sum(v for _, v in x) / 50 for x in by.values()]
    assert np.std(means) < 3 * 577 / 50**0.5 / 2 and min(means) < 1000 < max(means)
    steps = [b - a for x in by.values() for (_, a), (_, b) in zip(sorted(x), sorted(x)[1:], strict=False)]
    assert 0.4 < np.mean([s > 0 for s in steps]) < 0.6


def test_equal_rows_share_a_shard_as_seldom_as_others(spark):
    rows = spark.range(4000).selectExpr("id div 2 AS doc_id", "0L AS size", "0L AS text_crc32")
    shards = defaultdict(list)
    for r in sharding.assign(rows, 40, [F.col(c) for c in rows.columns]).collect():
        shards[r["doc_id"]].append(r["shard"])
    together = sum(a == b for a, b in shards.values()) / 2000
    assert 0.01 < together < 0.045


def test_groups_with_much_in_common_but_few_links(spark):
    """Copies with very different numbers of changes: many pairs agree in tokens and are no
    links; what leaves the tasks grows with the sets."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(500):
        w = list(base)
        for n in range(r.randrange(0, 16)):
            w[r.randrange(len(w))] = f"n{i}_{n}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, k=2).collect()}
    assert got == dict(enumerate(naive_components(texts, 2, 80)[0]))
