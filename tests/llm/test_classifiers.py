"""Toxicity and quality: held-out accuracy and odd inputs."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def labelled(spark, column):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", column).orderBy("doc_id").collect()
    return [(r[0], r[1].encode(), r[2]) for r in rows]


def with_letters(text):
    """The text with a drawn letter put into every word of over three letters."""
    rng = random.Random(len(text))
    return re.sub(r"[^\W\d_]{4,}", lambda m: (lambda w, at: w[:at] + rng.choice("abcxyz") + w[at:])(m[0], rng.randrange(1, len(m[0]))), text)


@DATA
def test_toxicity_on_rows_not_learnt_from(spark):
    """What ships: the query's own scores, and its model on disguised texts of the same rows."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()}
    found = [r for r in toxicity.op1_string_kernel_toxicity(spark, SF).where("held_out").collect() if r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in found], dtype=bool)
    p = np.array([r["predicted"] for r in found], dtype=bool)
    assert (p == y).mean() >= 0.975 and p[y].mean() >= 0.85 and p[~y].mean() <= 0.01
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out(2, 4))
    model = toxicity.train(documents, own)
    texts = {r["doc_id"]: r["text"] or "" for r in documents.where(toxicity.held_out(2, 4)).collect() if r["doc_id"] in labels}
    y = np.array([labels[i] for i in texts], dtype=bool)
    toxic = lambda change: toxicity.Scorer(model)([change(t).encode() for t in texts.values()]) >= toxicity.THRESHOLD
    for change in (with_letters, lambda t: re.sub(r"[^\W\d_]{4,}", lambda m: ".".join(m[0]), t)):
        p = toxic(change)
        assert p[y].mean() >= 0.75 and p[~y].mean() <= 0.02
    assert toxic(lambda t: t.replace(" ", ""))[~y].mean() <= 0.03
    plain, gapped, spelled, clean = toxicity.Scorer(model)([b"you are stupid", b"you are st.u.p.i.d", b"you are s t u p i d", b"you are there"])
    assert min(plain, gapped, spelled) > clean
    assert toxicity.unit_scores(["stupid", "stuxpid", "sxtupid", "window"], model.triples).argmin() == 3


def test_toxicity_does_not_depend_on_order():
    rng = random.Random(3)
    words = ["fine", "day", "river", "stone", "walk", "green", "über", "42"]
    docs = [(" ".join(rng.choices(words, k=12) + ["stupid"] * (n % 4 == 0)).encode(), int(n % 4 == 0)) for n in range(120)]
    docs += docs[:9] + [(docs[0][0], 0)]  # repeated rows, and a label that contradicts
    one = toxicity.fit(docs)
    rng.shuffle(docs)
    two = toxicity.fit(docs)
    assert (one.triples == two.triples).all() and (one.weights == two.weights).all() and (one.bias, one.offset) == (two.bias, two.offset)
    toxic, clean = toxicity.Scorer(one)([b"a stupid walk", b"a green walk"])
    assert toxic >= toxicity.THRESHOLD > clean


@DATA
def test_quality_on_rows_not_learnt_from(spark):
    rows = labelled(spark, "quality")
    out = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows])
    x, y = np.array([quality.text_features(t) for _, t, _ in rows]), np.array([y for *_, y in rows])
    model = quality.fit(x[~out], y[~out] == 1, np.ones((~out).sum(), dtype=bool))
    predicted = model.scores(x[out]) >= quality.THRESHOLD
    assert abs(model.prior - y.mean()) < 0.05
    assert (predicted == (y[out] == 1)).mean() > 0.97 and predicted[y[out] == 1].mean() > 0.98


def test_odd_texts_have_scores():
    texts = [b"", b"   ", b"\n", "é".encode() * 1000, b"a" * 100_000, b"%%% &&& ***"]
    model = toxicity.fit([(b"you idiot there", 1), (b"a fine day", 0)] * 20)
    scores = toxicity.Scorer(model)(texts)
    assert ((scores >= 0) & (scores <= 1)).all()
    assert np.isfinite(np.array([quality.text_features(t) for t in texts])).all()


def test_without_labels_scores_are_low(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    toxic = toxicity.with_score(docs, toxicity.train(docs, none))
    assert all(0 <= r["score"] < toxicity.THRESHOLD for r in toxic.collect())
    good = quality.with_score(docs, quality.train(docs, none, docs), "q")
    assert good.columns == ["doc_id", "text", "q"] and all(0 <= r["q"] < 0.5 for r in good.collect())
    assert toxicity.with_score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_a_score_column_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for found in (toxicity.with_score(docs, toxicity.train(docs, none)), quality.with_score(docs, quality.train(docs, none, docs))):
        rows = found.collect()
        assert found.columns == ["doc_id", "text", "score"] and len(rows) == 3
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1


def subsequences(unit):
    """Weights of all triples of a marked unit that span SPAN characters at most."""
    codes = [toxicity.BEGIN, *toxicity._codes(np.array([ord(c) for c in unit])).tolist(), toxicity.END_MARK]
    out = Counter()
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < toxicity.SPAN:
            out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_and_machine_match_the_direct_sums():
    """The Gram matrix of subsequences by enumeration, and the folded machine by its sum over landmarks."""
    units, marks = ["idiot", "idxiot", "fool", "foool", "window"], ["idiot", "fool", "wind"]
    norm = lambda u: toxicity._norms(np.array([len(u) + 2.0]))[0]
    direct = np.array([[sum(x * b[t] for t, x in a.items()) / norm(u) / norm(m) for m, b in ((m, subsequences(m)) for m in marks)] for u, a in ((u, subsequences(u)) for u in units)])
    bags = toxicity.features(marks)
    space = {t: n for n, t in enumerate(sorted(set().union(*bags)))}
    rows = np.zeros((len(marks), len(space)))
    for n, bag in enumerate(bags):
        rows[n, [space[t] for t in bag]] = list(bag.values())
    assert np.allclose(toxicity.unit_kernel(units, rows, space), direct)
    weights = np.array([0.7, -0.2, 0.4])
    assert np.allclose(toxicity.unit_scores(units, toxicity.fold(bags, weights)), direct @ weights)


def test_training_lowers_the_non_negative_risk():
    """The unbiased risk, held at zero from below, computed directly before and after training."""
    r = np.random.default_rng(2)
    n = quality.N_FEATURES
    pos, neg = r.normal(1, 1, (600, n)), r.normal(-1, 1, (900, n))
    web = np.vstack([pos[:300], neg])
    model = quality._train(pos[300:], web, 0.25)

    def risk(output):
        loss = lambda v, y: np.logaddexp(0, -y * v).mean()
        p, u = output(pos[300:]), output(web)
        return 0.25 * loss(p, 1) + max(0.0, loss(u, -1) - 0.25 * loss(p, -1))

    zero = risk(lambda x: np.zeros(len(x)))
    assert risk(model.output) < 0.2 * zero
    assert (model.scores(neg) < 0.5).mean() > 0.97 and (model.scores(pos) >= 0.5).mean() > 0.9


def test_contract_columns_of_the_queries(spark, tmp_path):
    rows = [(i, f"you idiot number {i}" if i % 3 == 0 else f"a fine day of walks {i}") for i in range(60)] + [(None, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query, fold, left, least in ((toxicity.op1_string_kernel_toxicity, 4, 2, 0.3), (quality.op8_positive_unlabelled_quality, 3, 1, 0.5)):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(rows)
        for x in got:
            assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= least)
            assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % fold == left)


def test_long_units_are_read_in_windows():
    """An insult anywhere in a long unit, across any window's edge, lifts it over the same unit without."""
    weights = toxicity.fold(toxicity.features(["idiot"]), np.array([1.0]))
    units = ["x" * n + "idiot" + "y" * (80 - n) for n in range(0, 81, 7)]
    clean, *found = toxicity.unit_scores(["x" * 40 + "y" * 45, *units], weights)
    assert min(found) > clean + 0.1


@DATA
def test_quality_through_the_query(spark):
    small = SF.replace("sf0.1", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality is not null").collect()}
    found = [r for r in quality.op8_positive_unlabelled_quality(spark, small).where("held_out").collect() if r["doc_id"] in labels]
    y, p = (np.array(x, dtype=bool) for x in zip(*[(labels[r["doc_id"]], r["predicted"]) for r in found], strict=True))
    assert (p == y).mean() > 0.97 and p[y].mean() > 0.97


def test_prior_counts_all_rows(spark, monkeypatch):
    """Spark's counts over pieces of all rows equal one count at hand, repeated and null rows among them."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "%%", "x1"], 5 + n % 40)) for n in range(300)] + [None, "", "a"] * 2
    docs = spark.createDataFrame([(n if n % 50 else None, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = docs.withColumn("halves", quality._halves()).collect()
    x = np.array([quality.text_features((r["text"] or "").encode()) for r in rows])
    halves = np.array([r["halves"] for r in rows])
    is_p = np.arange(len(rows)) % 3 == 0
    firsts = quality.first_classifiers(x, is_p, ~is_p, halves)
    assert len(firsts) == 2 * quality.HALVINGS and len({r["halves"][0] for r in rows}) == 2
    assert (quality.reached_by_all(docs, firsts) == quality.reached(firsts, x, halves)).all()


def test_quality_of_odd_tables(spark):
    """An empty table, contradicting labels, and repeated training rows."""
    docs = spark.createDataFrame([(n, f"word{n % 7} and more {n}") for n in range(40)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)] + [(1, 0), (1, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, docs)
    assert quality.with_score(docs.limit(0), model).count() == 0
    assert quality.with_score(docs, model).where("score between 0 and 1").count() == 80
    empty = quality.train(docs.limit(0), labels, docs.limit(0))
    assert quality.with_score(docs, empty).where("score < 0.5").count() == 80
