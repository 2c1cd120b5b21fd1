import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import linear as L
from quillon.llm import quality, toxicity
from quillon.llm.toxicity import CHAIN, classify, fit_chain, predict_chain, without_toxic

from .cases import awkward, empty, words

LABELS = "doc_id long, quality int, toxic int"


def planted(n, seed=1):
    """Documents whose toxic ones hold one of ten bad words somewhere, in texts of 20 to 2,000 words."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        ws = words(rng, rng.choice([20, 60, 200, 2000]), 3000)
        toxic, junk = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                ws[rng.randrange(len(ws))] = f"bad{rng.randrange(10)}"
        if junk:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = planted(1600)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:1100], LABELS)
    models = fit_chain(docs, known)
    p = predict_chain(models, [t for _, t in rows[1100:]])
    y = np.array([(1 - q, x) for _, q, x in labels[1100:]])
    assert ((p[:, 0] > 0.5) == y[:, 0]).mean() > 0.99
    assert ((p[:, 1] > 0.3) & (y[:, 1] == 1)).sum() > 0.95 * y[:, 1].sum() and ((p[:, 1] > 0.3) & (y[:, 1] == 0)).sum() <= 2
    assert models[1].weights.shape[0] == models[0].weights.shape[0] - len(models[0].words) + len(models[1].words) + 1  # sees the earlier one


def test_same_as_one_by_one(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    rows = docs.collect()
    p = predict_chain(fit_chain(docs, labels), [r.text for r in rows])
    for r, (q, t) in zip(rows, p, strict=True):
        assert abs(got[r.doc_id].p_low_quality - q) < 1e-9 and abs(got[r.doc_id].p_toxic - t) < 1e-9 and got[r.doc_id].toxic == int(t > 0.3)
    assert sorted(r.doc_id for r in without_toxic(docs, labels).collect()) == sorted(i for i, r in got.items() if not r.toxic)


def plain_fit(rows, x, y):
    """A linear model in plain loops: the words that tell most by chi-square, and gradient-free Newton steps."""
    n, p = len(y), sum(y)
    seen, yes = Counter(w for r in rows for w in r), Counter(w for r, v in zip(rows, y, strict=True) for w in r if v)
    rank = []
    for w, a in seen.items():
        if 3 <= a < n and 0 < p < n:
            table = [[yes[w], a - yes[w]], [p - yes[w], n - p - a + yes[w]]]
            chi2 = sum((table[i][j] - e) ** 2 / e for i in (0, 1) for j in (0, 1) for e in [(a if i == 0 else n - a) * (p if j == 0 else n - p) / n])
            if chi2 >= L.LEAST_CHI2:
                rank.append((-chi2, w))
    chosen = [w for _, w in sorted((round(c, 9), w) for c, w in rank)[: L.MAX_WORDS]]
    mean, dev = x[:, : L.N_FORM].mean(0), x[:, : L.N_FORM].std(0) + 1e-9

    def features(rows, x):
        return np.array([[float(w in r) for w in chosen] + list((f[: L.N_FORM] - mean) / dev) + [2 * e - 1 for e in f[L.N_FORM :]] + [1.0] for r, f in zip(rows, x, strict=True)])

    m, target = features(rows, x), np.array(y, float)
    w = np.zeros(m.shape[1])
    w[-1] = np.log((p + 0.5) / (n - p + 0.5))
    if 0 < p < n:
        for _ in range(12):
            q = 1 / (1 + np.exp(-m @ w))
            ridge = np.r_[np.full(len(w) - 1, 0.1), 1e-6]
            move = np.linalg.solve(m.T @ np.diag(q * (1 - q)) @ m + np.diag(ridge), m.T @ (q - target) + ridge * w)
            w = w - move
            if np.abs(move).max() < 1e-5:
                break
    return lambda rows, x: 1 / (1 + np.exp(-features(rows, x) @ w))


def test_chain_by_plain_code(spark):
    """The whole chain fitted again by plain code: out-of-fold predictions of the first link feed the second."""
    rows, labels = planted(240, seed=5)
    rows += [(900 + i, rows[i][1]) for i in range(20)]  # equal texts lie in one fold
    labels += [(900 + i, *labels[i][1:]) for i in range(20)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, LABELS)
    words_, form = zip(*(L.features(t) for _, t in rows), strict=True)
    form, texts = np.array(form), [t for _, t in rows]
    low, toxic = [1 - q for _, q, _ in labels], [t for *_, t in labels]
    fold = [zlib.crc32(t.encode()) % L.FOLDS for t in texts]
    out = np.zeros(len(rows))
    for f in range(L.FOLDS):
        own, rest = [i for i in range(len(rows)) if fold[i] == f], [i for i in range(len(rows)) if fold[i] != f]
        out[own] = plain_fit([words_[i] for i in rest], form[rest], [low[i] for i in rest])([words_[i] for i in own], form[own])
    first, second = plain_fit(words_, form, low), plain_fit(words_, np.c_[form, out], toxic)
    p = first(words_, form)
    q = second(words_, np.c_[form, p])
    got = {r.doc_id: r for r in classify(docs, known).collect()}
    assert max(abs(got[i].p_low_quality - x) for (i, _), x in zip(rows, p, strict=True)) < 1e-6
    assert max(abs(got[i].p_toxic - x) for (i, _), x in zip(rows, q, strict=True)) < 1e-6
    assert all(abs(got[900 + i].p_toxic - got[i].p_toxic) < 1e-9 for i in range(20))


def test_sample_is_bounded(spark):
    """Ids that repeat in documents and labels don't raise the number of rows that are fitted on."""
    docs = spark.range(4000).selectExpr("id % 5 as doc_id", "concat('text ', id) as text")
    known = spark.createDataFrame([(i % 5, i % 2, 0) for i in range(20)], LABELS)
    a, b = (L.sample(d, known, [F.col("quality")], most=7) for d in (docs, docs.repartition(9)))
    assert len(a.y) == 7 and (a.texts == b.texts).all() and (a.y == b.y).all()


def test_the_driver_fits_nothing(spark, monkeypatch):
    """The labelled rows and the fit stay in a task; the same models come of it as of a fit on the sample."""
    rows, labels = planted(120, seed=8)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    want = predict_chain(toxicity._fitted(L.sample(docs, known, [y() for y in CHAIN.values()])), [t for _, t in rows])
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "fit", None)
    assert np.abs(predict_chain(fit_chain(docs, known), [t for _, t in rows]) - want).max() < 1e-9
    assert quality.classify(docs.selectExpr("*", "'a' as source", "'b' as lang"), known).count() == 120


def test_awkward(spark):
    docs = awkward(spark)
    for labels in ([], [(1, 1, 0), (4, None, 1), (999, 0, 1), (None, 1, 1)], [(i, i % 2, int(i % 3 == 0)) for i in range(10, 40)]):
        known = spark.createDataFrame(labels, LABELS)
        assert len(classify(docs, known).collect()) == docs.count()
        assert classify(empty(spark), known).collect() == []
        assert without_toxic(docs, known).columns == docs.columns
    assert list(CHAIN) == ["low_quality", "toxic"]
