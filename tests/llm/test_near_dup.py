import random
from collections import defaultdict

import numpy as np

from quillon.llm.common import components, labelled, shingles
from quillon.llm.near_dup import aligned, bands, near_duplicates, representatives, sketch

from .cases import awkward, empty, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(docs):
    """Classes by comparing all pairs with a plain longest common subsequence of labelled five-word shingles."""
    lab = {i: labelled(shingles(t or "")).tolist() for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if docs[i] is None or docs[j] is None or find(i) == find(j):
                continue
            total = len(lab[i]) + len(lab[j])
            common = len(set(lab[i]) & set(lab[j]))
            if docs[i] == docs[j] or (common and common / (total - common) >= 0.8 and (m := lcs(lab[i], lab[j])) / (total - m) >= 0.8 - 1e-9):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a = words(rng, rng.randrange(5, 80), 30)
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(0, 3)] = words(rng, rng.randrange(0, 3), 30)
        x, y = labelled(shingles(" ".join(a))), labelled(shingles(" ".join(b)))
        m = lcs(x.tolist(), y.tolist())
        sim = m / (len(x) + len(y) - m)
        got = aligned(x, y)
        assert got == (sim if sim >= 0.8 else 0.0) or abs(got - sim) < 1e-9


def test_sketch_keeps_order():
    a = labelled(shingles(" ".join(words(random.Random(2), 200, 10_000))))
    assert np.array_equal(sketch(a), sketch(a.copy())) and len(bands(sketch(a))) == 24
    assert (sketch(a) == sketch(a[::-1].copy())).mean() < 0.05  # same set, other order


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == brute(docs)


def test_chain_and_hub(spark):
    """A base with many copies that aren't near one another, and a chain; the same words in another order stay apart."""
    rng = random.Random(3)
    base = words(rng, 200, 10_000)
    docs = {0: " ".join(base)}
    for i in range(1, 40):
        copy = list(base)
        for at in rng.sample(range(200), 4):
            copy[at] = f"x{i}-{at}"
        docs[i] = " ".join(copy)
    chain = words(rng, 150, 10_000)
    for i in range(40, 52):
        docs[i] = " ".join(chain)
        chain[(i - 40) * 11 + 5] = f"y{i}"
        chain[(i - 40) * 11 + 8] = f"z{i}"
    docs[60] = " ".join(base[100:] + base[:100])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, i) for i in range(101, 140)] + [(201, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.root].add(r.node)
    assert {k: len(v) for k, v in by.items()} == {0: 21, 100: 40, 200: 2}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward(spark):
    docs = awkward(spark)
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r.class_id for r in got}
    assert of[1] == 1 and of[8] == 8 and of[6] == 5 and of[4] == 4 and of[2] == 2 and of[3] == 3
    assert near_duplicates(empty(spark)).collect() == []


def test_null_ids(spark):
    """Near copies without an id are aligned like those with one."""
    base = words(random.Random(12), 120, 9000)
    other = [*base[:60], "new", *base[61:]]
    for ids in ((None, 2), (None, None)):
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, (base, other), strict=True)], "doc_id long, text string")
        assert representatives(df).count() == 1, ids


def test_representatives(spark):
    a, b, c = (" ".join(words(random.Random(i), 80, 9000)) for i in (7, 8, 9))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b), (None, c), (None, c), (None, "another text of no id at all"), (5, a), (5, a), (6, None), (7, None), (0, b + " end"), (8, "one"), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as root")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in representatives(df).collect()))
    want = [(1, a), (0, b + " end"), (None, c), (None, "another text of no id at all"), (6, None), (7, None), (8, "one")]
    assert got == sorted((i is None, i or 0, t or "") for i, t in want)
    assert representatives(df).columns == df.columns and representatives(df.limit(0)).collect() == []
