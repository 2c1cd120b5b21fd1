import random

import numpy as np

from quillon.llm import decontaminate as D

from .cases import awkward, empty, words
from .test_near_dup import lcs


def test_common_length():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert D.common_length(D.places_of(np.array(a, int)), len(a), b) == lcs(a, b)


def test_randomised_svd_finds_the_leading_directions(spark):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, 64) % (20 if i % 2 else 40) for i in range(200)]
    ids = spark.createDataFrame([(x.astype(np.int32).tobytes(),) for x in docs], "ids binary")
    got = D.latent_terms(ids, 40, rank=5)
    df = np.array([sum(t in x for x in docs) for t in range(40)])
    idf = np.log(201 / (df + 1)) + 0.05
    a = np.array([np.bincount(x, minlength=40) * idf for x in docs])
    _, s, vt = np.linalg.svd(a)
    ours = np.linalg.norm(a @ (got[:, :5] / idf[:, None]))
    assert ours > 0.98 * np.linalg.norm(s[:5]) and got.shape == (40, 5 + D.RESIDUAL)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_planted(spark):
    """Whole items, items with words changed, in long texts, at any place; and texts that only share words."""
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.choice([18, 30, 45, 60, 120]), 2000)) + ". " + " ".join(words(rng, 6, 2000))) for i in range(30)]
    docs, want = [], {}
    for d in range(240):
        ws = words(rng, rng.choice([40, 300, 3000]), 2000)
        if d % 3 == 0:
            i, text = items[rng.randrange(30)]
            own = text.split()
            if d % 2:
                for at in rng.sample(range(len(own) - 6), len(own) // 8):
                    own[at] = "changed"
            at = rng.randrange(len(ws))
            ws[at:at] = own
            want[d] = i
        docs.append((d, " ".join(ws).upper() if d % 5 == 0 else " ".join(ws)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.contaminated(df, bench(spark, items)).collect()}
    assert {d: i for d, i in got.items() if i} == {d: [i] for d, i in want.items()}
    assert sorted(r.doc_id for r in D.decontaminated(df, bench(spark, items)).collect()) == sorted(set(got) - set(want))


def test_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    want = {r.doc_id: sorted(i for i, t in texts if t in r.text) for r in docs.collect()}
    got = {r.doc_id: sorted(r.item_ids) for r in D.contaminated(docs, items).collect()}
    assert got == want


def test_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {r.doc_id: sorted(r.item_ids) for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D, "BLOCK", 17)
    monkeypatch.setattr(D, "BLOCK_BYTES", max(len(r.text) for r in items.collect()) * 9)  # some blocks end by their bytes
    assert one == {r.doc_id: sorted(r.item_ids) for r in D.contaminated(docs, items).collect()}


def test_awkward(spark):
    docs = awkward(spark)
    items = bench(spark, [(1, None), (2, ""), (3, "one two"), (None, "x y z"), (4, docs.where("doc_id = 12").first().text), (4, "twice the id")])
    got = {r.doc_id: r for r in D.contaminated(docs, items).collect()}
    assert got[12].item_ids == [4] and got[4].contaminated == 1 and got[1].contaminated == 0 and got[2].contaminated == 0
    assert D.contaminated(empty(spark), items).collect() == []
    assert {r.contaminated for r in D.contaminated(docs, bench(spark, [])).collect()} == {0}
    assert D.decontaminated(docs, items).columns == docs.columns


def test_items_without_their_end(spark):
    """Without an answer column no part of an item must be there: its end may be missing or edited."""
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 37, 2000)) + ". End.") for i in range(5)] + [(5 + i, " ".join(words(rng, 24, 2000)) + ". " + " ".join(words(rng, 10, 2000)) + ".") for i in range(5)]
    docs = []
    for i, text in items:
        own = text.replace(".", "").split()
        end = 37 if i < 5 else 24
        for j, shown in enumerate((own[:end], own[:end] + ["edited"] * (len(own) - end))):
            ws = words(rng, 200, 2000)
            ws[90:90] = shown
            docs.append((10 * i + j, " ".join(ws)))
    docs += [(1000 + d, " ".join(words(rng, 200, 2000))) for d in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.contaminated(df, bench(spark, items)).collect()}
    assert got == {d: [d // 10] if d < 1000 else [] for d, _ in docs}
    assert {r.doc_id for r in D.decontaminated(df, bench(spark, items)).collect()} == {d for d in got if d >= 1000}


def test_answers_are_asked_for_where_supplied(spark):
    ws = [f"q{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(ws), "the answer here"), (2, " ".join(ws), None)], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(ws) + " the answer here"), (3, "pad " * 40)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.contaminated(docs, items, answer_col="answer").collect()}
    assert got == {1: [2], 2: [1, 2], 3: []}


def test_blocks_within_an_id(spark, monkeypatch):
    """More rows of one id, and of none, than a block holds: all of them are searched, and an item counts once."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, 20, 5000)) for _ in range(30)]
    ids = [None] * 11 + [1] * 3 + [2] * 14 + [3] * 2
    docs = [(d, " ".join([*words(rng, 60, 5000), t, *words(rng, 60, 5000)])) for d, t in enumerate(texts)]
    docs += [(100, " ".join([docs[0][1], *texts[14:28], docs[29][1]])), (101, None), (102, " ".join(words(rng, 200, 5000)))]
    want = {d: [i] for d, i in enumerate(ids)} | {100: [None, 2, 3], 101: [], 102: []}
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, list(zip(ids, texts, strict=True)) + [(2, texts[14]), (2, None), (None, None)])
    for block in (4, 2000):
        monkeypatch.setattr(D, "BLOCK", block)
        got = {r.doc_id: r for r in D.contaminated(df, items).collect()}
        assert {d: r.item_ids for d, r in got.items()} == want
        assert all(r.n_items == len(r.item_ids) == len(r.hits) and r.common == (1 if r.hits else 0) for r in got.values())
        assert sorted(r.doc_id for r in D.decontaminated(df, items).collect()) == [101, 102]


def test_blocks_keep_the_best_hit_of_an_item(spark, monkeypatch):
    ws = [f"q{i}" for i in range(40)]
    items = bench(spark, [(1, "a " + " ".join(ws[:20] + ["other"] * 5)), (1, "b " + " ".join(ws))])
    monkeypatch.setattr(D, "BLOCK", 1)
    docs = spark.createDataFrame([(1, "b " + " ".join(ws)), (2, "pad " * 50)], "doc_id long, text string")
    got = {r.doc_id: r for r in D.contaminated(docs, items).collect()}
    assert got[1].item_ids == [1] and got[1].common == 1 and not got[2].hits


def test_blocks_of_answers(spark, monkeypatch):
    """Rows that differ in their answer alone, or have none, are rows of their own."""
    text = " ".join(f"q{i}" for i in range(30))
    items = spark.createDataFrame([(1, text, a) for a in (None, "x1 x2", "y1 y2", "z1 z2")], "item_id long, text string, answer string")
    monkeypatch.setattr(D, "BLOCK", 1)
    assert [[len(a) for a in b.answers] for b in D._blocks(items, "item_id", "text", "answer")] == [[0], [2], [2], [2]]


def test_parts_of_long_items(spark):
    """A quote of the end of an item, or over what would be a boundary of parts."""
    ws = [f"q{i}" for i in range(900)]
    items = bench(spark, [(n, " ".join(f"{n}{w}" for w in ws[:n])) for n in (256, 257, 300, 319, 512, 900)])
    quotes = [(256, 0, 256), (257, 60, 257), (300, 110, 300), (319, 140, 319), (512, 106, 406), (900, 618, 900), (900, 320, 510), (900, 0, 900)]
    docs = [(d, " ".join(["pad"] * 90 + [f"{n}{w}" for w in ws[a:b]] + ["pad"] * 90)) for d, (n, a, b) in enumerate(quotes)]
    df = spark.createDataFrame([*docs, (99, "pad " * 300)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.contaminated(df, items).collect()}
    assert got == {d: [q[0]] for d, q in enumerate(quotes)} | {99: []}
    whole = [(f"{n}", [len(t) for t in D.items_of([(n, " ".join(ws[:n]), None)]).terms]) for n in (0, 1, 256, 257, 384, 385)]
    assert whole == [("0", []), ("1", [1]), ("256", [256]), ("257", [256] * 2), ("384", [256] * 2), ("385", [256] * 3)]
