import random
from collections import defaultdict

import numpy as np

from quillon.llm import line_dedup
from quillon.llm.line_dedup import Cuckoo, LineStore, dedup

from .cases import awkward, empty

WS = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1


def brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(LAST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == (LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r))


def lines_df(spark, n=60, seed=1):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["  LINE number 3 of the pool\t", "short", "É" * 10, "é" * 10, "\x0b padded line \x0c here ", ""]
    return spark.createDataFrame([(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(n)], "doc_id long, text string")


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(dedup(docs)) == brute([tuple(r) for r in docs.collect()])


def test_cuckoo():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 30_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for most in (30_000, 20_000, 10):  # the last stashes nearly all
        f = Cuckoo(most)
        for part in np.array_split(h, 7):
            f.insert(part)
        f = Cuckoo.from_bytes(f.to_bytes())
        assert f.holds(h).all()
        if most > 10:
            assert f.holds(rng.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 0.01
        f.insert(h[:5])
        f.delete(np.r_[h[:2_000], h[:5]])  # what was inserted twice goes twice
        assert f.holds(h[2_000:]).all() and (most == 10 or f.holds(h[:2_000]).mean() < 0.01)
        f.delete(h[2_000:])
        assert not f.table.any() and not len(f.stash)


def test_insert_and_delete(spark, monkeypatch):
    """After any changes the store answers as if only what is there had ever been inserted."""
    docs = lines_df(spark)
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 8)
    monkeypatch.setattr(line_dedup, "LINES_PER_CELL", 10)
    monkeypatch.setattr(line_dedup, "MOST_CHANGES", 2)
    store = LineStore(spark)
    store.insert(docs.where("doc_id % 2 = 0"))
    live = {i for i in rows if i % 2 == 0}
    for batch, gone in (("doc_id % 2 = 1", "doc_id % 3 = 0"), ("doc_id % 3 = 0 and doc_id < 30", "doc_id > 50")):
        store.insert(docs.where(batch))
        live |= {r.doc_id for r in docs.where(batch).collect()}
        store.delete(docs.where(gone).select("doc_id"))
        live -= {r.doc_id for r in docs.where(gone).collect()}
        now = docs.where(docs.doc_id.isin(sorted(live)))
        assert got(store.dedup(now)) == brute([rows[i] for i in sorted(live)])
        holders = defaultdict(set)
        for r in store.references().collect():
            holders[r.h, r.g].add(r.doc_id)
        assert {(r.h, r.g): (r.n, r.first) for r in store.counts().collect()} == {k: (len(v), min(v)) for k, v in holders.items()}
    assert store.shards > 1
    filters = {r.shard: Cuckoo.from_bytes(r.filter) for r in store.filters().collect()}
    shared = store.shared().select("h", line_dedup._shard(store.shards).alias("shard")).collect()
    assert shared and all(filters[r.shard].holds(np.array([r.h]).view(np.uint64))[0] for r in shared)
    store.delete(spark.createDataFrame([(i,) for i in (*live, 12345)], "doc_id long"))
    assert store.shared().count() == 0 and store.references().count() == 0
    assert all(not Cuckoo.from_bytes(r.filter).table.any() for r in store.filters().collect())


def test_documents_that_are_not_in_the_store(spark):
    docs = lines_df(spark, seed=4)
    store = LineStore(spark)
    store.insert(docs.where("doc_id < 30"))
    got_ = {r.doc_id: r.text for r in store.dedup(docs).collect()}
    want = {i: t for i, _, _, t in brute([tuple(r) for r in docs.where("doc_id < 30").collect()])}
    assert {i: t for i, t in got_.items() if i < 30} == want


def test_shards_cells_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 5)
    monkeypatch.setattr(line_dedup, "LINES_PER_CELL", 4)
    monkeypatch.setattr(line_dedup, "HOT", 30)
    docs = lines_df(spark, seed=2)
    docs = docs.selectExpr("doc_id", "if(doc_id % 3 = 0, concat(text, '\\nthe very same line'), text) as text")
    assert got(dedup(docs)) == brute([tuple(r) for r in docs.collect()])


def test_nothing_is_left(spark):
    """What a store and its answers write goes with what is staged."""
    from pathlib import Path

    from quillon.llm import common

    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "staged"
    before = set(folder.glob("*")) if folder.exists() else set()
    with common.owner("here"):
        dedup(lines_df(spark, seed=3)).collect()
    assert set(folder.glob("*")) > before
    common.release(spark, "here")
    assert set(folder.glob("*")) == before


def test_awkward(spark):
    docs = awkward(spark)
    assert got(dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert dedup(empty(spark)).collect() == []
