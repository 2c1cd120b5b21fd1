import zlib
from collections import defaultdict

from quillon.llm import sharding
from quillon.llm.sharding import lpt, shard, sharded

from .cases import awkward, empty


def check(rows, texts, n):
    assert len(rows) == len(texts)
    slots, load, of = defaultdict(list), defaultdict(int), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows)
    for r in rows:
        assert of.setdefault((r.size, r.text_crc32), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    return load


def test_lpt_is_the_textbook_schedule():
    items = [(7, "a"), (7, "b"), (6, "c"), (6, "d"), (5, "e"), (5, "f"), (4, "g"), (4, "h"), (4, "i")]
    at = lpt(items, 4)
    load = defaultdict(int)
    for s, k in items:
        load[at[k]] += s
    assert max(load.values()) == 15  # the known worst case of the rule: the best schedule has 12


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    load = check(shard(docs, 5).collect(), [(r.doc_id, r.text) for r in docs.collect()], 5)
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())


def test_hot_group_stays_whole(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(900)], "doc_id long, text string")
    rows = shard(docs, 4).collect()
    load = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 4)
    assert len(load) == 4


def test_awkward(spark):
    docs = awkward(spark)
    check(shard(docs, 3).collect(), [(r.doc_id, r.text) for r in docs.collect()], 3)
    assert shard(empty(spark), 3).collect() == []


def test_rows_keep_their_columns(spark):
    docs = awkward(spark)
    rows = sharded(docs, 3).collect()
    assert set(sharded(docs, 3).columns) == set(docs.columns)  # one of which is called shard
    want = sorted((r.doc_id is None, r.doc_id or 0, r.shard) for r in shard(docs, 3).collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.shard) for r in rows) == want
    assert sorted(repr(r.text) for r in rows) == sorted(repr(r.text) for r in docs.collect())
    assert sharded(empty(spark), 3).collect() == []


def test_cells(spark, monkeypatch):
    """A row that a third of the table repeats is numbered in several cells."""
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 10)
    docs = spark.createDataFrame([(7, "same") if i % 3 == 0 else (i, f"text {i}") for i in range(300)], "doc_id long, text string").repartition(5)
    check(shard(docs, 2).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2)
