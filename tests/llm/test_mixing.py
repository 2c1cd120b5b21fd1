import re

import pytest

from quillon.llm.mixing import mix, mixed, order_key, plan, rates, source_key, targets, word_count

from .cases import awkward, empty


def wanted(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in names}
        over = [s for s in open_ if out[s] > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return out
        full |= set(over)


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, texts = mix(docs).collect(), {r.doc_id: r for r in docs.collect()}
    sizes = {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    goal, taken = wanted(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(texts)
    for r in rows:
        s = texts[r.doc_id].source
        assert r.size == size(texts[r.doc_id].text) and r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    own = lambda s: sorted(size(r.text) for r in texts.values() if r.source == s)
    assert all(abs(taken[s] - goal[s]) <= own(s)[len(own(s)) // 2] for s in sizes), {s: (taken[s], goal[s]) for s in sizes}  # whole documents
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs).collect()))
    assert sum(size(r.text) for r in mixed(docs).collect()) == sum(taken.values())


def test_dual_meets_its_constraints(spark):
    classes = spark.createDataFrame([("sa", 10, 4), ("sa", 300, 2), ("sa", 7000, 1), ("sb", 5, 3), ("sb", 5000, 1)], "src string, size long, n long")
    goals = targets(classes, (1.0, 3.0, 2.0), 1.0)
    got = rates(classes, goals).collect()
    for g in goals.collect():
        own = [r for r in got if r.src == g.src]
        assert sum(r.n * r.size * r.rate for r in own) == pytest.approx(g.target, rel=1e-6)
        assert sum(r.n * r.rate for r in own) == pytest.approx(g.target / g.source_size * g.docs, rel=1e-6)


def test_hot_class_is_cut_exactly(spark):
    docs = spark.range(70_000).selectExpr("id as doc_id", "'a b c' as text", "if(id < 60000, 'x', 'y') as source")
    sized = docs.select("doc_id", source_key(docs.source).alias("src"), word_count(docs.text).alias("size"), order_key(docs.doc_id).alias("key"))
    by_class, goals = plan(sized)
    got = {(r.src): r.t for r in mix(docs).groupBy("src").sum("taken").toDF("src", "t").collect()}
    assert all(abs(got[g.src] - g.target) <= 3 for g in goals.collect())
    assert by_class.count() == 2


def test_awkward(spark):
    docs = awkward(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert set(mixed(docs).columns) == set(docs.columns)
    assert mix(empty(spark)).collect() == [] and mixed(empty(spark)).collect() == []
    assert all(r.taken == 0 for r in mix(docs.where("text is null")).collect())
