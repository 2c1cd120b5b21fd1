from collections import Counter

import corpus_pipeline as P
from quillon.llm import common, decontaminate, toxicity

from .cases import awkward, empty
from .test_mixing import size, wanted
from .test_near_dup import brute


def test_stages_match_brute_force(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    steps = []
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        steps.append((before.collect(), docs.collect()))
        if k < 4:
            assert docs.columns == before.columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = steps[0]
    p = toxicity.predict_chain(toxicity.fit_chain(spark.read.parquet(f"{sf}/documents.parquet"), labels), [r.text for r in before])
    assert ids(after) == sorted(r.doc_id for r, x in zip(before, p, strict=True) if x[1] <= toxicity.REJECT_AT)
    before, after = steps[1]
    assert ids(after) == sorted(set(brute({r.doc_id: r.text for r in before}).values()))
    before, after = steps[2]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(after) == sorted(r.doc_id for r in before if not any(t in r.text for t in items))
    before, after = steps[3]
    sizes, taken, times = Counter(), Counter(), Counter(r.doc_id for r in after)
    for r in before:
        sizes[r.source] += size(r.text)
        taken[r.source] += size(r.text) * times[r.doc_id]
    goal = wanted(sizes)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}
    assert all(abs(taken[s] - goal[s]) <= max(size(r.text) for r in before if r.source == s) for s in sizes)
    before, after = steps[4]
    assert sorted(tuple(r) for r in before) == sorted(tuple(r[c] for c in docs.columns[:-1]) for r in after)
    assert docs.columns == [*before[0].asDict(), "shard"] and {r.shard for r in after} <= set(range(P.N_SHARDS))
    groups = {}
    for r in after:
        groups.setdefault(r.text, (len(r.text.encode()) + 16, []))[1].append(r.shard)
    assert all(len(set(s)) == 1 for _, s in groups.values())  # equal texts stay together
    items = sorted(((n * len(s), t) for t, (n, s) in groups.items()), reverse=True)
    load, best = Counter(r.shard for r in after for _ in range(len(r.text.encode()) + 16)), [0] * P.N_SHARDS
    for n, _ in items:
        best[best.index(min(best))] += n
    assert max(load.values()) <= 1.2 * max(best)
    assert decontaminate.COMMON <= 1


def test_awkward(spark, sf, tmp_path):
    """Every stage over nulls, empty and long texts, repeated rows and clashing columns, and over an empty table."""
    for n, start in enumerate((awkward(spark), empty(spark))):
        start.write.parquet(str(tmp_path / f"{n}"))
        docs = spark.read.parquet(str(tmp_path / f"{n}"))
        for k, (_, f) in enumerate(P.STAGES):
            f(spark, docs, sf).write.parquet(str(tmp_path / f"{n}-{k}"))
            before, docs = docs, spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            assert set(docs.columns) == set(before.columns) | ({"shard"} if k == 4 else set())
            if n:
                assert not docs.collect()
            elif k in (0, 2):
                assert docs.count() == before.count()  # nothing toxic, nothing of the benchmark
            elif k == 1:
                assert sum(r.text is None for r in docs.collect()) == 2 and docs.where("doc_id = 4").count() == 1 and docs.where("doc_id = 6").count() == 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 100


def test_staging_makes_no_marker(spark):
    """A marker costs the driver child processes for every stage, and nothing reads it."""
    from pathlib import Path

    with common.owner("here"):
        assert common.staged(spark.range(5), "five").count() == 5
        (path,) = common._staged["here"]
    names = [p.name for p in Path(path.removeprefix("file://")).iterdir()]
    common.release(spark, "here")
    assert "_SUCCESS" not in names and any(n.endswith(".parquet") for n in names)
