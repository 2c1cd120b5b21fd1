import random

from quillon.llm.hamming import top_k


def brute(rows, asked, k):
    codes = {i: sum(1 << n for n, x in enumerate(v[:64]) if x is not None and x > 0) for i, v in rows if v is not None}
    out = set()
    for q in asked:
        if q in codes:
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:k]
            out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return out


def run(spark, rows, asked, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return [tuple(r) for r in top_k(df, df.where(df.vec_id.isin(asked)), k).collect()]


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = [tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, [i for i, _ in rows if i % 50 == 0], 10)


def test_far_and_equal_codes(spark):
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    same = vector()
    rows = [(i, same) for i in range(40)] + [(i, vector()) for i in range(40, 60)] + [(60, None), (61, []), (62, [None] * 64), (63, [1.0] * 80)]
    asked = [0, 39, 50, 60, 61, 63]
    got = run(spark, rows, asked, 7)
    assert len(got) == len(set(got)) and set(got) == brute(rows, asked, 7)


def test_fewer_rows_than_k(spark):
    rows = [(1, [1.0]), (2, [-1.0]), (3, [1.0, 1.0])]
    assert set(run(spark, rows, [1], 10)) == brute(rows, [1], 10)
    assert run(spark, [], [1], 10) == []


def test_awkward(spark):
    """Nulls, empty vectors, repeated rows, ids with unlike codes, far queries and columns whose names clash."""
    rng = random.Random(9)
    near = [1.0] * 64
    flip = lambda v, n: [-x if i in set(rng.sample(range(64), n)) else x for i, x in enumerate(v)]
    rows = [(i, flip(near, i % 4)) for i in range(30)] + [(7, [-1.0] * 64), (7, [-1.0] * 64), (8, None), (9, []), (31, [-1.0, None] * 32), (32, flip([1.0, -1.0] * 32, 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("query_id", "asked", "bound", "code", "ids", "id", "seg", "value", "of", "own", "at", "rank", "distance"):
        df = df.selectExpr("*", f"'x' as `{c}`")
    got = [tuple(r) for r in top_k(df, df.where("vec_id in (0, 7, 9, 31, 32)"), 6).collect()]
    codes = {(i, sum(1 << n for n, x in enumerate(v) if x is not None and x > 0)) for i, v in rows if v is not None}
    want = []
    for q, c in sorted(codes):
        if q in (0, 7, 9, 31, 32):
            found = sorted(((c ^ d).bit_count(), i) for i, d in codes if i != q)[:6]
            want += [(q, n + 1, i, x) for n, (x, i) in enumerate(found)]
    assert sorted(got) == sorted(want)
