import math
from collections import defaultdict

import pytest

from quillon.llm import quality as Q

from .cases import awkward, empty
from .test_toxicity import LABELS, planted


def brute(rows):
    """Posteriors of (doc_id, host, path, p), by plain loops."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, k, p in rows:
        hosts[h].append(p)
        paths[h, k].append(p)
    mu = sum(p for *_, p in rows) / len(rows)

    def strength(groups, above):
        n = sum(map(len, groups.values()))
        mean = {g: sum(v) / len(v) for g, v in groups.items()}
        within = sum(max(0, sum(x * x for x in v) / len(v) - mean[g] ** 2) for g, v in groups.items())
        between = sum(len(v) * (mean[g] - above(g)) ** 2 for g, v in groups.items())
        spread = (between - within) / n
        top = sum(len(v) * above(g) * (1 - above(g)) for g, v in groups.items()) / n
        return min(Q.MOST, max(Q.LEAST, top / spread - 1)) if spread > 1e-12 else Q.MOST

    kh = strength(hosts, lambda g: mu)
    of_host = {h: (sum(v) + kh * mu) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(paths, lambda g: of_host[g[0]])
    out = {}
    for i, h, k, p in rows:
        ph = (sum(hosts[h]) - p + kh * mu) / (len(hosts[h]) - 1 + kh)
        pp = (sum(paths[h, k]) - p + kp * ph) / (len(paths[h, k]) - 1 + kp)
        lo = lambda q: math.log(q / (1 - q))
        out[i] = (ph, pp, 1 / (1 + math.exp(-(lo(p) + lo(pp) - lo(mu)))))
    return out


def test_posteriors(spark):
    rows = [(i, f"h{i % 5}", f"p{i % 3}", (0.9 if i % 5 < 3 else 0.3) + (i * 7 % 11 - 5) / 100) for i in range(120)] + [(900, "rare", "p", 0.6)]
    got = {r.doc_id: (r.p_host, r.p_path, r.score) for r in Q.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i])
    mu = sum(r[3] for r in rows) / len(rows)
    assert abs(got[900][0] - mu) < 0.02  # a site of one document has nothing but the prior


def test_held_out_accuracy(spark):
    rows, labels = planted(900)
    docs = spark.createDataFrame([(i, t, "h" + "ab"[q], "x") for (i, t), (_, q, _) in zip(rows, labels, strict=True)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.quality for r in Q.classify(docs, spark.createDataFrame(labels[:500], LABELS)).collect()}
    assert sum(got[i] == q for i, q, _ in labels[500:]) > 0.98 * 400


def test_awkward(spark):
    docs = awkward(spark)
    for labels in ([], [(1, 1, 0), (4, None, 1), (None, 1, 1)], [(i, i % 2, 0) for i in range(10, 40)]):
        known = spark.createDataFrame(labels, LABELS)
        assert len(Q.classify(docs, known).collect()) == docs.count()
        assert Q.classify(empty(spark), known).collect() == []
