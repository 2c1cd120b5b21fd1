"""The first rows of each outer row, by sort keys that are not selected, where sorts spill and rows keep no order of their own."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
OWNERS, EACH = 30, 60
SQL = {
    "apply": "SELECT w.k, x.id FROM owners w CROSS APPLY (SELECT TOP 2 t.id FROM things t WHERE t.owner = w.k ORDER BY t.worth DESC, t.id) x",
    "outer": "SELECT w.k, x.id FROM owners w OUTER APPLY (SELECT TOP 1 t.id FROM things t WHERE t.owner = w.k ORDER BY t.worth, t.id) x",
    "fetch": "SELECT w.k, x.id FROM owners w CROSS APPLY (SELECT t.id FROM things t WHERE t.owner = w.k ORDER BY t.worth DESC, t.id OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY) x",
    "scalar": "SELECT w.k, (SELECT TOP 1 t.id FROM things t WHERE t.owner = w.k ORDER BY t.worth DESC, t.id) AS id FROM owners w",
    "within": "SELECT o.owner, o.id FROM things o WHERE o.id IN (SELECT TOP 2 t.id FROM things t WHERE t.owner = o.owner ORDER BY t.worth DESC, t.id)",
    "grouped": "SELECT w.k, x.sort FROM owners w CROSS APPLY (SELECT TOP 1 t.sort FROM things t WHERE t.owner = w.k GROUP BY t.sort ORDER BY SUM(t.worth) DESC, t.sort) x",
}
RUN = """
import json, sys
from pyspark.sql import SparkSession
from quillon import Engine
given = json.load(sys.stdin)
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.shuffle.spill.numElementsForceSpillThreshold", "20").config("spark.sql.warehouse.dir", given["warehouse"]).getOrCreate()
e = Engine(s)
e.register("owners", s.createDataFrame([(k,) for k in given["owners"]], "k int"))
e.register("things", s.createDataFrame(given["things"], "id int, owner int, sort int, worth int").repartition(8, "id"))
print("found", json.dumps({n: [tuple(r) for r in e.query(q).collect()] for n, q in given["sql"].items()}))
"""


def things():
    """(id, owner, sort, worth); worths don't follow ids, and some are equal."""
    return [(i, i % OWNERS, i * 7919 % 7, i * 7919 % 1009) for i in range(OWNERS * EACH)]


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    given = {"owners": list(range(OWNERS + 1)), "things": things(), "sql": SQL, "warehouse": str(tmp_path_factory.mktemp("warehouse"))}
    out = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, input=json.dumps(given), capture_output=True, text=True, timeout=300)
    lines = [x for x in out.stdout.splitlines() if x.startswith("found ")]
    assert lines, out.stderr[-3000:]
    return {n: sorted(map(tuple, rows), key=str) for n, rows in json.loads(lines[0][6:]).items()}


@pytest.fixture(scope="module")
def wanted():
    out = {n: [] for n in SQL}
    for k in range(OWNERS + 1):  # the last has none
        own = [t for t in things() if t[1] == k]
        first = [t[0] for t in sorted(own, key=lambda t: (-t[3], t[0]))]
        least = [t[0] for t in sorted(own, key=lambda t: (t[3], t[0]))]
        sums = {s: sum(t[3] for t in own if t[2] == s) for s in {t[2] for t in own}}
        out["apply"] += [(k, i) for i in first[:2]]
        out["within"] += [(k, i) for i in first[:2]]
        out["outer"].append((k, least[0] if least else None))
        out["fetch"] += [(k, i) for i in first[1:3]]
        out["scalar"].append((k, first[0] if first else None))
        out["grouped"] += [(k, s) for s in sorted(sums, key=lambda s: (-sums[s], s))[:1]]
    return {n: sorted(rows, key=str) for n, rows in out.items()}


@pytest.mark.parametrize("name", SQL)
def test_first_rows_of_each_outer_row(found, wanted, name):
    assert found[name] == wanted[name]
