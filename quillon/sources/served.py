"""Queries over sources that a small server of this process serves, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import base64
import contextlib
import json
import os
import threading
import time
import urllib.parse
from collections import Counter
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from .. import store
from ..engine import Engine, Session
from ..errors import TsqlError
from . import config, files, shapes

ROWS, PAGE = 23, 5


class _Handler(BaseHTTPRequestHandler):
    def do_GET(self) -> None:
        at = urllib.parse.urlsplit(self.path)
        q = dict(urllib.parse.parse_qsl(at.query))
        self.server.asked[at.path] += 1
        answer = {
            "/gauges": lambda: [{"id": i, "level": i / 4, "at": {"river": f"r{i % 3}", "km": i}} for i in range(ROWS)],
            "/slow": lambda: (time.sleep(2), [{"id": -1}])[1],
            "/linked": lambda: {"next": f"/linked?page={int(q.get('page', 1)) + 1}" if int(q.get("page", 1)) * PAGE < ROWS else None, "results": self._page(q)},
            "/counted": lambda: self._page(q),
            "/private": lambda: [{"seen": self.headers.get("Authorization") or self.headers.get("X-Key") or q.get("key") or "nothing"}],
            "/turn": lambda: [{"turn": self.server.asked["/turn"]}],
            "/api/openapi.json": lambda: {"paths": {"/rivers": {"get": {}}, "/locks/old": {"get": {}}, "/broken": {"get": {}}, "/rivers/{id}": {"get": {}}, "/orders": {"post": {}}}, "servers": [{"url": "/api"}]},
            "/api/rivers": lambda: {"items": [{"id": i, "towns": [{"name": f"t{i}{k}"} for k in range(i)]} for i in range(1, 4)]},
            "/api/locks/old": lambda: [{"lock": f"l{i}"} for i in range(4)],
            "/sheet": lambda: "a;b\n1;x\n2;\n",
        }.get(at.path)
        body = answer() if answer else None
        self.send_response(200 if answer else 404)
        self.end_headers()
        self.wfile.write((body if isinstance(body, str) else json.dumps(body)).encode())

    def _page(self, q: dict) -> list:
        first = (int(q.get("page", 1)) - 1) * PAGE
        return [{"id": i} for i in range(first, min(ROWS, first + PAGE))]

    def log_message(self, *args) -> None:
        pass


@contextlib.contextmanager
def served() -> Iterator[tuple[str, Counter]]:
    """The address of the server, and how often each place was asked for."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    server.asked = Counter()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", server.asked
    finally:
        server.shutdown()


def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    with served() as (url, _):
        e = config.load(Engine(spark), {"gauges": {"url": f"{url}/gauges"}, "sheet": {"url": f"{url}/sheet", "delimiter": ";", "format": "csv"}})
        return e.query("SELECT g.id, g.level, [at.river] AS river, s.b FROM gauges g LEFT JOIN sheet s ON s.a = g.id WHERE [at.km] < 20")


def _race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three addresses that answers: one refuses, one is slow."""
    with served() as (url, _):
        e = config.load(Engine(spark), {"g": {"url": ["http://127.0.0.1:1/none", f"{url}/slow", f"{url}/gauges"], "columns": ["id"]}})
        return e.query("SELECT COUNT(*) AS n, MIN(id) AS low FROM g")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by links and by a counted parameter; a limit of pages is told."""
    with served() as (url, _):
        few = {"url": f"{url}/linked", "next": "next", "max_pages": 2}
        e = config.load(Engine(spark), {"a": {"url": f"{url}/linked", "next": "next"}, "b": {"url": f"{url}/counted", "paging": {"parameter": "page"}}, "c": few, "d": {"url": f"{url}/counted", "paging": {"parameter": "page"}, "max_pages": 3}})
        told = [len(e.answer(f"SELECT id FROM {t}", session=Session(e)).messages) for t in "abcd"]
        values = ", ".join(f"('{t}', {n})" for t, n in zip("abcd", told, strict=True))
        return e.query(f"SELECT x.t, x.id, v.told FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{t}{chr(39)} AS t, id FROM {t}' for t in 'abcd')}) x JOIN (VALUES {values}) v(t, told) ON v.t = x.t")


def _auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials come from the environment and go to their own hosts only."""
    os.environ |= {"QUILLON_SERVED_USER": "u", "QUILLON_SERVED_SECRET": "s3"}
    secret = "${QUILLON_SERVED_SECRET}"
    kinds = {
        "bearer": {"type": "bearer", "token": secret}, "basic": {"type": "basic", "user": "${QUILLON_SERVED_USER}", "password": secret}, "header": {"type": "header", "name": "X-Key", "value": secret}, "query": {"type": "query", "name": "key", "value": secret},
    }
    with served() as (url, _):
        of = {k: {"url": f"{url}/private", "auth": v, "credential_hosts": ["127.0.0.1"]} for k, v in kinds.items()}
        e = config.load(Engine(spark), of | {"other": {"url": f"{url}/private", "auth": kinds["bearer"], "credential_hosts": ["elsewhere.example"]}})
        return e.query(" UNION ALL ".join(f"SELECT '{k}' AS k, seen FROM [{k}]" for k in (*kinds, "other")))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose answer is old is asked for anew: the old one is served meanwhile."""
    with served() as (url, asked):
        e = config.load(Engine(spark), {"kept": {"url": f"{url}/gauges"}, "turn": {"url": f"{url}/turn", "cache_seconds": 0}})
        first = e.query("SELECT turn FROM turn").first().turn
        for _ in range(200):
            if e.query("SELECT turn FROM turn").first().turn > first:
                break
            time.sleep(0.05)
        later = e.query("SELECT turn FROM turn").first().turn
        for _ in range(3):
            e.query("SELECT COUNT(*) AS n FROM kept").collect()
        return spark.createDataFrame([(first, int(later > first), asked["/gauges"])], "first int, newer int, kept int")


def _discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    with served() as (url, _):
        e = config.load(Engine(spark), {"api": {"discover": f"{url}/api", "prefix": "w_", "expand": True}})
        e.register("told", spark.createDataFrame([(len(e.notices),)], "told int"))
        return e.query("SELECT r.id, t.name, (SELECT COUNT(*) FROM w_locks_old) AS locks, (SELECT told FROM told) AS told FROM w_rivers r JOIN w_rivers_towns t ON t.rivers_id = r.id")


def _file(spark: SparkSession, document: object) -> str:
    return store.write_lines(spark, [document if isinstance(document, str) else json.dumps(document)])


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a path, by detection of each shape, and by named columns."""
    deep = [{"page": 1}, {"data": {"rows": [{"id": i, "v": {"x": i * 2, "y": "n"}, "z": 0} for i in range(4)]}}]
    e = config.load(Engine(spark), {
        "path": {"json": _file(spark, deep), "path": "1.data.rows", "columns": ["v.x", "id"]}, "found": {"json": _file(spark, {"meta": {"n": 2}, "rows": [{"id": 7}, {"id": 8}]})},
        "one": {"json": _file(spark, {"id": 5, "t": "x"}), "records": "single"}, "vals": {"json": _file(spark, {"a": {"id": 1}, "b": {"id": 2}}), "records": "values"}, "plain": {"json": _file(spark, [3, 4]), "records": "scalars"},
    })
    return e.query("SELECT 'path' AS k, id * 100 + [v.x] AS v FROM path UNION ALL SELECT 'found', id FROM found UNION ALL SELECT 'one', id FROM one UNION ALL SELECT 'vals', id FROM vals UNION ALL SELECT 'plain', value FROM plain")


def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document is taken for, and each file by its first bytes."""
    documents = {"array": [{"a": 1}], "envelope": {"n": 1, "items": [{"a": 1}]}, "entries": {"x": 1.5, "y": 2.5, "z": 3.5}, "columns": {"p": [1, 2], "q": [3, 4]}, "scalars": [1, 2, 3]}
    out = [(n, (found := shapes.detected(d))[0][2] + ":" + found[0][1]) for n, d in documents.items()]
    starts = {"json": b' {"a": 1}', "xml": b"<?xml version='1.0'?><a/>", "html": b"<!doctype html><p>", "csv": b"a,b\n1,2\n"}
    return spark.createDataFrame(out + [(f"file {n}", files.sniff(b)) for n, b in starts.items()], "k string, v string")


def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration in a file, and the settings that are refused, with what may have been meant."""
    csv = _file(spark, "a|b\n1|x\n2|y")
    e = config.load(Engine(spark), _file(spark, {"sources": {"pairs": {"csv": csv, "delimiter": "|"}, "nations": {"parquet": f"{sf_dir}/nation.parquet"}}}))
    bad, told = ({"csv": csv, "delimeter": ";"}, {"what": 1}, {"access": "a.mdb"}, {"json": _file(spark, {"error": "no"})}), []
    for b in bad:
        try:
            config.load(Engine(spark), {"t": b})
            told.append("taken")
        except TsqlError as x:
            told.append(f"{x.number}{' meant' if 'Did you mean delimiter' in x.message else ''}")
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(told))
    return e.query(f"SELECT v.i, v.told, p.b, (SELECT COUNT(*) FROM nations) AS n FROM (VALUES {values}) v(i, told) LEFT JOIN pairs p ON p.a = v.i")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src_http": _http, "src_http_race": _race, "src_http_page": _pages, "src_http_auth": _auth, "src_http_live": _live, "src_discover": _discover, "src_path": _shapes, "src_detect": _detect, "src_config": _config,
}
ORACLE_SQL: dict[str, str] = {
    "src_http": "SELECT CAST(i AS INT) AS id, i / 4 AS level, 'r' || (i % 3) AS river, CASE WHEN i = 1 THEN 'x' END AS b FROM range(0, 20) t(i)", "src_http_race": f"SELECT {ROWS} AS n, 0 AS low",
    "src_http_page": f"SELECT t, CAST(i AS INT) AS id, told FROM (VALUES ('a', {ROWS}, 0), ('b', {ROWS}, 0), ('c', {2 * PAGE}, 1), ('d', {3 * PAGE}, 1)) v(t, n, told) JOIN range(0, {ROWS}) r(i) ON i < n",
    "src_http_auth": f"SELECT * FROM (VALUES ('bearer', 'Bearer s3'), ('basic', 'Basic {base64.b64encode(b'u:s3').decode()}'), ('header', 's3'), ('query', 's3'), ('other', 'nothing')) v(k, seen)",
    "src_http_live": "SELECT 1 AS first, 1 AS newer, 1 AS kept", "src_discover": "SELECT CAST(i AS INT) AS id, 't' || i || k AS name, 4 AS locks, 1 AS told FROM range(1, 4) a(i) JOIN range(0, 3) b(k) ON k < i",
    "src_path": "SELECT * FROM (VALUES ('path', 0), ('path', 102), ('path', 204), ('path', 306), ('found', 7), ('found', 8), ('one', 5), ('vals', 1), ('vals', 2), ('plain', 3), ('plain', 4)) v(k, v)".replace("SELECT *", "SELECT k, CAST(v AS BIGINT) AS v"),
    "src_detect": "SELECT * FROM (VALUES ('array', 'array:'), ('envelope', 'array:items'), ('entries', 'entries:'), ('columns', 'columns:'), ('scalars', 'scalars:'), ('file json', 'json'), ('file xml', 'xml'), ('file html', 'html'), ('file csv', 'csv')) v(k, v)",
    "src_config": "SELECT i, told, b, (SELECT CAST(count(*) AS INT) FROM nation) AS n FROM (VALUES (0, '50001 meant', NULL), (1, '50001', 'x'), (2, '50001', 'y'), (3, '50001', NULL)) v(i, told, b)",
}
