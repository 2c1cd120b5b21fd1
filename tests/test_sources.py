import json

import pytest

from quillon import Engine, TsqlError
from quillon.queries import example_workbook
from quillon.sources import config, files, infer, shapes


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_inference_keeps_what_reading_would_lose(spark):
    data = [("1", "007", "1.5", "9999999999", "12345678901234567890", "-0", "x", None), ("-2", "1", "78", "2", "1", "1", None, None)]
    df = infer.typed(spark.createDataFrame(data, "a string, b string, c string, d string, e string, f string, g string, h string"))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double", "d": "bigint", "e": "string", "f": "double", "g": "string", "h": "string"}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid;name\n1;"a;b\nc"\n2;\n')
    df = files.csv(spark, f"file://{tmp_path}/a.csv", ";")
    assert df.columns == ["id", "name"] and rows(df) == [(1, "a;b\nc"), (2, None)]
    (tmp_path / "b.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(TsqlError):
        rows(files.csv(spark, f"file://{tmp_path}/b.csv"))


def test_json_shapes(spark):
    of = lambda d, **o: rows(shapes.tables(spark, d, **o)[""])
    assert of({"count": 2, "results": [{"n": 1}, {"n": 2, "t": "x"}]}) == [(1, None), (2, "x")]
    assert of({"oak": 41, "elm": 27, "ash": 19}) == [("oak", 41), ("elm", 27), ("ash", 19)]
    assert of({"lat": [52.0, 48.5], "sky": ["fog", "sun"]}) == [(52.0, "fog"), (48.5, "sun")]
    assert of([{"page": 1}, [{"country": {"id": "x"}, "v": 1}]], path="1") == [("x", 1)]
    assert of({"a": {"b": 1}}, records="json") == [(json.dumps({"a": {"b": 1}}),)]
    with pytest.raises(TsqlError):
        of({"error": "no"})


def test_children(spark):
    walks = [{"id": 1, "stops": [{"at": "mill", "photos": [{"px": 640}]}, {"at": "weir"}]}, {"id": 2, "stops": []}]
    t = shapes.tables(spark, walks, name="walks", expand=True)
    assert set(t) == {"", "walks_stops", "walks_stops_photos"}
    assert rows(t["walks_stops"].select("walks_id", "stops_index", "at")) == [(1, 0, "mill"), (1, 1, "weir")]


def test_xml_and_html(spark):
    d = files.xml_document(b'<r xmlns:x="u"><i a="1"><x:n>p</x:n></i><i a="2"><x:n>q</x:n></i></r>')
    assert rows(shapes.tables(spark, d)[""]) == [("1", "p"), ("2", "q")]
    with pytest.raises(TsqlError):
        files.xml_document(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    t = files.html_tables("<table><tr><td>layout</td></tr></table><table><caption>T</caption><tr><th>a<th colspan=2>b</tr><tr><td>1<td>2<td>3</tr></table>")
    assert t == {"T": [{"a": "1", "b": "2", "b_": "3"}]}


def test_workbook(spark):
    df = infer.from_records(spark, files.workbook(example_workbook())["People"])
    assert [k for _, k in df.dtypes] == ["string", "timestamp_ntz", "double"] and df.count() == 4


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"city": "Oslo", "pop": 1}, {"city": "Rome", "pop": 3}]))
    e = config.load(Engine(spark), {"sources": {"cities": {"json": f"file://{tmp_path}/c.json", "columns": ["city"]}}})
    assert rows(e.query("SELECT * FROM cities WHERE city = 'rome'")) == [("Rome",)]
    with pytest.raises(TsqlError, match="Did you mean delimiter"):
        config.load(Engine(spark), {"x": {"csv": "a.csv", "delimeter": ";"}})
    with pytest.raises(TsqlError):
        config.load(Engine(spark), {"x": {"access": "a.mdb"}})


def test_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.partition("page=")[2] or 1)
            body = json.dumps({"next": f"/users?page={n + 1}" if n < 3 else None, "results": [{"id": 10 * n + i, "ok": self.headers.get("Authorization")} for i in range(2)]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    import os

    os.environ["QUILLON_TEST_TOKEN"] = "t"
    url = f"http://127.0.0.1:{server.server_port}/users"
    e = config.load(Engine(spark), {"users": {"url": ["http://127.0.0.1:1/none", url], "next": "next", "auth": {"type": "bearer", "token": "${QUILLON_TEST_TOKEN}"}, "credential_hosts": ["127.0.0.1"]}})
    assert sorted(rows(e.query("SELECT id, ok FROM users"))) == [(10 * n + i, "Bearer t") for n in (1, 2, 3) for i in range(2)]
    server.shutdown()


def test_discovered_children(spark, monkeypatch):
    from quillon.sources import discover, web

    source = web.HttpSource(spark, "users", {"url": "http://x.example/users", "expand": True})
    monkeypatch.setattr(web, "raced", lambda urls, get: (urls[0], json.dumps([{"id": 1, "tags": ["a", "b"]}, {"id": 2, "tags": []}]).encode()))
    monkeypatch.setattr(discover, "discovered", lambda *a: [("api_users", source)])
    e = config.load(Engine(spark), {"api": {"discover": "http://x.example", "expand": True, "prefix": "api_"}})
    assert sorted(rows(e.query("SELECT users_id, value FROM api_users_tags"))) == [(1, "a"), (1, "b")] and e.query("SELECT id FROM api_users").count() == 2
