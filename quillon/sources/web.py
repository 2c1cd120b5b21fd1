"""HTTP sources: formats, racing addresses, pages, credentials from the environment, and answers kept for a while."""

from __future__ import annotations

import base64
import gzip
import os
import re
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession

from ..errors import TsqlError
from . import files, infer, shapes

KEEP_SECONDS, MOST_PAGES, MOST_ROWS, PER_HOST, TIMEOUT = 300, 50, 100_000, 4, 30
_slots: dict[str, threading.Semaphore] = {}


def from_environment(value: str) -> str:
    """${NAME} is taken from the environment; nothing else may carry a secret."""

    def of(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise TsqlError(50001, f"The environment has no {m[1]}.")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", of, value)


def signed(url: str, headers: dict, auth: dict | None, hosts: list[str]) -> tuple[str, dict]:
    """The address and headers with credentials, for their own hosts only."""
    if not auth or urllib.parse.urlsplit(url).hostname not in hosts:
        return url, headers
    kind = auth.get("type")
    if kind == "bearer":
        return url, headers | {"Authorization": f"Bearer {from_environment(auth['token'])}"}
    if kind == "basic":
        pair = f"{from_environment(auth['user'])}:{from_environment(auth['password'])}".encode()
        return url, headers | {"Authorization": "Basic " + base64.b64encode(pair).decode()}
    if kind == "header":
        return url, headers | {auth["name"]: from_environment(auth["value"])}
    if kind == "query":
        mark = "&" if "?" in url else "?"
        return f"{url}{mark}{urllib.parse.urlencode({auth['name']: from_environment(auth['value'])})}", headers
    raise TsqlError(50001, f"{kind} is not a kind of credentials.")


def fetch(url: str, auth: dict | None = None, hosts: list[str] | None = None, timeout: float = TIMEOUT) -> bytes:
    host = urllib.parse.urlsplit(url).hostname or ""
    own, headers = signed(url, {"Accept-Encoding": "gzip", "User-Agent": "quillon"}, auth, hosts if hosts is not None else [host])
    with _slots.setdefault(host, threading.Semaphore(PER_HOST)):
        try:
            with urllib.request.urlopen(urllib.request.Request(own, headers=headers), timeout=timeout) as r:
                data = r.read()
                return gzip.decompress(data) if r.headers.get("Content-Encoding") == "gzip" else data
        except (urllib.error.URLError, TimeoutError, OSError) as e:
            raise TsqlError(50001, f"{url} can't be read: {e}") from None


def raced(urls: list[str], get=fetch) -> tuple[str, bytes]:
    """The first address that answers well."""
    pool = ThreadPoolExecutor(len(urls))
    try:
        jobs, last = {pool.submit(get, u): u for u in urls}, None
        while jobs:
            done, _ = wait(jobs, return_when=FIRST_COMPLETED)
            for j in done:
                url = jobs.pop(j)
                if (last := j.exception()) is None:
                    return url, j.result()
        raise last
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class HttpSource:
    """Tables of one address, or of several that race. Answers are kept; an old one is served while a new one is fetched.
    notices: what a client should know of the last answer."""

    def __init__(self, spark: SparkSession, name: str, options: dict) -> None:
        self.spark, self.name, self.o = spark, name, options
        self.urls = [options["url"]] if isinstance(options["url"], str) else list(options["url"])
        self.hosts = options.get("credential_hosts") or [urllib.parse.urlsplit(self.urls[0]).hostname]
        self._at, self._tables, self._lock = 0.0, None, threading.Lock()
        self.notices: list[str] = []

    def load(self) -> dict[str, DataFrame]:
        with self._lock:
            if self._tables is None:
                self._refresh()
            elif time.monotonic() - self._at > self.o.get("cache_seconds", KEEP_SECONDS):
                self._at = time.monotonic()
                threading.Thread(target=self._refresh, daemon=True).start()
            return self._tables

    def _refresh(self) -> None:
        before = self._tables
        try:
            self._tables, self._at = self._read(), time.monotonic()
        except TsqlError as e:
            if before is None:
                raise
            self.notices = [f"{self.name}: the answer before is shown: {e.message}"]

    def _get(self, url: str) -> bytes:
        return fetch(url, self.o.get("auth"), self.hosts, float(self.o.get("timeout", TIMEOUT)))

    def _read(self) -> dict[str, DataFrame]:
        self.notices = []
        url, data = raced(self.urls, self._get)
        kind = self.o.get("format") or files.sniff(data)
        if kind == "html":
            return {n: infer.from_records(self.spark, r, True) for n, r in files.html_tables(files.decoded(data)).items()}
        if kind == "xml":
            return shapes.tables(self.spark, files.xml_document(data), **self._shape())
        if kind == "csv":
            import csv as reader

            rows = list(reader.DictReader(files.decoded(data).splitlines(), delimiter=self.o.get("delimiter", ",")))
            return {"": infer.from_records(self.spark, [{k: v or None for k, v in r.items()} for r in rows], True)}
        import json

        documents = [json.loads(files.decoded(data))]
        documents += self._pages(url, documents[0])
        shape = self._shape()
        if len(documents) == 1:
            return shapes.tables(self.spark, documents[0], **shape)
        rows: list[dict] = []
        for d in documents:
            path, how = shape.get("path"), shape.get("records", "auto")
            d = shapes.at_path(d, path) if path else d
            if how == "auto":
                _, where, how = shapes.detected(d)[0]
                d = shapes.at_path(d, where)
            rows += shapes.located(d, how)
            if len(rows) > self.o.get("max_rows", MOST_ROWS):
                raise TsqlError(50001, f"{self.name} has more than {self.o.get('max_rows', MOST_ROWS)} rows.")
        return shapes.tables(self.spark, rows, **{**shape, "path": None, "records": "array"})

    def _shape(self) -> dict:
        return {"name": self.name} | {k: self.o[k] for k in ("path", "records", "flatten", "expand", "columns") if k in self.o}

    def _pages(self, url: str, first: object) -> list:
        """The further pages: by links, or by counting a parameter up, several at once."""
        import json

        most, out = self.o.get("max_pages", MOST_PAGES), []
        if link := self.o.get("next"):
            document = first
            while True:
                try:
                    following = shapes.at_path(document, link)
                except TsqlError:
                    break
                if not following:
                    break
                if len(out) + 1 >= most:
                    self._stopped(most)
                    break
                document = json.loads(files.decoded(self._get(urllib.parse.urljoin(url, str(following)))))
                out.append(document)
        elif paging := self.o.get("paging"):
            name, step, at = paging["parameter"], paging.get("step", 1), paging.get("start", 1)
            with ThreadPoolExecutor(PER_HOST) as pool:
                while True:
                    if len(out) + 1 >= most:
                        more = json.loads(files.decoded(self._get(f"{url}{'&' if '?' in url else '?'}{name}={at + step * (len(out) + 1)}")))
                        if self._is_full(more):
                            self._stopped(most)
                        break
                    own = [f"{url}{'&' if '?' in url else '?'}{name}={at + step * (len(out) + 1 + i)}" for i in range(min(PER_HOST, most - 1 - len(out)))]
                    got = [json.loads(files.decoded(b)) for b in pool.map(self._get, own)]
                    full = [d for d in got if self._is_full(d)]
                    out += full
                    if len(full) < len(got):
                        break
        return out

    @staticmethod
    def _is_full(document: object) -> bool:
        """Whether a page has rows."""
        found = shapes.detected(document)
        return bool(found) and found[0][2] == "array"

    def _stopped(self, most: int) -> None:
        self.notices.append(f"{self.name}: reading stopped after {most} pages, and there are more; raise max_pages to read further.")
