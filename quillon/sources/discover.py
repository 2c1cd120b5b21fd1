"""Sources of an API that are found from its base address: an OpenAPI document, an index of links, or usual names."""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from ..errors import TsqlError
from . import files
from .web import TIMEOUT, HttpSource, fetch

#: Requests in all, levels of links, and requests at a time (each host has its own bound too).
MOST_REQUESTS, DEEPEST, TOGETHER = 120, 3, 12
#: Where API descriptions usually lie, and what collections are usually called.
DESCRIPTIONS = ("openapi.json", "swagger.json", "v3/api-docs", "api-docs", "swagger/v1/swagger.json")
USUAL = ("users", "posts", "comments", "products", "orders", "items", "customers", "events", "todos", "albums", "photos", "categories")


def discovered(spark: SparkSession, name: str, options: dict) -> list[tuple[str, HttpSource]]:
    """(table, source) of each collection that the base addresses have, in the order in which they are described."""
    bases = options["discover"] if isinstance(options["discover"], list) else [options["discover"]]
    out, left, lock = [], options.get("max_requests", MOST_REQUESTS), threading.Lock()
    rest = {k: v for k, v in options.items() if k in ("auth", "credential_hosts", "flatten", "expand", "format", "max_pages", "max_rows", "next", "paging", "cache_seconds", "columns", "timeout")}

    def get(url: str) -> object | None:
        nonlocal left
        with lock:
            if left <= 0:
                return None
            left -= 1
        try:
            return json.loads(files.decoded(fetch(url, options.get("auth"), options.get("credential_hosts"), float(options.get("timeout", TIMEOUT)))))
        except (TsqlError, ValueError):
            return None

    with ThreadPoolExecutor(TOGETHER) as pool:
        every = lambda urls: list(pool.map(get, urls))
        for base in bases:
            base = base.rstrip("/") + "/"
            found = _described(base, every) or _linked(base, every, options.get("depth", DEEPEST))
            if not found:
                places = [urllib.parse.urljoin(base, n) for n in USUAL]
                found = [(n, u) for n, u, d in zip(USUAL, places, every(places), strict=True) if d is not None]
            out += [(f"{options.get('prefix', '')}{n}", HttpSource(spark, n, {"url": u, **rest})) for n, u in found]
    return out


def _described(base: str, every: Callable) -> list[tuple[str, str]]:
    for d in every([urllib.parse.urljoin(base, place) for place in DESCRIPTIONS]):
        if isinstance(d, dict) and isinstance(d.get("paths"), dict):
            servers = d.get("servers") or [{}]
            root = urllib.parse.urljoin(base, servers[0].get("url") or d.get("basePath") or "").rstrip("/")
            return [(p.strip("/").replace("/", "_"), root + p) for p, ops in d["paths"].items() if "{" not in p and isinstance(ops, dict) and "get" in ops and p.strip("/")]
    return []


def _linked(base: str, every: Callable, depth: int) -> list[tuple[str, str]]:
    """The addresses that an index names, followed level by level where they name further ones."""
    host, out, seen, level = urllib.parse.urlsplit(base).netloc, [], {base}, [base]
    for n in range(depth):
        following = []
        for d in every(level):
            links = {k: v for k, v in d.items() if isinstance(v, str) and v.startswith("http") and "{" not in v} if isinstance(d, dict) else {}
            if len(links) < 2 and n:
                continue
            for k, v in links.items():
                if urllib.parse.urlsplit(v).netloc == host and v not in seen and v.rstrip("/") != base.rstrip("/"):
                    seen.add(v)
                    out.append((k, v))
                    following.append(v)
        level = following
    return out
