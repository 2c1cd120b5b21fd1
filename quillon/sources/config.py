"""A configuration of sources, as a dictionary or JSON file, to tables of an engine."""

from __future__ import annotations

import difflib
import json
from concurrent.futures import ThreadPoolExecutor

from ..engine import Engine
from ..errors import TsqlError
from . import files, infer, shapes
from .web import HttpSource

#: The keys of a source, by what it reads.
SHAPE = ("path", "records", "flatten", "expand", "columns")
KEYS = {
    "csv": ("delimiter",), "json": SHAPE, "xml": SHAPE, "html": (), "excel": ("sheet", "table"), "access": ("table",), "parquet": (),
    "url": (*SHAPE, "format", "delimiter", "auth", "credential_hosts", "next", "paging", "max_pages", "max_rows", "cache_seconds", "timeout"),
    "discover": ("auth", "credential_hosts", "max_requests", "depth", "prefix", "columns", "flatten", "expand", "format", "max_pages", "max_rows", "next", "paging", "cache_seconds", "timeout"),
}


def load(engine: Engine, config: dict | str) -> Engine:
    """Registers each source of {"sources": {name: {...}}} or {name: {...}}."""
    if isinstance(config, str):
        config = json.loads(files.decoded(files.read_bytes(engine.spark, config)))
    for name, options in config.get("sources", config).items():
        add(engine, name, options)
    return engine


def add(engine: Engine, name: str, options: dict) -> None:
    spark = engine.spark
    kind = next((k for k in KEYS if k in options), None)
    if kind is None:
        raise TsqlError(50001, f"The source {name} doesn't say what it reads: one of {', '.join(KEYS)}.")
    for key in options:
        if key != kind and key not in KEYS[kind]:
            near = difflib.get_close_matches(key, KEYS[kind], 1)
            raise TsqlError(50001, f"{key} is not a setting of {name}." + (f" Did you mean {near[0]}?" if near else ""))
    rest = {k: v for k, v in options.items() if k != kind}
    put = lambda found: [engine.register(n if n.startswith(name) else f"{name}_{n}" if n else name, df) for n, df in found.items()]
    if kind == "csv":
        engine.register(name, files.csv(spark, options["csv"], options.get("delimiter", ",")))
    elif kind == "parquet":
        engine.register(name, spark.read.parquet(options["parquet"]))
    elif kind == "json":
        put(files.json_tables(spark, files.read_bytes(spark, options["json"]), name=name, **rest))
    elif kind == "xml":
        put(shapes.tables(spark, files.xml_document(files.read_bytes(spark, options["xml"])), name=name, **rest))
    elif kind == "html":
        found = files.html_tables(files.decoded(files.read_bytes(spark, options["html"])))
        put({n if len(found) > 1 else "": infer.from_records(spark, r, True) for n, r in found.items()})
    elif kind == "excel":
        found = files.workbook(files.read_bytes(spark, options["excel"]))
        wanted = options.get("table") or options.get("sheet")
        if wanted and wanted not in found:
            raise TsqlError(50001, f"The workbook has no {wanted}.")
        found = {wanted: found[wanted]} if wanted else found
        put({n if len(found) > 1 else "": infer.from_records(spark, r) for n, r in found.items()})
    elif kind == "access":
        raise TsqlError(50001, "Access databases are not supported: no reader for them is at hand.")
    elif kind == "url":
        _live(engine, name, HttpSource(spark, name, options))
    else:
        from .discover import TOGETHER, discovered

        found = [(own, s) for own, s in discovered(spark, name, options) if own.lower() not in engine.tables]  # named ones come before discovered ones

        def loaded(source: HttpSource) -> TsqlError | None:
            try:
                source.load()
            except TsqlError as e:
                return e

        with ThreadPoolExecutor(TOGETHER) as pool:
            for (own, source), error in zip(found, list(pool.map(loaded, [s for _, s in found])), strict=True):
                if error is None:
                    _live(engine, own, source)
                else:
                    engine.notices.append(f"{own} was found but can't be read: {error.message}")


def _live(engine: Engine, name: str, source: HttpSource) -> None:
    """The tables of a source, each of which is asked for anew when a statement names it; the source keeps its answers."""
    for n in source.load():
        own = name + n.removeprefix(source.name) if n.startswith(source.name) else f"{name}_{n}" if n else name
        if own.lower() not in engine.tables:
            engine.register_live(own, lambda n=n: source.load().get(n), lambda: source.notices)
