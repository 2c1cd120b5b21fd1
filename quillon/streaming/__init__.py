"""Queries over streams: a streaming DataFrame is registered like any table, and a query over it is a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine


def stream_query(engine: Engine, sql: str, streams: dict[str, DataFrame]) -> DataFrame:
    """sql over tables of which some are streams; write the result with writeStream.

    Filters, projections, joins with tables and grouped aggregates run continuously. What needs all rows at once - TOP,
    ORDER BY, windows - Spark refuses on a stream.
    """
    for name, df in streams.items():
        engine.register(name, df)
    return engine.query(sql)
