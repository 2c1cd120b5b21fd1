"""The types that a file's values have: lossless or text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TsqlError

MOST_COLUMNS, LONGEST_NAME = 1024, 255
WHOLE = r"^(0|-?[1-9][0-9]*)$"
#: A spelling of a float that reading and writing keeps: at most 15 significant digits, no leading zeros or plus sign.
FLOAT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE]-?[0-9]+)?$"


def check_names(names: list[str]) -> None:
    seen = set()
    for n in names:
        if not n or len(n) > LONGEST_NAME:
            raise TsqlError(50001, f"A column's name is {'empty' if not n else 'too long'}.")
        if n.lower() in seen:
            raise TsqlError(50001, f"The column name {n} occurs more than once.")
        seen.add(n.lower())
    if len(names) > MOST_COLUMNS:
        raise TsqlError(50001, f"{len(names)} columns are more than {MOST_COLUMNS}.")


def typed(df: DataFrame) -> DataFrame:
    """Columns of strings cast to what all their values survive as: int, bigint, double, or text. One aggregation over all."""
    check_names(df.columns)
    col = lambda c: F.col(f"`{c}`")
    tests = []
    for i, c in enumerate(df.columns):
        digits = F.length(F.regexp_replace(F.regexp_replace(col(c), r"[eE].*$", ""), r"[^0-9]", ""))
        own = lambda test, c=c: F.bool_and(F.when(col(c).isNotNull(), test))
        whole = lambda kind, c=c: own(col(c).rlike(WHOLE) & col(c).try_cast(kind).isNotNull())
        tests += [whole("bigint").alias(f"w{i}"), whole("int").alias(f"i{i}"), own(col(c).rlike(FLOAT) & (digits <= 15)).alias(f"f{i}")]
    row = df.agg(*tests).first() if tests else None
    kinds = ["int" if row[f"i{i}"] else "bigint" if row[f"w{i}"] else "double" if row[f"f{i}"] else "string" for i in range(len(df.columns))]
    return df.select(*(col(c).cast(k).alias(c) for c, k in zip(df.columns, kinds, strict=True)))


def kind_of(values: list) -> T.DataType:
    """The type of a column of Python values, as they come from JSON, XML, HTML or a workbook."""
    own = [v for v in values if v is not None]
    if not own or all(isinstance(v, bool) for v in own):
        return T.StringType()
    if all(isinstance(v, datetime) for v in own):
        return T.TimestampNTZType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in own):
        top = max(map(abs, own))
        return T.IntegerType() if top < 2**31 else T.LongType() if top < 2**63 else T.StringType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in own) and all(abs(v) < 2**53 for v in own if isinstance(v, int)):
        return T.DoubleType()
    return T.StringType()


def shown(v: object, kind: T.DataType):
    import json

    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else "True" if v is True else "False" if v is False else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v.isoformat(sep=" ") if isinstance(v, datetime) else str(v)
    return float(v) if isinstance(kind, T.DoubleType) else v


def from_records(spark: SparkSession, records: list[dict], text_too: bool = False) -> DataFrame:
    """Records with columns in order of first appearance; missing keys are null. text_too reads numbers out of text."""
    names = list(dict.fromkeys(k for r in records for k in r))
    check_names(names)
    if not names:
        raise TsqlError(50001, "The source has no columns.")
    kinds = [kind_of([r.get(n) for r in records]) for n in names]
    df = spark.createDataFrame([tuple(shown(r.get(n), k) for n, k in zip(names, kinds, strict=True)) for r in records], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    return typed(df) if text_too and all(isinstance(k, T.StringType) for k in kinds) else df
