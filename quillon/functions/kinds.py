"""Kinds of values and how they meet: the static types of expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import TsqlError

#: From the lowest precedence to the highest.
LADDER = ("null", "binary", "text", "guid", "bit", "tinyint", "smallint", "int", "bigint", "float", "datetime")
WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMBER = (*WHOLE, "float")
SPARK = {
    "null": "INT", "binary": "BINARY", "text": "STRING", "guid": "STRING", "bit": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT",
    "int": "INT", "bigint": "BIGINT", "float": "DOUBLE", "datetime": "TIMESTAMP_NTZ",
}
#: The names that messages and metadata use.
NAMES = {"null": "int", "text": "nvarchar", "guid": "uniqueidentifier", "binary": "varbinary"}
COLLATION = "UTF8_LCASE_RTRIM"


@dataclass(frozen=True)
class Kind:
    name: str
    places: int | None = None  # decimals of a written or cast decimal, which computes as a float
    narrow: bool = False
    money: bool = False

    @property
    def spark(self) -> str:
        return SPARK[self.name]

    @property
    def shown(self) -> str:
        return NAMES.get(self.name, self.name)

    @property
    def number(self) -> bool:
        return self.name in NUMBER

    @property
    def whole(self) -> bool:
        return self.name in WHOLE

    @property
    def text(self) -> bool:
        return self.name in ("text", "guid")


NULL, TEXT, BIT, INT, BIGINT, FLOAT, DATETIME, TINYINT, SMALLINT, BINARY = map(Kind, ("null", "text", "bit", "int", "bigint", "float", "datetime", "tinyint", "smallint", "binary"))


@dataclass(frozen=True)
class Ex:
    """A lowered expression: its Spark SQL and kind; value is set for literals (a Python value)."""

    sql: str
    kind: Kind
    value: object = None
    constant: bool = False

    def of(self, kind: Kind) -> Ex:
        return replace(self, kind=kind)


def highest(kinds: list[Kind]) -> Kind:
    """The kind that values of these kinds settle on."""
    found = [k for k in kinds if k.name != "null"]
    if not found:
        return NULL
    top = max(found, key=lambda k: LADDER.index(k.name))
    if any(k.name == "binary" for k in found) and any(k.name in ("float", "datetime", "guid") for k in found):
        raise TsqlError(206, f"Operand type clash: varbinary is incompatible with {top.shown}")
    places = [k.places for k in found if k.places is not None]
    return Kind(top.name, max(places) if places and top.name == "float" else None, all(k.narrow for k in found) and top.text, any(k.money for k in found) and top.name == "float")


def of_spark(data_type) -> Kind:
    """The kind of a Spark column."""
    name = data_type.simpleString()
    if name.startswith("decimal"):
        return Kind("float", int(name[:-1].split(",")[1]))
    if name.startswith(("string", "varchar", "char")):
        return TEXT
    return {
        "tinyint": SMALLINT, "smallint": SMALLINT, "int": INT, "bigint": BIGINT, "float": FLOAT, "double": FLOAT, "boolean": BIT, "timestamp_ntz": DATETIME,
        "timestamp": DATETIME, "date": DATETIME, "binary": BINARY, "void": NULL,
    }.get(name, TEXT)


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def ci(e: Ex | str) -> str:
    """Text under the server's collation: case and trailing blanks don't count."""
    return f"({e.sql if isinstance(e, Ex) else e} COLLATE {COLLATION})"


def binary(sql: str) -> str:
    return f"({sql} COLLATE UTF8_BINARY)"


def fail(number: int, message: str, spark_type: str) -> str:
    return f"CAST(raise_error({quoted(f'#{number}#{message}#')}) AS {spark_type})"
