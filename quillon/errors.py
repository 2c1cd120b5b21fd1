"""Numbered errors, and the numbers of what Spark raises."""

from __future__ import annotations

import re


class TsqlError(Exception):
    """An error with its message number, severity and state."""

    def __init__(self, number: int, message: str, severity: int = 16, state: int = 1) -> None:
        super().__init__(message)
        self.number, self.message, self.severity, self.state = number, message, severity, state
        self.raised = False  # by RAISERROR, after which a batch goes on
        self.kept = False  # what the batch answered before stays

    def __str__(self) -> str:
        return f"Msg {self.number}: {self.message}"


def unsupported(what: str) -> TsqlError:
    return TsqlError(50000, f"{what} is not supported.")


#: Spark error classes, in the order in which they are looked for, with number and message.
SPARK = (
    ("DIVIDE_BY_ZERO", 8134, "Divide by zero error encountered."),
    ("REMAINDER_BY_ZERO", 8134, "Divide by zero error encountered."),
    ("CAST_INVALID_INPUT", 245, "Conversion failed."),
    ("CANNOT_PARSE_TIMESTAMP", 241, "Conversion failed when converting date and/or time from character string."),
    ("INVALID_INPUT_SYNTAX", 245, "Conversion failed."),
    ("CAST_OVERFLOW", 8115, "Arithmetic overflow error."),
    ("NUMERIC_VALUE_OUT_OF_RANGE", 8115, "Arithmetic overflow error."),
    ("ARITHMETIC_OVERFLOW", 8115, "Arithmetic overflow error."),
    ("BINARY_ARITHMETIC_OVERFLOW", 8115, "Arithmetic overflow error."),
    ("DATETIME_OVERFLOW", 517, "Adding a value to a datetime column caused an overflow."),
    ("SCALAR_SUBQUERY_TOO_MANY_ROWS", 512, "Subquery returned more than 1 value."),
)


def from_spark(error: Exception) -> TsqlError:
    """The numbered error of an exception of Spark; raise_error() carries its number as '#number#message'."""
    text = str(error)
    if m := re.search(r"#(\d+)#(.*)#", text):
        return TsqlError(int(m[1]), m[2])
    for kind, number, message in SPARK:
        if kind in text:
            if number == 245 and re.search(r'to "?(DOUBLE|TIMESTAMP_NTZ|TIMESTAMP|BIGINT)', text):
                number = {"DOUBLE": 8114, "BIGINT": 8114}.get(re.search(r'to "?(\w+)', text)[1], 241) if "STRING" in text else number
            return TsqlError(number, message)
    return TsqlError(50000, text.split("\n")[0][:500])
