"""Dates: parts, spellings, differences by boundaries, and styles."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from .kinds import quoted

#: The parts with their abbreviations.
PARTS = {
    **dict.fromkeys(("year", "yy", "yyyy"), "year"), **dict.fromkeys(("quarter", "qq", "q"), "quarter"), **dict.fromkeys(("month", "mm", "m"), "month"),
    **dict.fromkeys(("dayofyear", "dy", "y"), "dayofyear"), **dict.fromkeys(("day", "dd", "d"), "day"), **dict.fromkeys(("week", "wk", "ww"), "week"),
    **dict.fromkeys(("weekday", "dw", "w"), "weekday"), **dict.fromkeys(("hour", "hh"), "hour"), **dict.fromkeys(("minute", "mi", "n"), "minute"),
    **dict.fromkeys(("second", "ss", "s"), "second"), **dict.fromkeys(("millisecond", "ms"), "millisecond"),
}
EPOCH = "TIMESTAMP_NTZ'1900-01-01 00:00:00'"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_time = r"(?:[T ]+(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:[.:](\d{1,7}))?)?)?\s*([ap]m)?)?\s*Z?"
_forms = (
    (re.compile(rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_time}", re.I), (1, 2, 3)), (re.compile(rf"(\d{{4}})(\d\d)(\d\d){_time}", re.I), (1, 2, 3)),
    (re.compile(rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_time}", re.I), (3, 1, 2)), (re.compile(rf"([a-z]{{3,9}})\.? +(\d{{1,2}}),? +(\d{{4}}){_time}", re.I), (3, 1, 2)),
    (re.compile(rf"(\d{{1,2}}) +([a-z]{{3,9}})\.?,? +(\d{{4}}){_time}", re.I), (3, 2, 1)),
)
_only_time = re.compile(r"(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:[.:](\d{1,7}))?)?)?\s*([ap]m)?", re.I)


def parse(text: str) -> datetime | None:
    """A moment from one of the spellings that a server accepts; blank is day 0, a time alone is of day 0."""
    text = text.strip()
    if not text:
        return datetime(1900, 1, 1)
    for form, (y, m, d) in _forms:
        if (g := form.fullmatch(text)) is None:
            continue
        month = g[m]
        month = int(month) if month.isdigit() else MONTHS.index(month[:3].lower()) + 1 if month[:3].lower() in MONTHS else 0
        return _moment(int(g[y]), month, int(g[d]), g.groups()[3:])
    if (g := _only_time.fullmatch(text)) and (g[2] or g[5]):
        return _moment(1900, 1, 1, g.groups())
    return None


def _moment(y: int, m: int, d: int, clock: tuple) -> datetime | None:
    hh, mi, ss, part, half = (*clock, None, None, None, None, None)[:5]
    hour = int(hh or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "pm")
    try:
        return datetime(y, m, d, hour, int(mi or 0), int(ss or 0), int((part or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None


def literal(moment: datetime) -> str:
    return f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ', timespec='microseconds')}'"


def of_text(sql: str, safe: bool) -> str:
    """Text of a column to a moment, by the same forms as parse(); anything else fails, or is null if safe."""
    t = f"trim({sql})"

    def moment(form: re.Pattern, y: str, m: str, d: str, clock: int) -> str:
        group = lambda k: f"regexp_extract({t}, {quoted('(?i)^(?:' + form.pattern + ')$')}, {k})"
        number = lambda k, other: f"CAST(coalesce(nullif({group(k)}, ''), '{other}') AS INT)"
        y, m, d = (number(x, "0") if isinstance(x, int) else x for x in (y, m, d))
        half, hour = f"lower({group(clock + 4)})", number(clock, "0")
        hour = f"CASE WHEN {half} = '' THEN {hour} WHEN {hour} BETWEEN 1 AND 12 THEN {hour} % 12 + CASE {half} WHEN 'pm' THEN 12 ELSE 0 END ELSE 99 END"
        second = f"CAST(concat({number(clock + 2, '0')}, '.', substring(rpad({group(clock + 3)}, 6, '0'), 1, 6)) AS DECIMAL(16, 6))"
        return f"try_make_timestamp_ntz({y}, {m}, {d}, {hour}, {number(clock + 1, '0')}, {second})"

    whens = []
    for form, (y, m, d) in _forms:
        fits = f"{t} RLIKE {quoted('(?i)^(?:' + form.pattern + ')$')}"
        if "[a-z]" in form.pattern:
            own = f"lower(substring(regexp_extract({t}, {quoted('(?i)^(?:' + form.pattern + ')$')}, {m}), 1, 3))"
            m = f"array_position(array({', '.join(map(quoted, MONTHS))}), {own})"
            m = f"CAST({m} AS INT)"
        whens.append(f"WHEN {fits} THEN {moment(form, y, m, d, 4)}")
    clock = quoted("(?i)^(?:" + _only_time.pattern + ")$")
    whens.append(f"WHEN {t} RLIKE {clock} AND concat(regexp_extract({t}, {clock}, 2), regexp_extract({t}, {clock}, 5)) <> '' THEN {moment(_only_time, '1900', '1', '1', 1)}")
    last = "" if safe else ", CAST(raise_error('#241#Conversion failed when converting date and/or time from character string.#') AS TIMESTAMP_NTZ)"
    return f"CASE WHEN {sql} IS NULL THEN CAST(NULL AS TIMESTAMP_NTZ) WHEN {t} = '' THEN {EPOCH} ELSE coalesce(CASE {' '.join(whens)} END{last}) END"


def of_days(sql: str) -> str:
    return f"timestampadd(MICROSECOND, CAST(round(CAST({sql} AS DOUBLE) * 86400000000D) AS BIGINT), {EPOCH})"


def days(sql: str) -> str:
    return f"(CAST(timestampdiff(MICROSECOND, {EPOCH}, {sql}) AS DOUBLE) / 86400000000D)"


def part(name: str, d: str) -> str:
    """DATEPART; weeks begin on Sunday and the first holds January 1."""
    if name == "week":
        return f"CAST(floor((dayofyear({d}) + dayofweek(date_trunc('YEAR', {d})) - 2) / 7) + 1 AS INT)"
    if name == "millisecond":
        return f"CAST(date_format({d}, 'SSS') AS INT)"
    return f"{ {'day': 'dayofmonth', 'weekday': 'dayofweek'}.get(name, name) }({d})"


def named(name: str, d: str) -> str:
    return f"date_format({d}, 'MMMM')" if name == "month" else f"date_format({d}, 'EEEE')" if name == "weekday" else f"CAST({part(name, d)} AS STRING)"


def add(name: str, n: str, d: str) -> str:
    unit = {"dayofyear": "DAY", "weekday": "DAY"}.get(name, name.upper())
    moved = f"timestampadd({unit}, CAST({n} AS INT), {d})"
    return f"CASE WHEN year({moved}) BETWEEN 1753 AND 9999 THEN {moved} WHEN {moved} IS NOT NULL THEN CAST(raise_error('#517#Adding a value to a datetime column caused an overflow.#') AS TIMESTAMP_NTZ) END"


def difference(name: str, a: str, b: str) -> str:
    """DATEDIFF: how many boundaries of the part lie between; weeks begin on Sunday."""
    years, day = f"(year({b}) - year({a}))", lambda d: f"datediff(CAST({d} AS DATE), DATE'1900-01-07')"
    of = lambda unit, d: f"timestampdiff({unit}, TIMESTAMP_NTZ'0001-01-01 00:00:00', date_trunc('{unit}', {d}))"
    if name == "year":
        sql = years
    elif name == "quarter":
        sql = f"({years} * 4 + quarter({b}) - quarter({a}))"
    elif name == "month":
        sql = f"({years} * 12 + month({b}) - month({a}))"
    elif name == "week":
        sql = f"(floor({day(b)} / 7) - floor({day(a)} / 7))"
    elif name in ("day", "dayofyear", "weekday"):
        sql = f"({day(b)} - {day(a)})"
    else:
        sql = f"({of(name.upper(), b)} - {of(name.upper(), a)})"
    return f"CAST({sql} AS INT)"


#: The styles of CONVERT by number, as patterns; a lower-case "h" with "a" is padded with a blank.
STYLES = {
    0: "MMM _d yyyy _h:mma", 1: "MM/dd/yy", 2: "yy.MM.dd", 3: "dd/MM/yy", 4: "dd.MM.yy", 5: "dd-MM-yy", 6: "dd MMM yy", 7: "MMM dd, yy", 8: "HH:mm:ss", 9: "MMM _d yyyy _h:mm:ss:SSSa",
    10: "MM-dd-yy", 11: "yy/MM/dd", 12: "yyMMdd", 13: "dd MMM yyyy HH:mm:ss:SSS", 14: "HH:mm:ss:SSS", 20: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 22: "MM/dd/yy _h:mm:ss a",
    23: "yyyy-MM-dd", 24: "HH:mm:ss", 25: "yyyy-MM-dd HH:mm:ss.SSS", 100: "MMM _d yyyy _h:mma", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy",
    106: "dd MMM yyyy", 107: "MMM dd, yyyy", 108: "HH:mm:ss", 109: "MMM _d yyyy _h:mm:ss:SSSa", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 113: "dd MMM yyyy HH:mm:ss:SSS",
    114: "HH:mm:ss:SSS", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS", 127: "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def styled(d: str, style: int) -> str:
    """A moment as text in one of STYLES; in the ISO styles a whole second has no fraction."""
    parts = [f"lpad(date_format({d}, {quoted(p[1:])}), 2, ' ')" if p.startswith("_") else f"date_format({d}, {quoted(p)})" for p in re.split(r"(_[dh])", STYLES[style]) if p]
    sql = f"concat({', '.join(parts)})"
    return f"regexp_replace({sql}, '[.]000$', '')" if style in (126, 127) else sql


def from_number(n: float) -> datetime:
    return datetime(1900, 1, 1) + timedelta(days=n)
