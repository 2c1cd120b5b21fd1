"""Scalar functions of T-SQL as Spark SQL expressions."""

from __future__ import annotations

from ..errors import TsqlError
from . import dates
from .convert import as_text, convert, literal, null, plain, settle
from .kinds import BIGINT, DATETIME, FLOAT, INT, TEXT, Ex, Kind, binary, ci, fail, highest, quoted


def need(name: str, args: list[Ex], least: int, most: int | None = None) -> None:
    most = least if most is None else most
    if not least <= len(args) <= most:
        raise TsqlError(174 if least == most else 189, f"The {name.lower()} function requires {least if least == most else f'{least} to {most}'} argument(s).", 15)


def whole(e: Ex) -> str:
    return convert(e, INT).sql if not e.kind.whole else f"CAST({e.sql} AS INT)"


def real(e: Ex) -> str:
    return convert(e, FLOAT).sql


def text(e: Ex) -> str:
    return as_text(e).sql


def _regex_of(pattern: str, escape: str | None) -> str:
    """A LIKE pattern as a regular expression."""
    out, i = "", 0
    special = set(".^$*+?()[]{}|\\/-&~#")
    lit = lambda c: "\\" + c if c in special else c
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out += lit(pattern[i])
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("^", "]") else i + 1)) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[negated:]
            cls, k = "", 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    cls += f"{lit(body[k])}-{lit(body[k + 2])}"
                    k += 3
                else:
                    cls += lit(body[k])
                    k += 1
            out += f"[{'^' if negated else ''}{cls}]" if cls else "(?!)"
            i = end
        else:
            out += lit(c)
        i += 1
    return out


def like(e: Ex, pattern: Ex, escape: Ex | None) -> str:
    """LIKE without regard to case; trailing blanks do count. Constant patterns become one regular expression, a plain
    prefix a comparison of the beginning."""
    value = binary(text(e))
    if pattern.kind.name == "null" or e.kind.name == "null":
        return "CAST(NULL AS BOOLEAN)"
    if pattern.constant and (escape is None or escape.constant):
        p, esc = str(pattern.value), escape and str(escape.value)
        if esc is not None and len(esc) != 1:
            raise TsqlError(506, f'The invalid escape character "{esc}" was specified in a LIKE predicate.')
        if not esc and p.endswith("%") and not set(p[:-1]) & set("%_["):
            return f"startswith(lower({value}), {quoted(p[:-1].lower())})"
        if not esc and p.startswith("%") and p.endswith("%") and len(p) > 2 and not set(p[1:-1]) & set("%_["):
            return f"contains(lower({value}), {quoted(p[1:-1].lower())})"
        return f"({value} RLIKE {quoted('(?isu)^' + _regex_of(p, esc) + chr(92) + 'z')})"
    mark = None if escape is None else binary(text(escape))
    if mark is not None:
        bad = fail(506, "The invalid escape character was specified in a LIKE predicate.", "STRING")
        mark = f"CASE WHEN length({mark}) <> 1 THEN {bad} ELSE {mark} END"
    return f"({value} RLIKE concat('(?isu)^', {_regex_sql(binary(text(pattern)), mark)}, {quoted(chr(92) + 'z')}))"


#: The tokens of a pattern, behind an escaped character: a set that is closed, or any character.
_TOKENS = r"\[\^[^\]]*\]|\[\][^\]]*\]|\[[^\]^][^\]]*\]|."


def _regex_sql(pattern: str, escape: str | None = None) -> str:
    """SQL that makes a regular expression of a pattern that differs by row: as _regex_of() does for one that is known."""
    quote = lambda c: f"regexp_replace({c}, {quoted(r'([^A-Za-z0-9_ ])')}, {quoted(r'\\$1')})"
    body, inner = f"substring(t, 2, length(t) - 2)", "substring(t, 3, length(t) - 3)"  # noqa: F541
    members = lambda b: f"regexp_replace(regexp_replace({b}, {quoted(r'([\[\]^&~\\])')}, {quoted(r'\\$1')}), {quoted('^-|-$')}, {quoted(r'\\-')})"
    tokens = quoted(f"(?s)(?:{_TOKENS})")
    first = ""
    if escape is not None:
        tokens = f"concat({quoted('(?s)(?:' + chr(92) + 'Q')}, {escape}, {quoted(chr(92) + 'E.|' + _TOKENS + ')')})"
        first = f"WHEN length(t) = 2 AND startswith(t, {escape}) THEN {quote('substring(t, 2)')} "
    one = (
        f"CASE {first}WHEN t = '%' THEN '.*' WHEN t = '_' THEN '.' WHEN t = '[^]' THEN '(?!)' WHEN length(t) > 1 AND startswith(t, '[^') THEN concat('[^', {members(inner)}, ']') "
        f"WHEN length(t) > 1 THEN concat('[', {members(body)}, ']') ELSE {quote('t')} END"
    )
    return f"array_join(transform(regexp_extract_all({pattern}, {tokens}, 0), t -> {one}), '')"


def _trim(args: list[Ex], side: str) -> Ex:
    value = text(args[0])
    if len(args) == 1:
        pattern = {"LEADING": r"^\s+", "TRAILING": r"\s+$", "BOTH": r"^\s+|\s+$"}[side]
        return Ex(f"regexp_replace({value}, {quoted(pattern)}, '')", TEXT)
    return Ex(f"trim({side} {ci(text(args[1]))} FROM {ci(value)})", TEXT).of(TEXT)


def _substring(args: list[Ex]) -> Ex:
    need("substring", args, 3)
    if args[0].kind.number or args[0].kind.name == "datetime":
        raise TsqlError(8116, f"Argument data type {args[0].kind.shown} is invalid for argument 1 of substring function.")
    v, a, n = text(args[0]), whole(args[1]), whole(args[2])
    length = f"CASE WHEN {n} < 0 THEN {fail(536, 'Invalid length parameter passed to the substring function.', 'INT')} ELSE greatest(CAST({a} AS BIGINT) + {n} - greatest({a}, 1), 0) END"
    return Ex(f"substring({v}, greatest({a}, 1), CAST({length} AS INT))", TEXT)


def _charindex(args: list[Ex]) -> Ex:
    need("charindex", args, 2, 3)
    n, h = f"lower({plain(args[0])})", f"lower({plain(args[1])})"
    start = f"greatest({whole(args[2])}, 1)" if len(args) == 3 else "1"
    return Ex(f"CASE WHEN {n} = '' THEN 0 ELSE locate({n}, {h}, {start}) END", INT)


def _patindex(args: list[Ex]) -> Ex:
    need("patindex", args, 2)
    if args[1].kind.name == "datetime":
        raise TsqlError(8116, "Argument data type datetime is invalid for argument 2 of patindex function.")
    if not args[0].constant:
        p, v = plain(args[0]), plain(args[1])
        inner = f"regexp_replace(regexp_replace({p}, '^%', ''), '%$', '')"
        rx = f"concat('(?isu)', CASE WHEN startswith({p}, '%') THEN '' ELSE '^' END, {_regex_sql(inner)}, CASE WHEN endswith({p}, '%') THEN '' ELSE {quoted(chr(92) + 'z')} END)"
        return Ex(f"CASE WHEN {p} IS NULL OR {v} IS NULL THEN NULL WHEN {inner} = '' THEN 1 ELSE regexp_instr({v}, {rx}) END", INT)
    p = str(args[0].value)
    floats, open_ = p.startswith("%"), p.endswith("%")
    inner = p[1:] if floats else p
    inner = inner[:-1] if open_ and inner else inner
    rx = "(?isu)" + ("" if floats else "^") + _regex_of(inner, None) + ("" if open_ else r"\z")
    v = plain(args[1])
    if not inner:
        return Ex(f"CASE WHEN {v} IS NULL THEN NULL WHEN length({v}) >= 0 THEN 1 END", INT)
    return Ex(f"regexp_instr({v}, {quoted(rx)})", INT)


def _stuff(args: list[Ex]) -> Ex:
    need("stuff", args, 4)
    v, a, n, r = text(args[0]), whole(args[1]), whole(args[2]), text(args[3])
    return Ex(f"CASE WHEN {a} BETWEEN 1 AND length({v}) AND {n} >= 0 THEN concat(substring({v}, 1, {a} - 1), coalesce({r}, ''), substring({v}, CAST(least(CAST({a} AS BIGINT) + {n}, 2147483647) AS INT))) END", TEXT)


def _quotename(args: list[Ex]) -> Ex:
    need("quotename", args, 1, 2)
    q = str(args[1].value) if len(args) == 2 else "["
    pairs = {"[": "[]", "]": "[]", "'": "''", '"': '""', "(": "()", ")": "()", "<": "<>", ">": "<>", "{": "{}", "}": "{}", "`": "``"}
    if q not in pairs:
        return null(TEXT)
    o, c = pairs[q]
    v = plain(args[0])
    return Ex(f"CASE WHEN length({v}) <= 128 THEN concat({quoted(o)}, replace({v}, {quoted(c)}, {quoted(c + c)}), {quoted(c)}) END", TEXT)


def _round(args: list[Ex]) -> Ex:
    need("round", args, 2, 3)
    e, n = args[0], args[1]
    kind = e.kind if e.kind.number else FLOAT
    x = e.sql if e.kind.number else real(e)
    cut = len(args) == 3 and args[2].value not in (0, None)
    if not n.constant or not isinstance(n.value, int):
        scaled = f"pow(10D, {whole(n)})"
        fn = "sign(X) * floor(abs(X))" if cut else "sign(X) * floor(abs(X) + 0.5D)"
        return Ex(f"CAST(({fn.replace('X', f'({real(e)} * {scaled})')}) / {scaled} AS {kind.spark})", kind)
    if cut:
        scale = f"{float(10.0 ** n.value)!r}D"
        return Ex(f"CAST(sign({x}) * floor(abs({x}) * {scale}) / {scale} AS {kind.spark})", kind)
    if kind.name == "float":
        return Ex(f"round({x}, {n.value})", Kind("float", e.kind.places))
    return Ex(f"CAST(round({x}, {n.value}) AS {kind.spark})", kind)


def _same_kind(fn: str):
    def make(args: list[Ex]) -> Ex:
        need(fn, args, 1)
        e = args[0] if args[0].kind.number else convert(args[0], FLOAT)
        return Ex(f"CAST({fn}({e.sql}) AS {e.kind.spark})", e.kind)

    return make


def _power(args: list[Ex]) -> Ex:
    need("power", args, 2)
    a = args[0] if args[0].kind.number else convert(args[0], FLOAT)
    raw = f"pow({real(a)}, {real(args[1])})"
    p = f"CASE WHEN isnan({raw}) OR {raw} = CAST('Infinity' AS DOUBLE) THEN {fail(8115, 'Arithmetic overflow error converting expression to data type float.', 'DOUBLE')} ELSE {raw} END"
    if a.kind.whole:
        return Ex(f"CAST({p} AS {a.kind.spark})", a.kind)
    return Ex(f"round({p}, {a.kind.places})" if a.kind.places is not None else p, a.kind)


def _guarded(fn: str, domain: str, number: int):
    def make(args: list[Ex]) -> Ex:
        need(fn, args, 1)
        x = real(args[0])
        return Ex(f"CASE WHEN {domain.format(x=x)} THEN {fn}({x}) WHEN {x} IS NOT NULL THEN {fail(number, 'An invalid floating point operation occurred.' if number == 3623 else 'Arithmetic overflow error for data type float.', 'DOUBLE')} END", FLOAT)

    return make


def _log(args: list[Ex]) -> Ex:
    need("log", args, 1, 2)
    x = real(args[0])
    bad = fail(3623, "An invalid floating point operation occurred.", "DOUBLE")
    if len(args) == 1:
        return Ex(f"CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} IS NOT NULL THEN {bad} END", FLOAT)
    b = real(args[1])
    return Ex(f"CASE WHEN {x} > 0 AND {b} > 0 AND {b} <> 1 THEN ln({x}) / ln({b}) WHEN {x} IS NOT NULL AND {b} IS NOT NULL THEN {bad} END", FLOAT)


def _bounded(sql: str) -> str:
    """A float that may not be infinite."""
    return f"CASE WHEN abs({sql}) < CAST('Infinity' AS DOUBLE) THEN {sql} WHEN {sql} IS NOT NULL THEN {fail(8115, 'Arithmetic overflow error for data type float.', 'DOUBLE')} END"


def _date(e: Ex) -> str:
    return convert(e, DATETIME).sql


def _part(args: list[Ex], fn: str) -> str:
    found = dates.PARTS.get(str(args[0].value).lower())
    if found is None:
        raise TsqlError(155, f"'{args[0].value}' is not a recognized {fn} option.", 15)
    return found


def _dateadd(args: list[Ex]) -> Ex:
    need("dateadd", args, 3)
    n = args[1].sql if args[1].kind.whole else f"CAST({real(args[1])} AS INT)"
    return Ex(dates.add(_part(args, "dateadd"), n, _date(args[2])), DATETIME)


def _datediff(args: list[Ex]) -> Ex:
    need("datediff", args, 3)
    return Ex(dates.difference(_part(args, "datediff"), _date(args[1]), _date(args[2])), INT)


def _eomonth(args: list[Ex]) -> Ex:
    need("eomonth", args, 1, 2)
    d = f"CAST({_date(args[0])} AS DATE)"
    return Ex(f"CAST(last_day({f'add_months({d}, {whole(args[1])})' if len(args) == 2 else d}) AS TIMESTAMP_NTZ)", DATETIME)


def _choose(args: list[Ex]) -> Ex:
    need("choose", args, 2, 255)
    values, kind = settle(args[1:])
    return Ex(f"CASE {whole(args[0])} " + " ".join(f"WHEN {i} THEN {v.sql}" for i, v in enumerate(values, 1)) + " END", kind)


def _coalesce(args: list[Ex]) -> Ex:
    need("coalesce", args, 2, 255)
    if all(a.kind.name == "null" for a in args):
        raise TsqlError(4127, "At least one of the arguments to COALESCE must be an expression that is not the NULL constant.")
    values, kind = settle(args)
    return Ex(f"coalesce({', '.join(v.sql for v in values)})", kind)


def _isnull(args: list[Ex]) -> Ex:
    need("isnull", args, 2)
    a, b = args
    kind = highest([a.kind, b.kind]) if a.kind.name == "null" else a.kind
    return Ex(f"coalesce({convert(a, kind).sql}, {convert(b, kind).sql})", kind)


def _nullif(args: list[Ex]) -> Ex:
    need("nullif", args, 2)
    a, b = args
    if a.kind.text and b.kind.text:
        return Ex(f"nullif({binary(a.sql)}, {binary(b.sql)})", a.kind)
    if a.kind.number and b.kind.number:
        return Ex(f"CASE WHEN {a.sql} = {b.sql} THEN NULL ELSE {a.sql} END", a.kind)
    return Ex(f"nullif({a.sql}, {b.sql})", a.kind) if a.kind.name == b.kind.name else a


def _extreme(fn: str):
    def make(args: list[Ex]) -> Ex:
        need(fn, args, 1, 254)
        values, kind = settle(args)
        if kind.text:
            return Ex(f"{binary(f'{fn}(' + ', '.join(ci(v) for v in values) + ')')}" if len(values) > 1 else values[0].sql, kind)
        return Ex(f"{fn}({', '.join(v.sql for v in values)})" if len(values) > 1 else values[0].sql, kind)

    return make


def _translate(args: list[Ex]) -> Ex:
    need("translate", args, 3)
    v, a, b = map(plain, args)
    bad = fail(9828, "The second and third arguments of the TRANSLATE built-in function must contain an equal number of characters.", "STRING")
    return Ex(f"CASE WHEN length({a}) = length({b}) THEN translate({v}, {a}, {b}) WHEN {v} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL THEN {bad} END", TEXT)


def _char(most: int):
    def make(args: list[Ex]) -> Ex:
        need("char", args, 1)
        n = whole(args[0])
        return Ex(f"CASE WHEN {n} BETWEEN 0 AND {most} THEN decode(unhex(lpad(hex({n}), 4, '0')), 'UTF-16BE') END", TEXT)

    return make


def _replace(args: list[Ex]) -> Ex:
    need("replace", args, 3)
    return Ex(f"replace({', '.join(map(plain, args))})", TEXT)


def _unary(sql: str, kind: Kind, get=plain):
    def make(args: list[Ex]) -> Ex:
        need(sql.split("(")[0], args, 1)
        return Ex(sql.format(x=get(args[0])), kind)

    return make


def _sides(fn: str):
    def make(args: list[Ex]) -> Ex:
        need(fn, args, 2)
        n = whole(args[1])
        bad = fail(537, f"Invalid length parameter passed to the {fn.upper()} function.", "STRING")
        return Ex(f"CASE WHEN {n} < 0 THEN {bad} ELSE {fn}({text(args[0])}, {n}) END", TEXT)

    return make


def _square(args: list[Ex]) -> Ex:
    need("square", args, 1)
    return Ex(_bounded(f"({real(args[0])} * {real(args[0])})"), FLOAT)


def _concat_ws(args: list[Ex]) -> Ex:
    need("concat_ws", args, 2, 254)
    return Ex(f"concat_ws(coalesce({text(args[0])}, ''), {', '.join(map(text, args[1:]))})", TEXT)


def _replicate(args: list[Ex]) -> Ex:
    need("replicate", args, 2)
    n = whole(args[1])
    return Ex(f"CASE WHEN {n} >= 0 THEN repeat({text(args[0])}, {n}) END", TEXT)


def _sign(args: list[Ex]) -> Ex:
    need("sign", args, 1)
    e = args[0]
    return Ex(f"CAST(signum({real(e)}) AS INT)", INT)


FUNCTIONS = {
    "LEN": _unary("length(regexp_replace({x}, '\\\\s+$', ''))", INT), "DATALENGTH": _unary("length({x})", INT), "UPPER": _unary("upper({x})", TEXT), "LOWER": _unary("lower({x})", TEXT),
    "LTRIM": lambda a: _trim(a, "LEADING"), "RTRIM": lambda a: _trim(a, "TRAILING"), "TRIM": lambda a: _trim(a[:2], str(a[2].value) if len(a) > 2 else "BOTH"),
    "REVERSE": _unary("reverse({x})", TEXT), "LEFT": _sides("left"), "RIGHT": _sides("right"), "SUBSTRING": _substring, "REPLACE": _replace, "CHARINDEX": _charindex,
    "CONCAT": lambda a: (need("concat", a, 2, 254), Ex(f"concat({', '.join(f'coalesce({text(x)}, {quoted(str())})' for x in a)})", TEXT))[1], "CONCAT_WS": _concat_ws, "QUOTENAME": _quotename,
    "ISNULL": _isnull, "COALESCE": _coalesce, "NULLIF": _nullif, "CHOOSE": _choose, "GREATEST": _extreme("greatest"), "LEAST": _extreme("least"),
    "ABS": _same_kind("abs"), "FLOOR": _same_kind("floor"), "CEILING": _same_kind("ceil"), "SIGN": _sign, "ROUND": _round, "POWER": _power, "SQRT": _guarded("sqrt", "{x} >= 0", 3623),
    "SQUARE": _square, "EXP": lambda a: (need("exp", a, 1), Ex(_bounded(f"exp({real(a[0])})"), FLOAT))[1], "LOG": _log, "LOG10": _guarded("log10", "{x} > 0", 3623),
    "PI": lambda a: (need("pi", a, 0), Ex("pi()", FLOAT))[1], "SPACE": lambda a: (need("space", a, 1), Ex(f"CASE WHEN {whole(a[0])} >= 0 THEN repeat(' ', {whole(a[0])}) END", TEXT))[1],
    "STR": lambda a: (need("str", a, 1, 3), Ex(text(a[0]), TEXT))[1], "PATINDEX": _patindex, "STUFF": _stuff, "REPLICATE": _replicate,
    "ASCII": _unary("CASE WHEN {x} <> '' THEN ascii({x}) END", INT), "UNICODE": _unary("CASE WHEN {x} <> '' THEN ascii({x}) END", INT), "CHAR": _char(255), "NCHAR": _char(65535), "TRANSLATE": _translate,
    "DATEADD": _dateadd, "DATEDIFF": _datediff, "DATEPART": lambda a: (need("datepart", a, 2), Ex(dates.part(_part(a, "datepart"), _date(a[1])), INT))[1],
    "DATENAME": lambda a: (need("datename", a, 2), Ex(dates.named(_part(a, "datename"), _date(a[1])), TEXT))[1], "YEAR": _unary("year({x})", INT, _date), "MONTH": _unary("month({x})", INT, _date),
    "DAY": _unary("day({x})", INT, _date), "EOMONTH": _eomonth, "FULLTEXTSERVICEPROPERTY": lambda a: literal(0),
}


def arithmetic(op: str, a: Ex, b: Ex) -> Ex:
    """+ - * / % and bits, by kinds: text beside text joins, whole by whole stays whole, moments move by days."""
    if op == "+" and a.kind.text and b.kind.text:
        return Ex(f"concat({a.sql}, {b.sql})", TEXT, str(a.value) + str(b.value) if a.constant and b.constant else None, a.constant and b.constant)
    if op == "+" and {a.kind.name, b.kind.name} <= {"text", "null"} and (a.kind.text or b.kind.text):
        return null(TEXT)
    if a.kind.name == "binary" or b.kind.name == "binary":
        raise TsqlError(402, f"The data types {a.kind.shown} and {b.kind.shown} are incompatible in the {op} operator.")
    if "datetime" in (a.kind.name, b.kind.name):
        if op not in "+-":
            raise TsqlError(206, "Operand type clash: datetime is incompatible with this operator")
        x, y = (dates.days(e.sql) if e.kind.name == "datetime" else dates.days(convert(e, DATETIME).sql) if e.kind.text else real(e) for e in (a, b))
        return Ex(dates.of_days(f"({x} {op} {y})"), DATETIME)
    if op in "&|^":
        kind = highest([k for k in (a.kind, b.kind) if k.whole] or [INT])
        return Ex(f"({convert(a, kind).sql} {op} {convert(b, kind).sql})", kind)
    kinds = [k if k.number else INT if k.name in ("bit", "null") else FLOAT if any(o.name == "float" for o in (a.kind, b.kind)) else INT for k in (a.kind, b.kind)]
    for e, i in ((a, 0), (b, 1)):
        if e.kind.text and e.constant and isinstance(e.value, str) and not e.value.strip().lstrip("+-").isdigit() and e.value.strip():
            kinds[i] = FLOAT
    kind = highest(kinds)
    if kind.name == "float":
        x, y = convert(a, Kind("float")).sql, convert(b, Kind("float")).sql
        places = None
        if a.kind.places is not None or b.kind.places is not None:
            p, q = ((e.kind.places if e.kind.places is not None else 0 if e.kind.whole else None) for e in (a, b))
            if p is not None and q is not None:
                places = {"+": max(p, q), "-": max(p, q), "*": p + q, "/": max(6, p + 11), "%": max(p, q)}[op]
                places = min(places, 18)
        return Ex(f"({x} {op} {y})", Kind("float", places))
    if op in "/%":
        x, y = convert(a, kind).sql, convert(b, kind).sql
        return Ex(f"CAST({x} DIV {y} AS {kind.spark})" if op == "/" else f"CAST({x} % {y} AS {kind.spark})", kind)
    if a.constant and b.constant and isinstance(a.value, int) and isinstance(b.value, int):
        return literal({"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[op])
    return Ex(f"({convert(a, BIGINT).sql} {op} {convert(b, BIGINT).sql})", BIGINT)
