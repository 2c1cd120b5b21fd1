"""CSV, JSON, XML, HTML and workbook files. CSV is read by executors; the document formats are small and read whole."""

from __future__ import annotations

import json
import re
import zipfile
from datetime import datetime, timedelta
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession

from ..errors import TsqlError
from . import infer, shapes

MOST_ELEMENTS = 500_000


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, by way of Spark, so that it may lie in any store that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(rows) != 1:
        raise TsqlError(50001, f"{path} is not one file.")
    return bytes(rows[0].content)


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise TsqlError(50001, "The source is not UTF-8.") from None


def csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """First line is the header; empty cells are null, quoted ones may hold breaks; rows of another width are refused."""
    if len(delimiter) != 1:
        raise TsqlError(50001, "The delimiter must be one character.")
    df = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="FAILFAST", emptyValue="", nullValue="", enforceSchema=False, inferSchema=False)
    try:
        return infer.typed(df)
    except TsqlError:
        raise
    except Exception as e:
        if "MALFORMED" in str(e) or "FAILFAST" in str(e):
            raise TsqlError(50001, f"{path} has a row with another number of fields than its header.") from e
        raise


def json_tables(spark: SparkSession, data: bytes, **options) -> dict[str, DataFrame]:
    """The tables of a JSON document by name; "" is the main one."""
    try:
        document = json.loads(decoded(data))
    except ValueError as e:
        raise TsqlError(50001, f"The source is not JSON: {e}") from None
    return shapes.tables(spark, document, **options)


def xml_document(data: bytes) -> object:
    """XML as dictionaries and lists: attributes are @name, text beside them #text, repeated tags lists; no namespaces."""
    stack: list[tuple[str, dict, list]] = [("", {}, [])]
    count = 0
    plain = lambda tag: tag.rpartition("}")[2].rpartition(":")[2]

    def start(tag: str, attributes: dict) -> None:
        nonlocal count
        count += 1
        if count > MOST_ELEMENTS:
            raise TsqlError(50001, f"The document has more than {MOST_ELEMENTS} elements.")
        stack.append((plain(tag), {f"@{plain(k)}": v for k, v in attributes.items() if not k.startswith("xmlns")}, []))

    def end(tag: str) -> None:
        own, value, text = stack.pop()
        words = "".join(text).strip()
        if value and words:
            value["#text"] = words
        put: object = value or (words or None)
        parent = stack[-1][1]
        if own in parent:
            if not isinstance(parent[own], list):
                parent[own] = [parent[own]]
            parent[own].append(put)
        else:
            parent[own] = put

    def refuse(*args) -> None:
        raise TsqlError(50001, "A document type declaration is refused.")

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = start, end, lambda s: stack[-1][2].append(s), refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise TsqlError(50001, f"The source is not XML: {e}") from None
    return stack[0][1]


class _Tables(HTMLParser):
    """The tables of a page: captions and rows of (is header, text, span)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.linked: list[str] = []
        self.mode = ""

    def handle_starttag(self, tag: str, attributes: list) -> None:
        a = dict(attributes)
        if tag == "table":
            self.open.append({"caption": "", "rows": []})
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.mode = "ld"
            self.linked.append("")
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t["rows"].append([])
            elif tag in ("td", "th"):
                if not t["rows"]:
                    t["rows"].append([])
                span = a.get("colspan") or "1"
                t["rows"][-1].append([tag == "th", "", int(span) if span.isdigit() else 1])
                self.mode = "cell"
            elif tag == "caption":
                self.mode = "caption"

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())
        if tag in ("td", "th", "caption", "script", "tr"):
            self.mode = ""

    def handle_data(self, data: str) -> None:
        if self.mode == "ld":
            self.linked[-1] += data
        elif self.open and self.mode == "caption":
            self.open[-1]["caption"] += data
        elif self.open and self.mode == "cell" and self.open[-1]["rows"] and self.open[-1]["rows"][-1]:
            self.open[-1]["rows"][-1][-1][1] += data


def html_tables(text: str) -> dict[str, list[dict]]:
    """Records of each table of a page, by its caption or position; one-row layout tables are left out."""
    p = _Tables()
    p.feed(text)
    p.close()
    p.tables += p.open[::-1]
    out: dict[str, list[dict]] = {}
    for i, t in enumerate(p.tables, 1):
        rows = [[(h, " ".join(x.split())) for h, x, n in r for _ in range(n)] for r in t["rows"]]
        rows = [r for r in rows if r]
        if len(rows) < 2:
            continue
        head = max((k for k, r in enumerate(rows) if all(h for h, _ in r)), key=lambda k: len({x for _, x in rows[k]}), default=None)
        width = max(map(len, rows))
        titles = [x for _, x in rows[head]] if head is not None else []
        names: list[str] = []
        for k in range(width):
            n = (titles[k] if k < len(titles) else "") or f"column{k + 1}"
            while n.lower() in (x.lower() for x in names):
                n += "_"
            names.append(n)
        body = [r for k, r in enumerate(rows) if k != head and not all(h for h, _ in r)]
        name = " ".join(t["caption"].split()) or f"table{i}"
        while name in out:
            name += "_"
        out[name] = [{n: (r[k][1] or None) if k < len(r) else None for k, n in enumerate(names)} for r in body]
    for i, text_ in enumerate(p.linked, 1):
        try:
            found = json.loads(text_)
        except ValueError:
            continue
        out[f"linked{i}"] = [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
    return out


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57))


def _is_date(number: int, custom: dict[int, str]) -> bool:
    if number in _DATE_FORMATS:
        return True
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(number, ""))
    return bool(re.search(r"[dmyhs]", code, re.I)) and "general" not in code.lower()


def workbook(data: bytes) -> dict[str, list[dict]]:
    """Records of each sheet, and of each table on one, of an .xlsx file; cells carry their types."""
    try:
        z = zipfile.ZipFile(BytesIO(data))
    except zipfile.BadZipFile:
        raise TsqlError(50001, "The source is not an .xlsx workbook.") from None
    xml = lambda n: ElementTree.fromstring(z.read(n)) if n in z.namelist() else None
    strings = [] if (s := xml("xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in s.iter(f"{_NS}si")]
    styles = xml("xl/styles.xml")
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")} if styles is not None else {}
    cell_formats = styles.find(f"{_NS}cellXfs") if styles is not None else None
    dated = [_is_date(int(x.get("numFmtId", 0)), custom) for x in cell_formats] if cell_formats is not None else []
    book = xml("xl/workbook.xml")
    props = book.find(f"{_NS}workbookPr")
    epoch = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    out: dict[str, list[dict]] = {}

    def place(ref: str) -> tuple[int, int]:
        m = re.match(r"\$?([A-Z]+)\$?(\d+)", ref)
        c = 0
        for ch in m[1]:
            c = c * 26 + ord(ch) - 64
        return int(m[2]), c

    def value(c) -> object:
        kind, v = c.get("t", "n"), c.find(f"{_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t")) or None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return strings[int(v.text)] or None
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e"):
            return v.text
        n = float(v.text)
        style = int(c.get("s", 0))
        if style < len(dated) and dated[style]:
            if epoch.year == 1899 and 60 <= n < 61:
                raise TsqlError(50001, "A cell holds February 29, 1900, which never was.")
            return epoch + timedelta(microseconds=round((n + (1 if epoch.year == 1899 and n < 60 else 0)) * 86_400_000_000))
        return int(n) if n == int(n) and abs(n) < 2**63 else n

    def records(cells: dict, top: int, left: int, bottom: int, right: int) -> list[dict]:
        names: list[str] = []
        for c in range(left, right + 1):
            n = str(cells.get((top, c)) or f"column{c - left + 1}")
            while n.lower() in (x.lower() for x in names):
                n += "_"
            names.append(n)
        rows = ({n: cells.get((r, left + k)) for k, n in enumerate(names)} for r in range(top + 1, bottom + 1))
        return [r for r in rows if any(v is not None for v in r.values())]

    for sheet in book.iter(f"{_NS}sheet"):
        target = rels[sheet.get(_REL)].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        cells = {place(c.get("r")): value(c) for c in xml(path).iter(f"{_NS}c")}
        cells = {k: v for k, v in cells.items() if v is not None}
        if cells:
            out[sheet.get("name")] = records(cells, min(r for r, _ in cells), min(c for _, c in cells), max(r for r, _ in cells), max(c for _, c in cells))
        own = xml(f"{path.rpartition('/')[0]}/_rels/{path.rpartition('/')[2]}.rels")
        for r in own if own is not None else ():
            if r.get("Type", "").endswith("/table"):
                t = xml("xl/" + r.get("Target").replace("../", ""))
                (top, left), (bottom, right) = map(place, t.get("ref").split(":"))
                out[t.get("displayName") or t.get("name")] = records(cells, top, left, bottom, right)
    return out


def sniff(data: bytes) -> str:
    """json, xml, html or csv, by the first bytes."""
    head = data[:1024].removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    if head[:1] in (b"{", b"["):
        return "json"
    if head.startswith((b"<!doctype html", b"<html")) or b"<table" in head:
        return "html"
    return "xml" if head.startswith(b"<") else "csv"
