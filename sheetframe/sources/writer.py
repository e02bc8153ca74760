"""Writing workbooks: a plain, deterministic layout that any reader of the format takes."""

from __future__ import annotations

import datetime as dt
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

EPOCH = dt.datetime(1899, 12, 30)
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def escape(text: str) -> str:
    return _ILLEGAL.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")


def serial(t: dt.datetime | dt.date) -> float:
    if not isinstance(t, dt.datetime):
        t = dt.datetime(t.year, t.month, t.day)
    d = t.replace(tzinfo=None) - EPOCH
    return d.days + (d.seconds + d.microseconds // 1000 / 1000) / 86400


def number(x: float) -> str:
    """The shortest text that reads back as x; whole numbers without a point."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


#: Texts of more characters, and texts beyond so many in the shared-string table, are written into their cells.
LONG_TEXT, SHARED_TEXTS = 1000, 500_000


class SheetWriter:
    """Rows of one sheet as XML, short texts through a shared-string table. Floats that are not numbers become empty cells."""

    def __init__(self, strings: dict[str, int]):
        self.strings, self.rows = strings, 0

    def text(self, ref: str, text: str) -> str:
        if text not in self.strings and (len(text) > LONG_TEXT or len(self.strings) >= SHARED_TEXTS):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
        return f'<c r="{ref}" t="s"><v>{self.strings.setdefault(text, len(self.strings))}</v></c>'

    def row(self, values: Iterable) -> str:
        self.rows += 1
        out = [f'<row r="{self.rows}">']
        for c, v in enumerate(values):
            if v is None or isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
                continue
            ref = f"{column_name(c)}{self.rows}"
            if isinstance(v, bool):
                out.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, int):
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif isinstance(v, float):
                out.append(f'<c r="{ref}"><v>{number(v)}</v></c>')
            elif isinstance(v, (dt.datetime, dt.date)):
                out.append(f'<c r="{ref}" s="1"><v>{number(serial(v))}</v></c>')
            else:
                out.append(self.text(ref, str(v)))
        out.append("</row>")
        return "".join(out)


PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>{sheets}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


#: What stands before and after the rows of a sheet.
HEAD, TAIL = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet {_MAIN}><sheetData>', "</sheetData></worksheet>"


def member(name: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


def write_xlsx(path: str, sheets: list[tuple[str, list[str] | None, Iterable[Iterable]]]) -> None:
    """A workbook of (name, header or None, rows). The file appears at once, when it is complete; equal input gives equal bytes."""
    strings: dict[str, int] = {}
    partial = f"{path}.{uuid.uuid4().hex}.part"
    with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED, compresslevel=4) as z:
        for i, (_, header, rows) in enumerate(sheets, 1):
            writer = SheetWriter(strings)
            with z.open(member(f"xl/worksheets/sheet{i}.xml"), "w", force_zip64=True) as f:
                f.write(HEAD.encode())
                held = [writer.row(header)] if header is not None else []
                size = 0
                for r in rows:
                    held.append(writer.row(r))
                    size += len(held[-1])
                    if size >= 1 << 20:
                        f.write("".join(held).encode())
                        held, size = [], 0
                f.write(("".join(held) + TAIL).encode())
        write_parts(z, [name for name, _, _ in sheets], strings)
    os.replace(partial, path)


def write_parts(z: zipfile.ZipFile, sheets: list[str], strings: dict[str, int]) -> None:
    """The other parts of a workbook with sheets of these names."""
    n = len(sheets)
    names = "".join(f'<sheet name="{escape(name).replace(chr(34), "&quot;")}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
    rels += f'<Relationship Id="rId{n + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/><Relationship Id="rId{n + 2}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/>'
    z.writestr(member("xl/workbook.xml"), f"<workbook {_MAIN}><sheets>{names}</sheets></workbook>")
    z.writestr(member("xl/_rels/workbook.xml.rels"), f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
    for name, text in PARTS.items():
        z.writestr(member(name), text.replace("{sheets}", kinds))
    with z.open(member("xl/sharedStrings.xml"), "w", force_zip64=True) as f:
        f.write(f'<sst {_MAIN} uniqueCount="{len(strings)}">'.encode())
        for s in strings:
            f.write(f'<si><t xml:space="preserve">{escape(s)}</t></si>'.encode())
        f.write(b"</sst>")


def raw_xlsx(path: str, sheet_xml: dict[str, str], strings: str | None = None, styles: str | None = None, workbook: str | None = None, rels: str | None = None) -> str:
    """A workbook from hand-written parts (for tests): sheet name -> its XML, in order; the rest has defaults."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, xml in enumerate(sheet_xml.values(), 1):
            if xml is not None:
                z.writestr(f"xl/worksheets/sheet{i}.xml", xml)
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheet_xml, 1))
        z.writestr("xl/workbook.xml", workbook or f"<workbook {_MAIN}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", rels or "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheet_xml) + 1)) + "</Relationships>")
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", strings)
        if styles is not None:
            z.writestr("xl/styles.xml", styles)
    return path


def temporary(prefix: str = "sheetframe-") -> str:
    """A new folder that all executors see: in spark.checkpoint.dir where it is set, on a local master in the machine's own, else an error."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    shared = spark.conf.get("spark.checkpoint.dir", None) if spark else None
    if shared is None and spark is not None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = re.sub("^file:/*", "/", shared) if shared else None
    if root and "://" in root:
        raise ValueError("workbooks are written to a mounted folder; spark.checkpoint.dir is none")
    if root:
        os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix=prefix, dir=root)
