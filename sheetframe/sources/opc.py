"""The parts of a workbook: relationships, sheets, shared strings, styles.

Small parts are read on the driver; shared strings by every worker process that needs them, once.
"""

from __future__ import annotations

import html
import io
import os
import re
import sys
import types
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 4


def cache() -> dict:
    """A dictionary that outlives tasks in a worker process (functions of this package are pickled by value, its modules are not)."""
    return sys.modules.setdefault("_sheetframe_cache", types.ModuleType("_sheetframe_cache")).__dict__.setdefault("held", {})


def open_file(path: str):
    """A seekable binary file: a local path, or any URI that pyarrow's file systems know (hdfs, s3, gs, file)."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open(re.sub(r"^file:/*", "/", path), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


def stamp(path: str) -> tuple:
    """What a cached part of a file is known by."""
    if "://" in path:
        return (path,)
    s = os.stat(re.sub(r"^file:/*", "/", path))
    return path, s.st_mtime_ns, s.st_size


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


#: Built-in number formats that are dates (fixed values): 14 to 22 and 45 to 47.
DATE_IDS = (*range(14, 23), *range(45, 48))


def is_date_code(code: str, strict: bool = False) -> bool:
    """Whether a custom number format shows dates: a letter of y m d h s, and neither 0 nor #. Strict looks outside brackets and quotes only, where digits of seconds may follow."""
    code = code.lower()
    if strict:
        code = re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\.", "", code)
        code = re.sub(r"(?<=s)\.0+", "", code.split(";")[0])
    return bool(re.search("[ymdhs]", code)) and not re.search("[0#]", code)


@dataclass
class Workbook:
    """Sheets in their order, by name (of equal names the last) and by 0-based position."""

    path: str
    sheets: list[tuple[str, str]] = field(default_factory=list)
    date1904: bool = False
    _dates: dict[bool, list[bool]] = field(default_factory=dict)

    @classmethod
    def open(cls, path: str) -> Workbook:
        with zipfile.ZipFile(open_file(path)) as z:
            names = set(z.namelist())
            if "xl/workbook.xml" not in names:
                raise ValueError(f"{path}: no xl/workbook.xml")
            targets = {}
            if "xl/_rels/workbook.xml.rels" in names:
                for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                    target = e.get("Target", "")
                    targets[e.get("Id")] = target[1:] if target.startswith("/") else f"xl/{target}"
            out = cls(path)
            for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
                name = local_name(e.tag)
                if name == "sheet":
                    part = next((targets[v] for k, v in e.attrib.items() if local_name(k) == "id" and v in targets), None)
                    if part is not None:
                        out.sheets.append((e.get("name", ""), part))
                elif name == "workbookPr":
                    out.date1904 = e.get("date1904", "0") in ("1", "true")
            return out

    def sheet_names(self) -> list[str]:
        return [name for name, _ in self.sheets]

    def part(self, name: str | None = None, idx: int | None = None) -> str:
        """The part of a sheet; a name comes before a position, and without either it is the first."""
        if name is not None:
            found = {n: p for n, p in self.sheets}
            if name not in found:
                raise ValueError(f"Worksheet '{name}' not found")
            return found[name]
        if not 0 <= (idx or 0) < len(self.sheets):
            raise ValueError(f"Worksheet '{idx or 0}' not found")
        return self.sheets[idx or 0][1]

    def date_styles(self, strict: bool = False) -> list[bool]:
        """For each cell style, whether it shows dates."""
        if strict not in self._dates:
            with zipfile.ZipFile(open_file(self.path)) as z:
                styles: list[bool] = []
                if "xl/styles.xml" in z.namelist():
                    root = ElementTree.fromstring(z.read("xl/styles.xml"))
                    custom, known = {}, set(DATE_IDS)
                    for e in root.iter():
                        if local_name(e.tag) == "numFmt":
                            custom[int(e.get("numFmtId", 0))] = is_date_code(e.get("formatCode", ""), strict)
                    for e in root.iter():
                        if local_name(e.tag) == "cellXfs":
                            ids = [int(x.get("numFmtId", 0)) for x in e if local_name(x.tag) == "xf"]
                            styles = [i in known or custom.get(i, False) for i in ids]
                self._dates[strict] = styles
        return self._dates[strict]


_PIECE = re.compile(rb'<p b="(\d+)" z="(\d+)"/>')


def pieces(z: zipfile.ZipFile, part: str) -> list[tuple[int, int]]:
    """Where a part of a workbook of ours can be entered: bytes before, uncompressed and compressed. None, if it was written since by others."""
    name = part.removesuffix(".xml") + ".pieces.xml"
    if name not in z.NameToInfo or part not in z.NameToInfo:
        return []
    raw, own = z.read(name), z.getinfo(part)
    if not raw.startswith(f'<pieces size="{own.file_size}" packed="{own.compress_size}" crc="{own.CRC}">'.encode()):
        return []
    return [(int(b), int(p)) for b, p in _PIECE.findall(raw)]


_PLAIN_SI = re.compile(rb"<si><t(?: xml:space=\"preserve\")?>([^<]*)</t></si>")
_SI = re.compile(rb"<(?:\w+:)?si(?:\s[^>]*)?(?:/>|>(.*?)</(?:\w+:)?si>)", re.S)
_T = re.compile(rb"<(?:\w+:)?t(?:\s[^>]*)?(?:/>|>(.*?)</(?:\w+:)?t>)", re.S)
_CDATA = re.compile(rb"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->", re.S)


def xml_text(raw: bytes) -> str:
    """Text of an element without child elements: entities decoded, CDATA as it is, comments gone."""
    if b"<" not in raw:
        text = raw.decode("utf-8", "replace")
        return html_entities(text) if "&" in text else text
    out, at = [], 0
    for m in _CDATA.finditer(raw):
        out.append(html_entities(raw[at : m.start()].decode("utf-8", "replace")))
        out.append((m[1] or b"").decode("utf-8", "replace"))
        at = m.end()
    return "".join([*out, html_entities(raw[at:].decode("utf-8", "replace"))])


#: The named entities of XML (fixed values).
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def html_entities(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1][0] != "#":
            return _NAMED.get(m[1], m[0])
        return html.unescape(m[0]) if m[1] not in ("#13", "#xD", "#xd") else "\r"

    return re.sub(r"&(#?\w+);", one, text) if "&" in text else text


def shared_strings(path: str) -> pa.LargeStringArray:
    """The shared strings of a workbook: of each, all its runs. One table for each worker process and file, the latest few are held."""
    key, held = ("strings", *stamp(path)), cache()
    if key in held:
        return held[key]
    with zipfile.ZipFile(open_file(path)) as z:
        raw = z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else b""
    plain = _PLAIN_SI.findall(raw)
    if len(plain) == len(re.findall(rb"<(?:\w+:)?si[\s/>]", raw)):
        out = pa.array(plain, pa.large_binary()).cast(pa.large_string())
        if b"&" in raw:
            odd = pc.match_substring(out, "&")
            texts = pa.array([html_entities(t) for t in out.filter(odd).to_pylist()], pa.large_string())
            out = pc.replace_with_mask(out, odd, texts)
    else:
        out = pa.array(["".join(xml_text(t[1] or b"") for t in _T.finditer(si[1] or b"")) for si in _SI.finditer(raw)], pa.large_string())
    for old in [k for k in held if k[0] == "strings"][: -MAX_CACHED + 1 or None] if len(held) >= MAX_CACHED else []:
        held.pop(old)
    held[key] = out
    return out
