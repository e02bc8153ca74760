"""From the bytes of a sheet to columns of cells.

A sheet is cut by bytes of its uncompressed part; a split owns the rows whose tags begin in it. Unless a list of its
pieces says where (see pieces.py), the part can't be entered in the middle, so a split inflates what comes before it
and drops it: inflating is some ten times faster than reading cells. Chunks whose rows all have the same cells are taken
apart column by column, others in the usual layout cell by cell in whole arrays, all others by an XML parser.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .opc import html_entities, open_file, pieces, shared_strings

CHUNK = 2 << 20
EMPTY, INT, FLOAT, TEXT, BOOL, ISO, ERROR = range(7)
KINDS = ("empty", "int", "float", "string", "bool", "iso", "error")
CELLS = pa.schema([("row", pa.int64()), ("col", pa.int32()), ("kind", pa.int8()), ("value", pa.large_string()), ("style", pa.int32()), ("dateable", pa.bool_())])

_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>|<(?:\w+:)?sheetData(?:\s[^>]*)?/>")
_BEGIN = re.compile(rb"<(?:\w+:)?sheetData(?:\s[^>]*)?>")
#: 64-bit integers, and decimal numbers; infinity and NaN in words.
_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^(?i:[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity|nan))$"


class NeedsOneSplit(Exception):
    """Rows or cells without positions, comments or CDATA: the sheet can't be cut."""


def column_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def part_size(path: str, part: str) -> int:
    with zipfile.ZipFile(open_file(path)) as z:
        try:
            return z.getinfo(part).file_size
        except KeyError:
            raise ValueError(f"{path}: part {part} is missing") from None


def enterable(path: str, part: str) -> bool:
    """Whether a part can be entered at its pieces."""
    with zipfile.ZipFile(open_file(path)) as z:
        return bool(pieces(z, part))


class Part:
    """The bytes of a part in order, in pieces of at most CHUNK, from compressed byte `skip` on. Their checksum is not looked at, as splits stop before the end."""

    def __init__(self, file, info: zipfile.ZipInfo, skip: int = 0):
        self.file, self.left = file, info.compress_size - skip
        file.seek(info.header_offset)
        head = file.read(30)
        if head[:4] != b"PK\3\4" or info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise zipfile.BadZipFile(f"part {info.filename} can't be read")
        file.seek(info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little") + skip)
        self.inflate = zlib.decompressobj(-15) if info.compress_type == zipfile.ZIP_DEFLATED else None

    def _raw(self, most: int) -> bytes:
        raw = self.file.read(min(most, self.left))
        if self.left and not raw:
            raise zipfile.BadZipFile("the file ends within a part")
        self.left -= len(raw)
        return raw

    def read(self) -> bytes:
        """The next piece; none is left when it is empty."""
        if self.inflate is None:
            return self._raw(CHUNK)
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self._raw(CHUNK >> 3)
            out = self.inflate.decompress(raw, CHUNK)
            if out:
                return out
            if not raw:
                raise zipfile.BadZipFile("a part ends within its data")
        return b""


def _row_chunks(path: str, part: str, lo: int, hi: int) -> Iterator[bytes]:
    """The rows whose tags begin in bytes lo to hi of a part, in pieces of whole rows."""
    with open_file(path) as file, zipfile.ZipFile(file) as z:
        at, skip = max((p for p in pieces(z, part) if p[0] <= lo), default=(0, 0))
        f = Part(file, z.getinfo(part), skip)
        rest = f.read()
        while at + len(rest) <= lo:  # what comes before
            at += len(rest)
            rest = f.read()
            if not rest:
                return
        # rest: from byte `base` of the part on, not given out yet
        rest, base, begun = rest[lo - at :], lo, False
        if lo == 0:
            while not (m := _BEGIN.search(rest)) and not _END.search(rest):
                more = f.read()
                if not more:
                    return
                rest += more
            if not m:
                return
            base, rest, begun = m.end(), rest[m.end() :], True
        last = False
        while not last:
            more = f.read()
            last = not more
            rest += more
            if b"sheetData" in rest and (end := _END.search(rest, max(0, rest.index(b"sheetData") - 64))):
                rest, last = rest[: end.start()], True
            if not begun:
                if m := _ROW.search(rest):
                    if base + m.start() >= hi:
                        return
                    base, rest, begun = base + m.start(), rest[m.start() :], True
                elif not last:
                    keep = min(len(rest), 64)
                    base, rest = base + len(rest) - keep, rest[len(rest) - keep :]
                    continue
            if not begun:
                return
            if base + len(rest) > hi and (m := _ROW.search(rest, max(0, hi - base))):
                rest, last = rest[: m.start()], True
            if last:
                if rest:
                    yield rest
                return
            cut = rest.rfind(b"<row ")
            if cut <= 0:
                cut = max([0, *(m.start() for m in _ROW.finditer(rest))])
            if cut > 0:
                yield rest[:cut]
                base, rest = base + cut, rest[cut:]


#: Type attributes by number; anything else reads like none.
NONE, SHARED, STR, INLINE, BOOLEAN, ERR, DATE = range(7)
TYPES = {b"s": SHARED, b"str": STR, b"inlineStr": INLINE, b"b": BOOLEAN, b"e": ERR, b"d": DATE}
#: The bytes after `<` by the tag that they begin.
_C, _V, _END_V, _END_C, _ROW_TAG, _END_ROW = range(1, 7)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def spans_text(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from byte ranges of a buffer, copied once."""
    size = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    most = int(size.max()) if len(size) else 0
    if 0 < most <= 32 and (block := _at(buf, starts, most)) is not None:  # short ones side by side, without what follows them
        data = block.view(np.uint8)
        if offsets[-1] < len(data):
            data = data.reshape(-1, most)[np.arange(most) < size[:, None]]
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    data = buf[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _digits(buf: np.ndarray, at: np.ndarray, end: np.ndarray, most: int) -> np.ndarray | None:
    """Numbers written in buf[at:end], or None if any is not of 1 to `most` digits."""
    size = end - at
    if len(at) and (size.min() < 1 or size.max() > most):
        return None
    out = np.zeros(len(at), np.int64)
    for k in range(int(size.max()) if len(at) else 0):
        on = size > k
        c = buf[np.where(on, at + k, 0)]
        if not _DIGIT[c[on]].all():
            return None
        out = np.where(on, out * 10 + c - 48, out)
    return out


def _usual(chunk: bytes) -> tuple | None:
    """Cells of a chunk in the usual layout - `<c r=".." s=".." t=".."><v>..</v></c>` or closed at once - by whole arrays, or None if any cell has another."""
    buf = np.frombuffer(chunk, np.uint8)
    lt, gt = np.flatnonzero(buf == 60), np.flatnonzero(buf == 62)
    if len(lt) != len(gt) or not len(lt) or not ((lt < gt).all() and (gt[:-1] < lt[1:]).all()) or gt[-1] - lt[-1] < 2:
        return None
    one, two, three = buf[lt + 1], buf[lt + 2], buf[np.minimum(lt + 3, len(buf) - 1)]
    tag = np.zeros(len(lt) + 3, np.int8)
    own = tag[: len(lt)]
    own[(one == 99) & (two == 32)] = _C
    own[(one == 118) & (two == 62)] = _V
    own[(one == 47) & (two == 118) & (three == 62)] = _END_V
    own[(one == 47) & (two == 99) & (three == 62)] = _END_C
    own[(one == 114) & (two == 111) & (three == 119)] = _ROW_TAG
    own[(one == 47) & (two == 114) & (three == 111)] = _END_ROW
    if not own.all():
        return None
    cell = np.flatnonzero(own == _C)
    if not len(cell):
        return None
    start, stop = lt[cell], gt[cell]
    none = buf[stop - 1] == 47
    full = (tag[cell + 1] == _V) & (tag[cell + 2] == _END_V) & (tag[cell + 3] == _END_C)
    if not (none ^ full).all() or full.sum() != (own == _V).sum() or (own == _V).sum() != (own == _END_C).sum():
        return None
    if not ((buf[start + 3] == 114) & (buf[start + 4] == 61) & (buf[start + 5] == 34)).all():
        return None
    quotes = np.flatnonzero(buf == 34)
    q = np.searchsorted(quotes, start + 6)
    if q[-1] >= len(quotes):
        return None
    close = quotes[q]
    # A reference: one to three capital letters, then digits.
    cols, width, going = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64), np.ones(len(cell), bool)
    for k in range(3):
        c = buf[start + 6 + k]
        going &= (c >= 65) & (c <= 90)
        cols, width = np.where(going, cols * 26 + c - 64, cols), width + going
    rows = _digits(buf, start + 6 + width, close, 9)
    if rows is None or not width.all():
        return None
    styles, types = np.full(len(cell), -1, np.int32), np.zeros(len(cell), np.int8)
    inside_end = np.where(none, stop - 1, stop)
    todo = np.flatnonzero(close + 1 < inside_end)
    while len(todo):  # one more attribute of each cell that has any left
        at = close[todo] + 1
        which, q2 = buf[np.minimum(at + 1, len(buf) - 1)], q[todo] + 2
        if not ((buf[at] == 32) & (buf[np.minimum(at + 2, len(buf) - 1)] == 61) & (buf[np.minimum(at + 3, len(buf) - 1)] == 34) & (q2 < len(quotes))).all():
            return None
        end = quotes[q2]
        s, t = which == 115, which == 116
        if not (s | t).all():
            return None
        if s.any():
            if (n := _digits(buf, (at + 4)[s], end[s], 6)) is None:
                return None
            styles[todo[s]] = n
        if t.any():
            names = spans_text(buf, (at + 4)[t], end[t]).dictionary_encode()
            codes = np.array([TYPES.get(x.encode(), NONE) for x in names.dictionary.to_pylist()], np.int8)
            types[todo[t]] = codes[names.indices.to_numpy()]
        close[todo], q[todo] = end, q2
        todo = todo[close[todo] + 1 < inside_end[todo]]
    if (types == INLINE).any():
        return None
    value = np.minimum(cell + 1, len(lt) - 1)
    begin = np.where(none, 0, gt[value] + 1)
    finish = np.where(none, 0, lt[np.minimum(cell + 2, len(lt) - 1)])
    raw = spans_text(buf, begin, finish)
    if b"&" in chunk and pc.any(odd := pc.match_substring(raw, "&")).as_py():
        raw = pc.replace_with_mask(raw, odd, pa.array([html_entities(t) for t in raw.filter(odd).to_pylist()], pa.large_string()))
    if none.any():
        raw = pc.if_else(pa.array(none), pa.scalar(None, pa.large_string()), raw)
        styles[none] = -1
    return np.maximum(rows - 1, 0), (cols - 1).astype(np.int32), styles, types, raw


@dataclass
class Grid:
    """A chunk of rows that all have the same cells, all with values, with the same attributes. begin, end: where a column's values lie in buf."""

    path: str
    buf: np.ndarray
    rows: np.ndarray
    cols: list[int]
    styles: list[int]
    types: list[int]
    begin: list[np.ndarray]
    end: list[np.ndarray]

    def column(self, i: int, strings: bool = True) -> tuple[np.ndarray, pa.Array]:
        """Kinds and values of a column's cells, as in CELLS."""
        raw = spans_text(self.buf, self.begin[i], self.end[i])
        if (odd := _decoded(raw)) is not None:
            raw = odd
        types = np.full(len(raw), self.types[i], np.int8)
        return _kinds(self.path, types, raw, strings)

    def texts_only(self, i: int) -> bool:
        """Whether a column's cells are texts whatever their values are."""
        return self.types[i] == STR


def _decoded(raw: pa.Array) -> pa.Array | None:
    """Texts with their entities decoded; none, if there are none."""
    _, offsets, data = raw.buffers()
    if data is None or not (np.frombuffer(data, np.uint8) == 38).any():
        return None
    odd = pc.match_substring(raw, "&")
    return pc.replace_with_mask(raw, odd, pa.array([html_entities(t) for t in raw.filter(odd).to_pylist()], _TEXT))


_TEXT = pa.large_string()
_GRID_CELL = re.compile(rb'<c r="([A-Z]{1,3})([0-9]{1,9})"((?: [st]="[^"<>]*"){0,2})>')
_GRID_ATTRIBUTE = re.compile(rb' ([st])="([^"]*)"')


def _at(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray | None:
    """The `size` bytes at each place, or None if any would lie beyond the end."""
    if int(at.max()) + size > len(buf):
        return None
    return np.ndarray((len(buf) - size + 1,), f"V{size}", buf, strides=(1,))[at]


def _masked(size: int, words: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of eight bytes with all bits set in the first `size` bytes apart from lo to hi, and in lo to hi only."""
    fixed, digits = np.zeros(words * 8, np.uint8), np.zeros(words * 8, np.uint8)
    fixed[:size], digits[lo:hi] = 255, 255
    return (fixed & ~digits).view(np.uint64), digits.view(np.uint64)


def _grid(path: str, chunk: bytes) -> Grid | None:
    """A chunk as a grid, or None if it is none.

    Tags of the first row are read, those of the others compared with them byte by byte, apart from the digits of row
    numbers, which must be the same in all cells of a row. As a `<` only begins tags, there is nothing else in the rows.
    """
    stop = chunk.find(b"</row>")
    if stop < 0 or b"\r" in chunk:
        return None
    buf = np.frombuffer(chunk, np.uint8)
    lt = np.flatnonzero(buf == 60)
    each = int(np.searchsorted(lt, stop)) + 1
    if each < 6 or each % 4 != 2 or len(lt) % each:
        return None
    tags = np.ascontiguousarray(lt.reshape(-1, each).T)
    own, last = _at(buf, tags[0], 5), _at(buf, tags[-1], 6)
    if last is None or chunk[:5] not in (b"<row ", b"<row>") or not (own == own[0]).all() or not (last == last[0]).all():
        return None
    cols, styles, types, begin, end = [], [], [], [], []
    number, width, wrong = {}, 0, np.zeros(tags.shape[1], np.uint64)
    for k in range(1, each - 1, 4):
        a, b, c, d = (int(x) for x in tags[k : k + 4, 0])
        m = _GRID_CELL.fullmatch(chunk, a, b)
        if m is None or chunk[b : b + 3] != b"<v>" or chunk[c : c + 8] != b"</v></c>" or d != c + 4:
            return None
        size, (lo, hi) = b + 3 - a, (x - a for x in m.span(2))
        words = -(-size // 8)
        cell, after = _at(buf, tags[k], words * 8), _at(buf, tags[k + 2], 8)
        if cell is None or after is None or width not in (0, hi - lo):
            return None
        width, cell, after = hi - lo, cell.view(np.uint64).reshape(-1, words), after.view(np.uint64)
        fixed, digits = _masked(size, words, lo, hi)
        if lo not in number:  # where row numbers lie in cells with as many letters
            shown = _at(buf, tags[k] + lo, width)
            if number and not (shown == number[min(number)][1]).all():
                return None
            number[lo] = cell, shown
        wrong |= after ^ after[0]
        for w in range(words):
            wrong |= (cell[:, w] ^ cell[0, w]) & fixed[w]
            if digits[w]:
                wrong |= (cell[:, w] ^ number[lo][0][:, w]) & digits[w]
        given = _GRID_ATTRIBUTE.findall(m[3])
        known = dict(given)
        style, kind = known.get(b"s", b"0"), TYPES.get(known.get(b"t", b""), NONE)
        if len(known) != len(given) or not style.isdigit() or len(style) > 6 or kind == INLINE:
            return None
        cols.append(column_index(m[1].decode())), styles.append(int(style) if b"s" in known else -1), types.append(kind)
        begin.append(tags[k] + size), end.append(tags[k + 2])
    if wrong.any() or len(set(cols)) < len(cols):
        return None
    digits = number[min(number)][1].view(np.uint8).reshape(-1, width)
    if not _DIGIT[digits].all():
        return None
    rows = (digits - 48).astype(np.int64) @ (10 ** np.arange(width)[::-1]) - 1
    if rows[0] < 0 or not (rows[1:] > rows[:-1]).all():
        return None
    return Grid(path, buf, rows, cols, styles, types, begin, end)


def _parsed(chunk: bytes, state: dict) -> tuple:
    """Cells of a chunk of rows by an XML parser. state: the row and column that cells without a position continue from."""
    rows, cols, styles, types, values, closed = [], [], [], [], [], []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    cell: dict | None = None
    text: list[str] | None = None
    inside = []

    def start(tag: str, attrs: dict) -> None:
        nonlocal cell, text
        name = tag.rpartition(":")[2]
        inside.append(name)
        if name == "row":
            r = attrs.get("r")
            if r is None and not state["whole"]:
                raise NeedsOneSplit
            state["row"], state["col"] = int(r) - 1 if r and r.isdigit() else state["row"] + 1, -1
        elif name == "c":
            r = attrs.get("r")
            if r is None and not state["whole"]:
                raise NeedsOneSplit
            row, col = state["row"], state["col"] + 1
            if r and (m := re.match(r"([A-Za-z]*)([0-9]*)", r)):
                col = column_index(m[1].upper()) if m[1] else 0
                row = max(int(m[2]) - 1, 0) if m[2] else 0
            state["col"], state["row"] = col, row
            s = attrs.get("s")
            cell = {"row": row, "col": col, "s": int(s) if s and s.isdigit() else -1, "t": attrs.get("t", ""), "v": None, "at": parser.CurrentByteIndex}
        elif name in ("v", "t") and cell is not None:
            if name == "v" or "is" in inside and "rPh" not in inside:
                text = []

    def end(tag: str) -> None:
        nonlocal cell, text
        name = inside.pop()
        if name in ("v", "t") and text is not None and cell is not None:
            cell["v"] = (cell["v"] or "") + "".join(text)
            if name == "t" and cell["t"] not in ("inlineStr",):
                cell["t"] = "inlineStr"
            text = None
        elif name == "c" and cell is not None:
            rows.append(cell["row"]), cols.append(cell["col"]), styles.append(cell["s"]), types.append(TYPES.get(cell["t"].encode(), NONE))
            values.append(cell["v"])
            raw = chunk[max(0, parser.CurrentByteIndex - shift - 2) : max(0, parser.CurrentByteIndex - shift)]
            closed.append(cell["v"] is None and raw == b"/>")
            cell = None

    def data(s: str) -> None:
        if text is not None:
            text.append(s)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    opening = b"<sheetData>"
    shift = len(opening)
    parser.Parse(opening + chunk + b"</sheetData>", True)
    # `<v/>` has no value; expat tells it from `<v></v>` by nothing but its bytes.
    return np.array(rows, np.int64), np.array(cols, np.int32), np.array(styles, np.int32), np.array(types, np.int8), values, closed


_SELF_V = re.compile(rb"<(?:\w+:)?v(?:\s[^>]*)?/>")
_SELF_C = re.compile(rb"<(?:\w+:)?c(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?/>")


def cells(path: str, part: str, lo: int, hi: int, whole: bool, strings: bool = True) -> Iterator[pa.Table]:
    """Tables of CELLS, in file order, each of whole rows.

    value: the text of a number as written, decoded text, true or false, or null. style: -1 where the cell has no
    style or closes itself (such cells fix no column's date style). dateable: a number without a type of its own.
    """
    yield from chunks(path, part, lo, hi, whole, strings, False)


def chunks(path: str, part: str, lo: int, hi: int, whole: bool, strings: bool = True, grids: bool = True) -> Iterator[Grid | pa.Table]:
    """The same in file order, with a Grid where a chunk is one."""
    state = {"row": -1, "col": -1, "whole": whole}
    for chunk in _row_chunks(path, part, lo, hi):
        if grids and (grid := _grid(path, chunk)) is not None:
            state["row"] = int(grid.rows[-1])
            yield grid
            continue
        usual = _usual(chunk)
        if usual is not None:
            rows, cols, styles, types, raw = usual
            state["row"] = int(rows[-1])
        else:
            if not whole and (b"<!--" in chunk or b"<![CDATA[" in chunk):
                raise NeedsOneSplit
            if _SELF_V.search(chunk):
                chunk = _SELF_V.sub(b"", chunk)
            rows, cols, styles, types, values, closed = _parsed(chunk, state)
            if not len(rows):
                continue
            if any(closed):
                styles = np.where(np.array(closed), -1, styles)
            raw = pa.array(values, pa.large_string())
        yield _typed(path, rows, cols, styles, types, raw, strings)


def _all_digits(raw: pa.Array) -> np.ndarray:
    """Which texts are nothing but digits, one at least."""
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    run = np.zeros(int(at[-1]) + 1, np.int64)
    if at[-1]:
        np.cumsum(_DIGIT[np.frombuffer(data, np.uint8)[: at[-1]]], out=run[1:])
    size = at[1:] - at[:-1]
    return (run[at[1:]] - run[at[:-1]] == size) & (size > 0) & pc.is_valid(raw).to_numpy(zero_copy_only=False)


def _decimals(raw: pa.Array) -> np.ndarray | None:
    """INT or FLOAT of each text, if all are of at most 18 digits and at most one point; else None."""
    if not isinstance(raw, pa.Array) or not len(raw):
        return None
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(at)
    if data is None or size.min() < 1 or size.max() > 18:
        return None
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    points = np.flatnonzero(~_DIGIT[buf])
    kind = np.full(len(raw), INT, np.int8)
    if len(points):
        owner = np.searchsorted(at, points + at[0], "right") - 1
        if not (buf[points] == 46).all() or (owner[1:] == owner[:-1]).any() or (size[owner] < 2).any():
            return None
        kind[owner] = FLOAT
    return kind


def _typed(path: str, rows, cols, styles, types, raw: pa.Array, strings: bool) -> pa.Table:
    kind, raw = _kinds(path, types, raw, strings)
    return pa.table([pa.array(rows), pa.array(cols), pa.array(kind), raw, pa.array(styles), pa.array(types == NONE)], schema=CELLS)


def _kinds(path: str, types: np.ndarray, raw: pa.Array, strings: bool) -> tuple[np.ndarray, pa.Array]:
    """Kinds and values of cells from their types and texts."""
    kind = np.full(len(types), TEXT, np.int8)
    if (types == STR).all() and not raw.null_count:
        return kind, raw
    if (types == NONE).all() and not raw.null_count and (plain := _decimals(raw)) is not None:
        return plain, raw
    null = pc.is_null(raw).to_numpy(zero_copy_only=False)
    shared, number = types == SHARED, types == NONE
    plain = _all_digits(raw)
    is_int, is_float = plain & number, np.zeros(len(types), bool)
    if len(rest := np.flatnonzero(number & ~plain & ~null)):
        texts = raw.take(pa.array(rest))
        is_int[rest] = pc.match_substring_regex(texts, _INT).to_numpy(zero_copy_only=False)
        is_float[rest] = pc.match_substring_regex(texts, _FLOAT).to_numpy(zero_copy_only=False) & ~is_int[rest]
    if is_int.any():
        long = is_int & (pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False) > 18)
        for i in np.flatnonzero(long):
            if not -(2**63) <= int(raw[int(i)].as_py()) < 2**63:
                is_int[i], is_float[i] = False, True
    kind[is_int], kind[is_float] = INT, FLOAT
    kind[types == BOOLEAN], kind[types == ERR], kind[types == DATE] = BOOL, ERROR, ISO
    kind[null] = EMPTY
    if (bools := (kind == BOOL)).any():
        raw = pc.if_else(pa.array(bools), pc.if_else(pc.equal(raw, "0"), "false", "true"), raw)
    if shared.any() and strings:
        table = shared_strings(path)
        on = shared & ~null
        short = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False) <= 18
        at = pc.cast(pc.if_else(pa.array(on & plain & short), raw, pa.scalar(None, pa.large_string())), pa.int64())
        inside = pc.fill_null(pc.less(at, len(table)), False)
        beyond = pc.and_(pc.is_valid(at), pc.invert(inside)).to_numpy(zero_copy_only=False)
        looked = pc.take(table, pc.if_else(inside, at, pa.scalar(None, pa.int64())))
        if isinstance(looked, pa.ChunkedArray):
            looked = looked.combine_chunks()
        raw = pc.if_else(pa.array(shared), pc.if_else(pc.is_valid(at), looked, raw), raw)
        kind[beyond] = EMPTY
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    return kind, raw
