"""Workbooks from DataFrames, written by tasks.

A sheet's compressed part is a row of pieces, each of which can be inflated by itself. Tasks keep the rows of their
partitions in a shared folder and count them; when every row has its number, other tasks write them as pieces. The
driver gets counts and sizes, and puts the pieces' bytes one after the other. Where pieces begin is written into a
part of its own beside the sheet, which readers of this package use to enter the sheet anywhere; others pass it over.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .writer import _ILLEGAL, HEAD, TAIL, SheetWriter, column_name, member, number, temporary, write_parts

#: Uncompressed bytes of a piece, Arrow bytes of a file of kept rows, and how hard pieces are compressed.
PIECE, KEPT, LEVEL = 4 << 20, 32 << 20, 1
#: Types whose cells are written by whole arrays; of frames with any other the rows go through the driver.
KINDS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def writable(df: DataFrame) -> bool:
    """Whether tasks can write a frame: its columns have cells, and there is a folder that they share with the driver."""
    if not df.columns or not all(isinstance(f.dataType, KINDS) for f in df.schema.fields):
        return False
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return spark.sparkContext.master.startswith("local") if shared is None else "://" not in re.sub("^file:/*", "/", shared)


# ---- cells by whole arrays ----

_ODD = re.compile(rb"[&<>\x00-\x08\x0b-\x1f]|\xef\xbf[\xbe\xbf]")
_TEXT = pa.large_string()


def _numbers(x: np.ndarray) -> pa.Array:
    """number() of each: the shortest text that reads back as x, whole ones without a point."""
    size = np.abs(x)
    whole = (size < 1e15) & (np.trunc(x) == x)
    ints = pa.array(np.where(whole, x, 0).astype(np.int64)).cast(_TEXT)
    if whole.all():
        return ints
    out = pc.if_else(pa.array(whole), ints, pa.array(x).cast(_TEXT))
    if (odd := ~whole & ((size >= 1e10) | (size < 1e-3))).any():  # Arrow has its own places for exponents
        out = pc.replace_with_mask(out, pa.array(odd), pa.array([number(v) for v in x[odd].tolist()], _TEXT))
    return out


def _serials(us: np.ndarray) -> np.ndarray:
    """serial() of microseconds since 1970."""
    days, rest = np.divmod(us, 86_400_000_000)
    seconds, micros = np.divmod(rest, 1_000_000)
    return (days + 25569) + (seconds + micros // 1000 / 1000) / 86400


def _escaped(a: pa.Array) -> pa.Array:
    """escape() of each."""
    _, offsets, data = a.buffers()
    ends = np.frombuffer(offsets, np.int64)[[a.offset, a.offset + len(a)]]
    if data is None or not _ODD.search(memoryview(data)[ends[0] : ends[1]]):
        return a
    a = pc.replace_substring_regex(a, _ILLEGAL.pattern, "")
    for raw, text in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        a = pc.replace_substring(a, raw, text)
    return a


def _values(a: pa.Array) -> tuple[str, pa.Array]:
    """Attributes of a column's cells, and the cells' values; null where there is none."""
    t = a.type
    if pa.types.is_boolean(t):
        return ' t="b"', pc.if_else(a, pa.scalar("1", _TEXT), pa.scalar("0", _TEXT))
    if pa.types.is_integer(t):
        return "", a.cast(_TEXT)
    if pa.types.is_floating(t):
        x = a.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        on = np.isfinite(x)
        out = _numbers(np.where(on, x, 0))
        return "", out if on.all() else pc.if_else(pa.array(on), out, pa.scalar(None, _TEXT))
    if pa.types.is_date(t) or pa.types.is_timestamp(t):
        if pa.types.is_date(t):
            serials = (a.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 25569).astype(np.float64)
        else:
            if t.tz is not None:  # the time of the session's zone
                a = a.cast(pa.timestamp("us")) if t.tz == "UTC" else pc.local_timestamp(a)
            serials = _serials(a.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        out = _numbers(serials)
        return ' s="1"', pc.if_else(a.is_valid(), out, pa.scalar(None, _TEXT)) if a.null_count else out
    if pa.types.is_decimal(t):
        return ' t="str"', pa.array([None if v is None else str(v) for v in a.to_pylist()], _TEXT)
    return ' t="str"', _escaped(a.cast(_TEXT))


def rows_xml(batch: pa.RecordBatch, first: int) -> memoryview:
    """Rows of a sheet, numbered from `first` on."""
    at = pa.array(np.arange(first, first + batch.num_rows)).cast(_TEXT)
    parts: list = ['<row r="', at, '">']
    for c, column in enumerate(batch.columns):
        extra, value = _values(column)
        cell = [f'<c r="{column_name(c)}', at, f'"{extra}><v>', value, "</v></c>"]
        parts += [_joined(cell)] if value.null_count else cell
    out = _joined([*parts, "</row>"], null_handling="replace")
    _, offsets, data = out.buffers()
    ends = np.frombuffer(offsets, np.int64)[[out.offset, out.offset + len(out)]]
    return memoryview(data)[ends[0] : ends[1]]


def _joined(parts: list, **options) -> pa.Array:
    """Texts side by side; those that follow each other are one."""
    flat: list = []
    for p in parts:
        if isinstance(p, str) and flat and isinstance(flat[-1], str):
            flat[-1] += p
        else:
            flat.append(p)
    return pc.binary_join_element_wise(*(pa.scalar(p, _TEXT) if isinstance(p, str) else p for p in flat), pa.scalar("", _TEXT), **options)


# ---- tasks ----

def _keep(folder: str):
    """Keeps the rows of a partition in files; gives their names and rows. A task that is run again writes files of other names."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size, n, out, name = TaskContext.get().partitionId(), 0, 0, 0, None, ""

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n": n}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n", pa.int64())]))

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                size, n, name = 0, 0, uuid.uuid4().hex
                out = pa.ipc.new_stream(f"{folder}/{name}", b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(b)
            size, n = size + b.nbytes, n + b.num_rows
            if size >= KEPT:
                yield done()
                out, seq = None, seq + 1
        if out is not None:
            yield done()

    return keep


def _press(folder: str):
    """Writes kept rows as pieces; gives the file, its checksum, and the bytes of each piece before and after."""

    def press(task: tuple) -> dict:
        name, first = task
        place, crc, pieces, held = f"{name}.{uuid.uuid4().hex}", 0, [], 0
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15, 9)
        with open(f"{folder}/{place}", "wb") as out, pa.ipc.open_stream(f"{folder}/{name}") as rows:
            begun = 0

            def close() -> None:
                nonlocal held, begun
                out.write(deflate.flush(zlib.Z_FULL_FLUSH))
                pieces.append((held, out.tell() - begun))
                held, begun = 0, out.tell()

            for b in rows:
                step = max(1, b.num_rows * PIECE // 4 // max(b.nbytes, 1))
                for i in range(0, b.num_rows, step):
                    own = b.slice(i, step)
                    xml = rows_xml(own, first)
                    first += own.num_rows
                    crc, held = zlib.crc32(xml, crc), held + len(xml)
                    out.write(deflate.compress(xml))
                    if held >= PIECE:
                        close()
            if held:
                close()
        return {"place": place, "crc": crc, "pieces": pieces}

    return press


def crc_joined(a: int, b: int, size: int) -> int:
    """The CRC-32 of two texts one after the other: a's, b's, and b's bytes. Zeros after a text act on its checksum as a matrix over GF(2)."""
    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = [times(m, r) for r in m]  # one zero byte
    while size:
        if size & 1:
            a = times(m, a)
        size >>= 1
        m = [times(m, r) for r in m] if size else m
    return a ^ b


# ---- the workbook ----

def _sheet(z: zipfile.ZipFile, i: int, df: DataFrame, header: list[str] | None, strings: dict[str, int], folder: str) -> None:
    """One sheet of a workbook, and the list of its pieces."""
    from .xlsx import runner

    writer = SheetWriter(strings)
    head = (HEAD + (writer.row(header) if header is not None else "")).encode()
    own = f"{folder}/{i}"
    os.makedirs(own)
    kept = sorted(tuple(r) for r in df.mapInArrow(_keep(own), "part int, seq int, name string, n long").collect())
    tasks, at = [], writer.rows + 1
    for _, _, name, n in kept:
        tasks.append((name, at))
        at += n
    pressed = runner(df.sparkSession)(tasks, _press(own)) if tasks else []
    for name, _ in tasks:
        os.remove(f"{own}/{name}")
    info = member(f"xl/worksheets/sheet{i}.xml")

    def alone(data: bytes, end: int) -> bytes:
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush(end)

    first, last = alone(head, zlib.Z_FULL_FLUSH), alone(TAIL.encode(), zlib.Z_FINISH)
    crc, size, packed, entries = zlib.crc32(head), len(head), len(first), [(0, 0)]
    for p in pressed:
        bytes_of = sum(n for n, _ in p["pieces"])
        crc = crc_joined(crc, p["crc"], bytes_of)
        for n, m in p["pieces"]:
            entries.append((size, packed))
            size, packed = size + n, packed + m
    info.CRC, info.file_size, info.compress_size = crc_joined(crc, zlib.crc32(TAIL.encode()), len(TAIL)), size + len(TAIL), packed + len(last)
    info.header_offset = z.fp.tell()
    z.fp.write(info.FileHeader(zip64=True))
    z.fp.write(first)
    for p in pressed:
        with open(f"{own}/{p['place']}", "rb") as f:
            shutil.copyfileobj(f, z.fp, 1 << 22)
        os.remove(f"{own}/{p['place']}")
    z.fp.write(last)
    z.start_dir = z.fp.tell()
    z.filelist.append(info)
    z.NameToInfo[info.filename] = info
    z.writestr(member(f"xl/worksheets/sheet{i}.pieces.xml"), f'<pieces size="{info.file_size}" packed="{info.compress_size}" crc="{info.CRC}">' + "".join(f'<p b="{b}" z="{m}"/>' for b, m in entries) + "</pieces>")


def write_frames(path: str, sheets: list[tuple[str, DataFrame, bool]]) -> None:
    """A workbook of (name, rows in their order, whether with a header). The file appears at once, when it is complete."""
    strings: dict[str, int] = {}
    partial, folder = f"{path}.{uuid.uuid4().hex}.part", temporary()
    try:
        with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED, compresslevel=4) as z:
            for i, (_, df, header) in enumerate(sheets, 1):
                _sheet(z, i, df, df.columns if header else None, strings, folder)
            write_parts(z, [name for name, _, _ in sheets], strings)
        os.replace(partial, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
