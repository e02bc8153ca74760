"""From a sheet to a scan plan: where it is cut, what its columns are called, and which types they have.

Every split summarises itself (a Spark job, or in line where there is no session); the summaries are small - some
flags for each column - and merge in any grouping, because types form a join semilattice and the date style of a
column is decided by its first styled cell.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

from ..sources import cells as X
from ..sources.opc import Workbook, cache, stamp

#: Uncompressed bytes of a split, and splits of a sheet at most: each inflates all that comes before it, which takes
#: INFLATE of the time of reading its cells, so that no number of splits is faster than 1 / INFLATE tasks.
SPLIT_BYTES, MAX_SPLITS, INFLATE = 16 << 20, 16, 0.06
#: Splits of a sheet that can be entered anywhere grow up to so many times SPLIT_BYTES, while so many rounds of tasks are left.
GROWN, ROUNDS = 4, 4


@dataclass
class Options:
    """How a sheet is read. Sheet names come before positions; rows to skip are 0-based sheet rows and never touch the header."""

    sheet_name: str | None = None
    sheet_idx: int | None = None
    header: bool = True
    skip_rows: list[int] = field(default_factory=list)
    batch_size: int | None = None
    metadata: bool = False
    columns: list[str] | None = None
    mode: str = "table"  # or cells
    date_detection: str = "column"  # or cell
    strict_dates: bool = False
    epoch_1904: bool = False
    splits: int | None = None
    case_sensitive: bool = False

    def __post_init__(self):
        if self.batch_size is not None and self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.mode not in ("table", "cells") or self.date_detection not in ("column", "cell"):
            raise ValueError("mode is table or cells, date_detection is column or cell")


@dataclass
class Plan:
    """All that a task needs. splits: lo, hi, rows before. locks: column -> row from which its numbers are dates."""

    path: str
    part: str
    options: Options
    whole: bool
    splits: list[tuple[int, int, int]]
    header_row: int | None
    names: list[str]
    types: list[str]
    locks: dict[int, int]
    n_rows: int
    epoch_1904: bool
    styles: list[bool]
    #: Columns in which no cell has a type.
    bare: list[int] = field(default_factory=list)
    #: The splits cut finer, for as many tasks as the sheet fills.
    tasks: list[tuple[int, int, int]] = field(default_factory=list, compare=False)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Plan:
        x = json.loads(text)
        return cls(**x | {"options": Options(**x["options"]), "locks": {int(k): v for k, v in x["locks"].items()}, "splits": [tuple(s) for s in x["splits"]], "tasks": [tuple(s) for s in x["tasks"]]})

    def fields(self) -> list[tuple[str, str]]:
        """Names and types of the result's columns."""
        if self.options.mode == "cells":
            return [("row", "long"), ("col", "int"), ("kind", "string"), ("value", "string")]
        own = list(zip(self.names, self.types, strict=True))
        if self.options.columns is not None:
            known = dict(own)
            if unknown := [c for c in self.options.columns if c not in known]:
                raise ValueError(f"no columns {unknown} in {self.names}")
            own = [(c, known[c]) for c in self.options.columns]
        return own + ([("_row", "long"), ("_ord", "long"), ("_batch_id", "long")] if self.options.metadata else [])

    def ddl(self) -> str | StructType:
        """The schema for Spark, which reads no text for an empty one."""
        return StructType() if not self.fields() else ", ".join("`{}` {}".format(n.replace("`", "``"), t) for n, t in self.fields())


def cut(path: str, part: str, options: Options, slots: int = MAX_SPLITS) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the sheet is one piece, and the byte ranges: no more than tasks that run at once, later ones shorter by what they inflate more.

    A sheet that can be entered anywhere has even ranges.
    """
    size = X.part_size(path, part)
    if X.enterable(path, part):
        n = options.splits or even(size, slots)
        return n == 1, evenly(0, max(size, 1), n)
    n = options.splits or max(1, min(MAX_SPLITS, slots, size // SPLIT_BYTES))
    edges = [int(size * (1 - (1 - INFLATE) ** i) / (1 - (1 - INFLATE) ** n)) for i in range(n + 1)]
    edges[-1] = max(size, 1)
    return n == 1, list(zip(edges[:-1], edges[1:], strict=True))


def even(size: int, slots: int) -> int:
    """How many even ranges: as many as there are of SPLIT_BYTES, of a large sheet fewer and longer ones, in whole rounds of tasks."""
    n = size // SPLIT_BYTES
    n = min(n, max(ROUNDS * slots, n // GROWN))
    return max(1, n if n <= slots else -(-n // slots) * slots)


def evenly(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    edges = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


FLAGS = ("int", "float", "bool", "text", "number_date", "int_before", "float_before")


def dates_by_style(styles: pa.Array, dates: list[bool]) -> np.ndarray:
    own = styles.to_numpy()
    table = np.array([*dates, False], bool)
    return table[np.where((own >= 0) & (own < len(dates)), own, len(dates))]


def summarise(path: str, part: str, lo: int, hi: int, whole: bool, options: Options, dates: list[bool], needed: set[int] | None = None) -> dict:
    """Rows, first row, and for each column (or those needed) the kinds met, split at the column's first styled cell.

    Kinds of the split's first row are given apart: if it is the sheet's first, it is the header. Skipped rows have no kinds but fix date styles.
    """
    n_rows, first, width, last = 0, None, 0, -1
    columns: dict[int, dict] = {}
    skip = set(options.skip_rows)
    first_cells: list[tuple] = []
    first_counts = 0
    for table in X.chunks(path, part, lo, hi, whole, grids=options.date_detection == "column"):
        if isinstance(table, X.Grid):
            if first is None:
                first = int(table.rows[0])
                first_counts = int(first not in skip)
            skipped = np.isin(table.rows, options.skip_rows)
            n_rows += int(((table.rows != last) & ~skipped).sum())
            last = int(table.rows[-1])
            width = max(width, *(c + 1 for c in table.cols))
            first_cells += summarise_grid(table, columns, first, (table.rows != first) & ~skipped, dates, needed)
            continue
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        kind, style = table["kind"].to_numpy(), table["style"].to_numpy()
        dateable = table["dateable"].to_numpy()
        is_date = dates_by_style(table["style"].combine_chunks(), dates)
        if first is None:
            first = int(row[0])
            first_counts = int(first not in skip)
        rows = np.unique(row)
        rows = rows[(rows != last) & ~np.isin(rows, options.skip_rows)]
        n_rows += len(rows)
        last = int(row[-1])
        on_first = row == first
        if on_first.any():
            values = table["value"].filter(pa.array(on_first)).to_pylist()
            first_cells += list(zip(col[on_first].tolist(), kind[on_first].tolist(), values, style[on_first].tolist(), dateable[on_first].tolist(), is_date[on_first].tolist(), strict=True))
        counted = ~on_first & ~np.isin(row, options.skip_rows)
        for c in np.unique(col).tolist():
            width = max(width, c + 1)
            if needed is not None and c not in needed:
                continue
            own = columns.setdefault(c, {"lock": None, "flags": dict.fromkeys(FLAGS, False)})
            at = col == c
            styled = np.flatnonzero(at & (style >= 0))
            if own["lock"] is None and len(styled):
                own["lock"] = [int(row[styled[0]]), bool(is_date[styled[0]])]
            locked = own["lock"] is not None
            begun = at & (row >= own["lock"][0]) if locked else np.zeros(len(at), bool)
            on, flags = at & counted, own["flags"]
            if options.date_detection == "cell":
                num = on & dateable & ((kind == X.INT) | (kind == X.FLOAT))
                flags["number_date"] |= bool((num & is_date).any())
                flags["int"] |= bool((num & ~is_date & (kind == X.INT)).any())
                flags["float"] |= bool((num & ~is_date & (kind == X.FLOAT)).any())
            else:
                flag_numbers(flags, kind, on, begun)
            flag_others(flags, kind, on)
    return {"n": n_rows, "first": first, "first_counts": first_counts, "first_cells": first_cells, "width": width, "columns": columns, "needed": None if needed is None else sorted(needed)}


def flag_numbers(flags: dict, kind: np.ndarray, on: np.ndarray, begun: np.ndarray) -> None:
    for name, k in (("int", X.INT), ("float", X.FLOAT)):
        if (met := on & (kind == k)).any():
            flags[name] |= bool((met & begun).any())
            flags[f"{name}_before"] |= bool((met & ~begun).any())


def flag_others(flags: dict, kind: np.ndarray, on: np.ndarray) -> None:
    flags["bool"] |= bool((on & (kind == X.BOOL)).any())
    flags["text"] |= bool((on & ((kind == X.TEXT) | (kind == X.ISO))).any())


def summarise_grid(grid: X.Grid, columns: dict[int, dict], first: int, counted: np.ndarray, dates: list[bool], needed: set[int] | None) -> list[tuple]:
    """Adds what a grid's columns (or those needed) hold to `columns`; gives all cells of the row `first`, if it is the grid's."""
    cells, leads = [], int(grid.rows[0]) == first
    for i, (c, style) in enumerate(zip(grid.cols, grid.styles, strict=True)):
        if needed is not None and c not in needed and not leads:
            continue
        own = columns.setdefault(c, {"lock": None, "flags": dict.fromkeys(FLAGS, False)})
        is_date = 0 <= style < len(dates) and bool(dates[style])
        if own["lock"] is None and style >= 0:
            own["lock"] = [int(grid.rows[0]), is_date]
        if grid.texts_only(i) and not leads:
            own["flags"]["text"] |= bool(counted.any())
            continue
        kind, raw = grid.column(i)
        if leads:
            cells.append((c, int(kind[0]), raw[0].as_py(), style, grid.types[i] == X.NONE, is_date))
        flag_numbers(own["flags"], kind, counted, grid.rows >= own["lock"][0] if own["lock"] is not None else np.zeros(len(kind), bool))
        flag_others(own["flags"], kind, counted)
    return cells


def header_of(path: str, part: str, whole: bool) -> list[tuple]:
    """Columns, kinds and values of the first row that has cells."""
    for table in X.chunks(path, part, 0, max(X.part_size(path, part), 1), whole):
        if isinstance(table, X.Grid):
            found = [(c, *table.column(i)) for i, c in enumerate(table.cols)]
            return [(c, int(kind[0]), raw[0].as_py()) for c, kind, raw in found]
        n = int((table["row"].to_numpy() == table["row"][0].as_py()).argmin()) or len(table)
        return list(zip(*(table[c].slice(0, n).to_pylist() for c in ("col", "kind", "value")), strict=True))
    return []


def needed_columns(path: str, part: str, whole: bool, options: Options) -> set[int] | None:
    """The columns whose types are needed, or None for all: those that `columns` names, by the header, which a worker process reads once."""
    if options.columns is None or options.mode == "cells":
        return None
    blank = "Unknown_" if options.header else "col_"
    out = {int(n[len(blank) :]) for n in options.columns if re.fullmatch(blank + "[0-9]{1,6}", n)}
    if options.header:
        key = (*stamp(path), part, whole)
        if cache().get("header", ("",))[0] != key:
            cache()["header"] = key, header_of(path, part, whole)
        try:
            out |= {i for i, n in enumerate(names_of(cache()["header"][1], 0, options)) if n in options.columns}
        except ValueError:  # as the plan will say
            return None
    return out


def type_of(kinds: set[str]) -> str:
    """The join of the kinds of a column; none at all is a string column of nulls."""
    if kinds and kinds <= {"int", "float"}:
        return "double" if "float" in kinds else "long"
    return {frozenset({"bool"}): "boolean", frozenset({"date"}): "timestamp_ntz"}.get(frozenset(kinds), "string")


def common_types(plans: list[Plan]) -> list[str]:
    """The join of the column types of sheets with the same columns; a column without typed cells fits any type."""
    names = [n for n, _ in plans[0].fields()]
    for p in plans:
        if [n for n, _ in p.fields()] != names:
            raise ValueError(f"{p.path} has columns {[n for n, _ in p.fields()]}, not {names}")
    out = []
    for i in range(len(plans[0].types)):
        found = {p.types[i] for p in plans if i not in p.bare}
        out.append(found.pop() if len(found) == 1 else "double" if found == {"long", "double"} else "string")
    return out


def merge(parts: list[dict], options: Options) -> tuple[int | None, list, dict[int, int], list[set[str]], list[int]]:
    """Header row and its cells, date locks, kinds of the columns, rows of each split without header and skipped ones."""
    width = max([0, *(p["width"] for p in parts)])
    header_row, header_cells = None, []
    counts = [p["n"] for p in parts]
    lead = next((i for i, p in enumerate(parts) if p["first"] is not None), None)
    if options.header and lead is not None:
        header_row, header_cells = parts[lead]["first"], parts[lead]["first_cells"]
        counts[lead] -= parts[lead]["first_counts"]
    kinds: list[set[str]] = [set() for _ in range(width)]
    locks: dict[int, int] = {}
    fixed: dict[int, list] = {}
    for p in parts:  # in file order: the first styled cell of a column decides
        for c, x in p["columns"].items():
            if x["lock"] is not None and int(c) not in fixed:
                fixed[int(c)] = x["lock"]
    for c, (row, is_date) in fixed.items():
        if is_date and options.date_detection == "column":
            locks[c] = row
    for i, p in enumerate(parts):
        for c, x in p["columns"].items():
            c, f = int(c), x["flags"]
            dated, before = c in locks and (x["lock"] is not None or locks[c] < (p["first"] or 0)), c in locks and locks[c] < (p["first"] or 0)
            for name in ("int", "float"):
                if f[name]:
                    kinds[c].add("date" if dated else name)
                if f[f"{name}_before"]:
                    kinds[c].add("date" if before else name)
            kinds[c] |= {k for k, on in (("bool", f["bool"]), ("string", f["text"]), ("date", f["number_date"])) if on}
        if i != lead or not options.header:
            if p["first_counts"]:
                for c, kind, _, _, dateable, is_date in p["first_cells"]:
                    number = kind in (X.INT, X.FLOAT)
                    as_date = number and (dateable and is_date if options.date_detection == "cell" else c in locks and p["first"] >= locks[c])
                    name = "date" if as_date else {X.INT: "int", X.FLOAT: "float", X.BOOL: "bool", X.TEXT: "string", X.ISO: "string"}.get(kind)
                    if name:
                        kinds[c].add(name)
    return header_row, header_cells, locks, kinds, counts


def plain_number(text: str) -> str:
    """The text of a number in a header: shortest digits, no exponent, no trailing .0."""
    x = float(text)
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(x)]
    return np.format_float_positional(x, trim="-")


def names_of(header: list | None, width: int, options: Options) -> list[str]:
    """Column names: by position, with Unknown_<n> (col_<n> without header) where the header has none."""
    if not options.header:
        return [f"col_{i}" for i in range(width)]
    out = {}
    for c, kind, value, *_ in header or ():
        out[c] = plain_number(value) if kind == X.FLOAT else str(int(value)) if kind == X.INT else value
    width = max([width, *(c + 1 for c in out)])
    names = [out.get(i) or f"Unknown_{i}" for i in range(width)]
    seen: set[str] = set()
    for n in names:
        if (k := n if options.case_sensitive else n.lower()) in seen:
            raise ValueError(f"duplicate column name '{n}' in the header")
        seen.add(k)
    return names


Runner = Callable[[list[tuple], Callable[[tuple], dict]], list[dict]]


def plan(path: str, options: Options, run: Runner | None = None, workbook: Workbook | None = None, every: bool = False) -> Plan:
    """The plan of a scan. run maps the summary over splits (in parallel, if it can). If only some columns are wanted, others have no types, unless `every` one is to have its own."""
    book = workbook or Workbook.open(path)
    part = book.part(options.sheet_name, options.sheet_idx)
    dates = book.date_styles(options.strict_dates)
    run = run or (lambda tasks, f: [f(t) for t in tasks])
    slots = getattr(run, "slots", MAX_SPLITS)
    whole, ranges = cut(path, part, options, slots)
    summary = _summary(path, part, options, dates, every)
    # However few splits are asked for, a sheet that can be entered anywhere is summarised in as many tasks as it fills.
    each = 1 if whole or not X.enterable(path, part) else -(-even(X.part_size(path, part), slots) // len(ranges))
    try:
        parts = run([(*r, whole) for lo, hi in ranges for r in evenly(lo, hi, each)], summary)
        cut_up = not whole and any("error" in p for p in parts)
    except X.NeedsOneSplit:
        cut_up = True
    if cut_up:
        whole, ranges, each = True, [(0, max(X.part_size(path, part), 1))], 1
        parts = run([(*ranges[0], True)], summary)
    header_row, header_cells, locks, kinds, counts = merge(parts, options)
    names = names_of(header_cells, len(kinds), options)
    if (needed := parts[0]["needed"]) is not None:
        if any(n in options.columns and i not in needed for i, n in enumerate(names)):  # a header in several places
            return plan(path, options, run, book, True)
        kinds, locks = [k if i in needed else set() for i, k in enumerate(kinds)], {c: r for c, r in locks.items() if c in needed}
    types = [type_of(k) for k in kinds] + ["string"] * (len(names) - len(kinds))
    before, splits, tasks = 0, [], []
    for i, (lo, hi) in enumerate(ranges):
        splits.append((lo, hi, before))
        for r, n in zip(evenly(lo, hi, each), counts[i * each : (i + 1) * each], strict=True):
            tasks.append((*r, before))
            before += n
    return Plan(path, part, options, whole, splits, header_row, names, types, locks, before, options.epoch_1904 and book.date1904, dates, [i for i in range(len(names)) if i >= len(kinds) or not kinds[i]], tasks if each > 1 else [])


def _summary(path: str, part: str, options: Options, dates: list[bool], every: bool) -> Callable[[tuple], dict]:
    def one(task: tuple) -> dict:
        lo, hi, whole = task
        try:
            return summarise(path, part, lo, hi, whole, options, dates, None if every else needed_columns(path, part, whole, options))
        except X.NeedsOneSplit:
            return {"error": "one split"}

    return one


# ---- reading under a plan ----

ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "int": pa.int32()}
DAY_MS = 86_400_000


def serial_micros(serial: np.ndarray, epoch_1904: bool = False) -> np.ndarray:
    """Spreadsheet serials as microseconds since 1970: whole days by floor, the signed fraction rounded to milliseconds (away from zero at halves)."""
    days = np.floor(serial)
    shift = np.where((days > 0) & (days <= 60) & (serial >= 1), -25568, -25569)
    if epoch_1904:
        shift = np.full(len(serial), -24107)
    part = (serial - np.trunc(serial)) * DAY_MS
    ms = np.where(part < 0, -np.floor(-part + 0.5), np.floor(part + 0.5))
    return (((days + shift).astype(np.int64) * DAY_MS) + ms.astype(np.int64)) * 1000


def _stamp_text(us: np.ndarray) -> list[str]:
    text = np.datetime_as_string(us.astype("datetime64[us]").astype("datetime64[ms]"))
    return [t.replace("T", " ").removesuffix(".000") for t in text.tolist()]


def _unsigned(raw: pa.Array) -> pa.Array:
    """Numbers without a plus sign before them."""
    data = raw.buffers()[2]
    return pc.replace_substring_regex(raw, r"^\+", "") if data is not None and (np.frombuffer(data, np.uint8) == 43).any() else raw


def _numbers(raw: pa.Array) -> np.ndarray:
    try:
        return pc.cast(_unsigned(raw), pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # infinity in words, a bare point at an end
        return np.array([float(t) for t in raw.to_pylist()], np.float64)


def convert(kind: np.ndarray, raw: pa.Array, date: np.ndarray, to: str, epoch_1904: bool) -> pa.Array:
    """Values of one column in its type. date: which numbers are dates. What can't be converted is null."""
    nothing = (kind == X.EMPTY) | (kind == X.ERROR)
    number = (kind == X.INT) | (kind == X.FLOAT)
    keep = lambda on: raw if on.all() else pc.if_else(pa.array(on), raw, pa.scalar(None, raw.type))
    if to == "long":
        return pc.cast(_unsigned(keep(kind == X.INT)), pa.int64())
    if to == "double":
        text = _unsigned(keep(number))
        try:
            return pc.cast(text, pa.float64())
        except pa.ArrowInvalid:  # infinity in words, a bare point at an end
            return pa.array([None if t is None else float(t) for t in text.to_pylist()], pa.float64())
    if to == "boolean":
        return pc.equal(keep(kind == X.BOOL), "true")
    if to == "timestamp_ntz":
        on = number & date
        serial = np.zeros(len(kind))
        serial[on] = _numbers(raw.filter(pa.array(on)))
        on &= np.isfinite(serial)
        return pa.array(serial_micros(np.where(on, serial, 0), epoch_1904), pa.timestamp("us"), mask=~on)
    out = keep(~nothing)
    if (on := number & date).any():
        serial = _numbers(raw.filter(pa.array(on)))
        out = pc.replace_with_mask(out, pa.array(on), pa.array(_stamp_text(serial_micros(serial, epoch_1904)), out.type))
    return out.cast(pa.string())


def read(p: Plan, split: int, batch_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of a split in file order. With a batch size, batches end where batches of the sheet end."""
    lo, hi, ordinal = p.splits[split]
    o = p.options
    skip = np.array(sorted({*o.skip_rows, *([p.header_row] if p.header_row is not None else [])}), np.int64)
    wanted = p.fields()
    schema = pa.schema([(n, ARROW[t]) for n, t in wanted])
    place = {n: i for i, n in enumerate(p.names)}
    for table in X.chunks(p.path, p.part, lo, hi, p.whole, grids=o.mode != "cells" and o.date_detection == "column"):
        if isinstance(table, X.Grid):
            on = ~np.isin(table.rows, skip)
            if (batch := _rows_of_grid(p, table, on, ordinal, wanted, place, schema)).num_rows:
                yield from _sliced(batch, o.batch_size, ordinal, batch_rows)
                ordinal += batch.num_rows
            continue
        row, col, kind = (table[c].to_numpy() for c in ("row", "col", "kind"))
        raw = table["value"].combine_chunks()
        raw = raw if not isinstance(raw, pa.ChunkedArray) else pa.concat_arrays(raw.chunks)
        by_style = dates_by_style(table["style"].combine_chunks(), p.styles) if o.date_detection == "cell" else None
        if o.mode == "cells":
            names = pc.take(pa.array(X.KINDS), pa.array(kind.astype(np.int64)))
            out = pa.table([table["row"], table["col"], names, raw.cast(pa.string())], schema=schema)
            yield from out.to_batches(batch_rows)
            continue
        on = ~np.isin(row, skip)
        if not on.any():
            continue
        live = np.unique(row[on])
        slot = np.searchsorted(live, row)
        values = []
        for name, kind_of in wanted:
            if name not in place:
                values.append(_metadata(name, live, ordinal, o))
                continue
            c = place[name]
            own = np.flatnonzero(on & (col == c))
            where = np.full(len(live), -1, np.int64)
            where[slot[own]] = np.arange(len(own))
            date = (row[own] >= p.locks[c] if c in p.locks else np.zeros(len(own), bool)) if by_style is None else by_style[own] & table["dateable"].to_numpy()[own]
            got = convert(kind[own], raw.take(pa.array(own)), date, kind_of, p.epoch_1904)
            values.append(pc.take(got, pa.array(where, mask=where < 0)) if len(own) else pa.nulls(len(live), ARROW[kind_of]))
        batch = pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v.astype(np.int64)) for v in values], schema=schema)
        yield from _sliced(batch, o.batch_size, ordinal, batch_rows)
        ordinal += len(live)


def _metadata(name: str, live: np.ndarray, ordinal: int, o: Options) -> np.ndarray:
    place = ordinal + np.arange(len(live))
    return {"_row": live, "_ord": place, "_batch_id": place // (o.batch_size or 2**62)}[name]


def _sliced(batch: pa.RecordBatch, size: int | None, ordinal: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most `most` rows; they end where batches of the sheet end."""
    at = 0
    while at < batch.num_rows:
        n = most if not size else min(most, size - (ordinal + at) % size)
        yield batch.slice(at, n)
        at += n


def _rows_of_grid(p: Plan, grid: X.Grid, on: np.ndarray, ordinal: int, wanted: list, place: dict, schema: pa.Schema) -> pa.RecordBatch:
    """The wanted columns of those rows of a grid; of others nothing is read."""
    values, live = [], grid.rows[on]
    for name, to in wanted:
        if name not in place:
            values.append(pa.array(_metadata(name, live, ordinal, p.options).astype(np.int64)))
        elif (c := place[name]) not in grid.cols:
            values.append(pa.nulls(len(live), ARROW[to]))
        else:
            kind, raw = grid.column(grid.cols.index(c))
            if len(live) < len(kind):
                kind, raw = kind[on], raw.filter(pa.array(on))
            values.append(convert(kind, raw, live >= p.locks[c] if c in p.locks else np.zeros(len(live), bool), to, p.epoch_1904))
    return pa.RecordBatch.from_arrays(values, schema=schema)
