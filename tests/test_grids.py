"""Chunks whose rows are all alike are read by columns: with the same result as cell by cell, and only where they are alike."""

import numpy as np
import pyarrow as pa
import pytest

from sheetframe.plans import scan
from sheetframe.plans.scan import Options
from sheetframe.sources import cells as X
from sheetframe.sources.opc import Workbook
from sheetframe.sources.writer import raw_xlsx

STYLES = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
STRINGS = "<sst><si><t>a&amp;b</t></si><si><t>é</t></si></sst>"
COLUMNS = {
    "A": ("", ["1", "+7", "-3", "0012", "9223372036854775807", "9223372036854775808", "5."]), "B": ("", ["1.5", ".5", "1E5", "-0.25", "inf", "1..2", "."]),
    "C": (' t="str"', ["x", "", "a &lt;b&gt; &amp;amp;", "é🎉", "1", " ", "y" * 90]), "D": (' t="s"', ["0", "1", "99", "zz", "", "0", "1"]),
    "E": (' t="b"', ["0", "1", "true", "", "0", "1", "0"]), "F": (' s="1"', ["45000", "45000.25", "0.5", "60", "1", "x", ""]),
    "Z": (' s="0" t="e"', ["#N/A"] * 7), "AA": (' t="d"', ["2024-01-02"] * 7), "AB": (' s="9"', [str(i) for i in range(7)]),
}


def row(r: int, i: int, but: str = "", **columns) -> str:
    return f'<row r="{r}" spans="1:28">' + "".join(f'<c r="{c}{r}"{a}><v>{v[i % len(v)]}</v></c>' for c, (a, v) in (columns or COLUMNS).items() if c != but) + "</row>"


def book(folder, rows: str) -> str:
    return raw_xlsx(str(folder / "b.xlsx"), {"S": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"}, strings=STRINGS, styles=STYLES)


def all_of(path: str, **options) -> tuple:
    p = scan.plan(path, Options(splits=1, **options))
    return p, pa.Table.from_batches([b for i in range(len(p.splits)) for b in scan.read(p, i)])


ALIKE = "".join(row(r, r) for r in range(10, 99))
HEAD = '<row r="9">' + "".join(f'<c r="{c}9" t="str"><v>n{c}</v></c>' for c in COLUMNS) + "</row>"


@pytest.mark.parametrize("options", [{}, {"skip_rows": [9, 11, 40]}, {"header": False}, {"header": False, "skip_rows": [9]}, {"batch_size": 7, "metadata": True}, {"columns": ["nB", "nAA"]}, {"date_detection": "cell"}], ids=str)
@pytest.mark.parametrize("plain", [False, True])
def test_grids_give_what_cells_give(tmp_path, monkeypatch, options, plain):
    """Odd values of every type, or plain ones of which each column's are of one kind."""
    kept = {"A": ("", ["1", "22"]), "B": ("", ["1.5", "2"]), "C": (' t="str"', ["x", "yy"]), "D": (' s="1"', ["45000", "45000.5"])}
    rows = "".join(row(r, r, **kept) for r in range(10, 99)) if plain else ALIKE
    head = "" if not options.get("header", True) else '<row r="9">' + "".join(f'<c r="{c}9" t="str"><v>n{c}</v></c>' for c in (kept if plain else COLUMNS)) + "</row>"
    if plain and "columns" in options:
        options = {"columns": ["nD", "nA"]}
    path = book(tmp_path, head + rows)
    real = X._row_chunks
    monkeypatch.setattr(X, "_row_chunks", lambda *a: (c for chunk in real(*a) for c in (chunk[: len(head)], chunk[len(head) :]) if c))
    part = Workbook.open(path).part()
    grids = [x for x in X.chunks(path, part, 0, 1 << 30, True) if isinstance(x, X.Grid)]
    assert sum(len(g.rows) for g in grids) == 89 + bool(head)
    got = all_of(path, **options)
    monkeypatch.setattr(X, "_grid", lambda *_: None)
    assert got == all_of(path, **options)


@pytest.mark.parametrize("odd", [
    row(99, 1, but="B"), row(99, 1) .replace(' t="str"', ' t="s"'), row(99, 1).replace('"C99"', '"C98"'), row(99, 1).replace("<v>1</v>", "<v/>", 1), row(99, 1).replace("</c>", "<!-- c --></c>", 1),
    row(99, 1).replace("<v>", "<f>1</f><v>", 1), row(100, 1), row(99, 1).replace("B99", "b99"), row(98, 1), row(99, 1).replace("<v>+7</v>", "<v>+\r\n7</v>"), '<row r="99"/>',
])
def test_other_rows_are_no_grid(odd):
    assert X._grid("", (ALIKE).encode()) is not None and X._grid("", (ALIKE + odd).encode()) is None and X._grid("", (odd + ALIKE).encode()) is None


def test_rows_of_a_grid():
    g = X._grid("", ALIKE.encode())
    assert (g.rows == np.arange(9, 98)).all() and g.cols == [0, 1, 2, 3, 4, 5, 25, 26, 27] and g.styles == [-1, -1, -1, -1, -1, 1, 0, -1, 9]
    kind, raw = g.column(2)
    assert raw.to_pylist()[:7] == ["é🎉", "1", " ", "y" * 90, "x", "", "a <b> &amp;"] and (kind == X.TEXT).all()


def test_large_sheets_have_fewer_longer_splits():
    sizes = [scan.even(m << 20, 12) for m in (1, 100, 700, 13_000, 78_000)]
    assert sizes == [1, 6, 48, 204, 1224]
