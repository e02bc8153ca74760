"""A plan for some columns looks at the values of those alone, and gives what a plan for all gives."""

import pyarrow as pa
import pytest

from sheetframe.plans import scan
from sheetframe.plans.scan import Options
from sheetframe.sources import cells as X
from sheetframe.sources.writer import raw_xlsx

STYLES = '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
STRINGS = "<sst><si><t>d</t></si></sst>"
HEAD = '<row r="1"><c r="A1" t="str"><v>a</v></c><c r="B1" t="str"><v>b</v></c><c r="C1" t="str"><v>c</v></c><c r="D1" t="s"><v>0</v></c></row>'


def book(folder, rows: str) -> str:
    return raw_xlsx(str(folder / "b.xlsx"), {"S": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"}, strings=STRINGS, styles=STYLES)


def row(r: int, last: str = "") -> str:
    return f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><v>{r}.5</v></c><c r="C{r}" t="str"><v>t{r}</v></c><c r="D{r}" s="1"><v>{45000 + r}</v></c>{last}</row>'


def rows_of(path: str, **options) -> pa.Table:
    p = scan.plan(path, Options(**options))
    return pa.Table.from_batches([b for i in range(len(p.splits)) for b in scan.read(p, i)])


@pytest.mark.parametrize("grids", [True, False])
@pytest.mark.parametrize("options", [{}, {"splits": 1}, {"splits": 7}, {"header": False}, {"skip_rows": [5, 6]}, {"date_detection": "cell"}, {"metadata": True, "batch_size": 3}], ids=str)
@pytest.mark.parametrize("mixed", ["", '<row r="90"><c r="A90"><v>0.5</v></c><c r="D90" t="b"><v>1</v></c><c r="F90"><v>6</v></c></row>'])
def test_some_columns_are_as_among_all(tmp_path, monkeypatch, grids, options, mixed):
    path = book(tmp_path, HEAD + "".join(row(r) for r in range(2, 90)) + mixed)
    if not grids:
        monkeypatch.setattr(X, "_grid", lambda *_: None)
    whole = rows_of(path, **options)
    meta = ["_row", "_ord", "_batch_id"] if "metadata" in options else []
    for wanted in (["d", "a"], ["b"], ["Unknown_5", "c"]) if options.get("header", True) else (["col_3", "col_0"], ["col_1"]):
        if set(wanted) <= set(whole.column_names):
            assert rows_of(path, columns=wanted, **options) == whole.select(wanted + meta)
    with pytest.raises(ValueError, match="no columns"):
        scan.plan(path, Options(columns=["z"], **options)).fields()


def test_values_of_other_columns_are_not_looked_at(tmp_path, monkeypatch):
    path = book(tmp_path, HEAD + "".join(row(r) for r in range(2, 90)))
    chunk = X._row_chunks
    monkeypatch.setattr(X, "_row_chunks", lambda *a: (c for x in chunk(*a) for c in (x[: len(HEAD)], x[len(HEAD) : x.rindex(b"<row ", 0, 3000)], x[x.rindex(b"<row ", 0, 3000) :])))
    looked, column = [], X.Grid.column
    monkeypatch.setattr(X.Grid, "column", lambda self, i, *a: looked.append((int(self.rows[0]), self.cols[i])) or column(self, i, *a))
    p = scan.plan(path, Options(columns=["d", "a"], splits=1))
    assert {c for r, c in looked if r > 0} == {0, 3} and dict(p.fields()) == {"d": "timestamp_ntz", "a": "long"}


def test_header_in_several_places(tmp_path, monkeypatch):
    """Cells of the first row that come again further down name their columns too."""
    path = book(tmp_path, HEAD + "".join(row(r, f'<c r="E{r}"><v>{r}</v></c>') for r in range(2, 50)) + '<row r="1"><c r="E1" t="str"><v>e</v></c></row>')
    chunk = X._row_chunks
    monkeypatch.setattr(X, "_row_chunks", lambda *a: (c for x in chunk(*a) for c in (x[: len(HEAD)], x[len(HEAD) :])))
    assert scan.plan(path, Options(columns=["e"])).fields() == [("e", "long")] == scan.plan(path, Options()).fields()[4:]


def test_equal_names_are_an_error_on_the_driver(spark, tmp_path, monkeypatch):
    from sheetframe.sources.xlsx import sheet

    path = book(tmp_path, HEAD.replace("<v>b<", "<v>A<") + "".join(row(r) for r in range(2, 50)))
    with pytest.raises(ValueError, match="duplicate column name 'A'"):
        sheet(spark, path, Options(columns=["d"], splits=3))
