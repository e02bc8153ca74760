"""Hand-written sheets, one for each rule of reading, against literal rows."""

import datetime as dt
import os
import zipfile

import pytest

from sheetframe.operators.reader import read_xlsx
from sheetframe.plans.scan import Options, cut, plan, serial_micros
from sheetframe.sources import sinks
from sheetframe.sources.cells import Part
from sheetframe.sources.opc import Workbook, is_date_code
from sheetframe.sources.writer import raw_xlsx, write_xlsx
from sheetframe.sources.xlsx import sheet

STYLES = (
    '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.00"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>'
)


def text(ref, value, extra=""):
    return f'<c r="{ref}" t="inlineStr"{extra}><is><t>{value}</t></is></c>'


def head(*names):
    return '<row r="1">' + "".join(text(f"{chr(65 + i)}1", n) for i, n in enumerate(names)) + "</row>"


def num(ref, value, extra=""):
    return f'<c r="{ref}"{extra}><v>{value}</v></c>'


def make(tmp_path, body, name="t", whole=False, **parts):
    xml = body if whole else f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    return raw_xlsx(str(tmp_path / f"{name}.xlsx"), {"Sheet1": xml}, **parts)


def rows(spark, path, **options):
    df = sheet(spark, path, Options(**options))[0]
    return df.columns, [f.dataType.simpleString() for f in df.schema.fields], [tuple(r) for r in df.collect()]


def test_base(spark, tmp_path):
    p = make(tmp_path, head("id", "name") + f'<row r="2">{num("A2", 1)}{text("B2", "a")}</row><row r="3">{num("A3", 2)}{text("B3", "b")}</row>')
    assert rows(spark, p) == (["id", "name"], ["bigint", "string"], [(1, "a"), (2, "b")])


def test_header_is_the_first_row_with_cells(spark, tmp_path):
    p = make(tmp_path, f'<row r="1"/><row r="3">{text("A3", "h")}</row><row r="4">{num("A4", 1)}</row>')
    assert rows(spark, p) == (["h"], ["bigint"], [(1,)])


def test_header_gaps_and_blank_names(spark, tmp_path):
    p = make(tmp_path, f'<row r="1">{text("B1", "b")}{text("D1", "d")}</row><row r="2">{num("A2", 1)}</row>')
    assert rows(spark, p)[0] == ["Unknown_0", "b", "Unknown_2", "d"]
    p = make(tmp_path, f'<row r="1"><c r="A1"/>{text("B1", "x")}</row><row r="2">{num("A2", 1)}</row>', "blank")
    assert rows(spark, p)[0] == ["Unknown_0", "x"]


def test_header_values_as_names(spark, tmp_path):
    body = f'<row r="1">{num("A1", "1.0")}{num("B1", "007")}<c r="C1" t="b"><v>1</v></c><c r="D1" t="e"><v>#N/A</v></c>{num("E1", "1e7")}</row><row r="2">{num("A2", 1)}</row>'
    assert rows(spark, make(tmp_path, body))[0] == ["1", "7", "true", "#N/A", "10000000"]


def test_duplicate_names_are_an_error(spark, tmp_path):
    for i, names in enumerate((("a", "a"), ("a", "A"))):
        with pytest.raises(ValueError, match="duplicate"):
            rows(spark, make(tmp_path, head(*names) + f'<row r="2">{num("A2", 1)}</row>', f"d{i}"))
    p = make(tmp_path, head("a", "A") + f'<row r="2">{num("A2", 1)}</row>', "case")
    assert plan(p, Options(case_sensitive=True)).names == ["a", "A"]


def test_skipped_rows_are_sheet_rows(spark, tmp_path):
    p = make(tmp_path, head("n") + "".join(f'<row r="{i}">{num(f"A{i}", i - 1)}</row>' for i in range(2, 10)))
    assert [r[0] for r in rows(spark, p, skip_rows=[1])[2]] == list(range(2, 9))
    assert [r[0] for r in rows(spark, p, skip_rows=[0])[2]] == list(range(1, 9))
    r = read_xlsx(p, 5, skip_rows=[2, 3, 4], spark=spark)
    assert len(r) == 1 and next(r).column("n").to_pylist() == [1, 5, 6, 7, 8] and len(r) == 0
    bare = make(tmp_path, "".join(f'<row r="{i}">{num(f"A{i}", i)}</row>' for i in range(1, 4)), "bare")
    assert rows(spark, bare, header=False, skip_rows=[0]) == (["col_0"], ["bigint"], [(2,), (3,)])


def test_batches_keep_values_and_types(spark, tmp_path):
    body = head("n", "t", "b", "d") + "".join(f'<row r="{i}">{num(f"A{i}", i)}<c r="B{i}" t="str"><v>x{i}</v></c><c r="C{i}" t="b"><v>{i % 2}</v></c><c r="D{i}" s="1"><v>{45000 + i}</v></c></row>' for i in range(2, 9))
    p = make(tmp_path, body, "typed", styles=STYLES)
    want = [tuple(r) for r in read_xlsx(p, spark=spark).df.collect()]
    for size, lengths in ((3, [3, 3, 1]), (7, [7]), (1, [1] * 7), (100, [7]), (None, [7])):
        batches = list(read_xlsx(p, size, spark=spark))
        assert [b.num_rows for b in batches] == lengths
        assert [str(t) for t in batches[0].schema.types] == ["int64", "string", "bool", "timestamp[us]"]
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == want
    for i, empty in enumerate((head("a", "b"), "")):
        r = read_xlsx(make(tmp_path, empty, f"none{i}"), None, spark=spark)
        assert list(r) == [] and r.df.count() == 0 and len(r) == 0
    assert spark.read.format("xlsx").load(make(tmp_path, "", "none")).count() == 0


def test_absent_rows_vanish_and_empty_cells_do_not(spark, tmp_path):
    p = make(tmp_path, head("a", "b") + f'<row r="2">{num("A2", 1)}</row><row r="3"/><row r="5">{num("A5", 2)}</row><row r="6"><c r="A6" s="1"/></row>', styles=STYLES)
    assert rows(spark, p)[2] == [(1, None), (2, None), (None, None)]


def test_header_only(spark, tmp_path):
    assert rows(spark, make(tmp_path, head("a", "b"))) == (["a", "b"], ["string", "string"], [])


def test_type_lattice(spark, tmp_path):
    cells = {"A": ["1", "2"], "B": ["1", "1.5"], "C": ["1", "B"], "D": ["1", "T"], "E": ["d", "T"], "F": ["E", "E"], "G": ["d", "d"]}
    kinds = {"B": '<c r="{}" t="b"><v>1</v></c>', "T": '<c r="{}" t="str"><v>x</v></c>', "d": '<c r="{}" s="1"><v>45000</v></c>', "E": '<c r="{}" t="e"><v>#N/A</v></c>'}
    body = head(*"abcdefg") + "".join(f'<row r="{i + 2}">' + "".join(kinds.get(v[i], '<c r="{}"><v>' + v[i] + "</v></c>").format(f"{c}{i + 2}") for c, v in cells.items()) + "</row>" for i in range(2))
    _, types, found = rows(spark, make(tmp_path, body, styles=STYLES))
    assert types == ["bigint", "double", "string", "string", "string", "string", "timestamp_ntz"]
    assert found == [(1, 1.0, "1", "1", "2023-03-15 00:00:00", None, dt.datetime(2023, 3, 15)), (2, 1.5, "true", "x", "x", None, dt.datetime(2023, 3, 15))]


def test_number_grammar(spark, tmp_path):
    values = ["+5", "1.0", "1E5", "NaN", "inf", "9223372036854775808", " 5 ", "5d", "-infinity", ".5"]
    body = head(*(f"c{i}" for i in range(len(values)))) + '<row r="2">' + "".join(num(f"{chr(65 + i)}2", v) for i, v in enumerate(values)) + "</row>"
    _, types, found = rows(spark, make(tmp_path, body))
    assert types == ["bigint", "double", "double", "double", "double", "double", "string", "string", "double", "double"]
    row = found[0]
    assert row[0] == 5 and row[2] == 100000.0 and row[3] != row[3] and row[4] == float("inf") and row[5] == 9.223372036854775808e18 and row[6:8] == (" 5 ", "5d") and row[8] == float("-inf") and row[9] == 0.5


def test_strings_shared_inline_and_formulas(spark, tmp_path):
    strings = "<sst><si><r><t>a</t></r><r><t xml:space='preserve'> b</t></r></si><si><t>x&amp;y &#65;</t></si><si><t><![CDATA[<c>]]></t></si></sst>"
    cells = ['t="s"><v>0</v></c>', 't="s"><v>1</v></c>', 't="s"><v>2</v></c>', 't="s"><v>9</v></c>', 't="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c>', 't="str"><f>A1&amp;"x"</f><v>fx</v></c>']
    body = head("s") + "".join(f'<row r="{i}"><c r="A{i}" {c}</row>' for i, c in enumerate(cells, 2))
    assert [r[0] for r in rows(spark, make(tmp_path, body, strings=strings))[2]] == ["a b", "x&y A", "<c>", None, "ab", "fx"]
    p = make(tmp_path, head("n") + '<row r="2"><c r="A2"><f>1+1</f><v>2</v></c></row>', "formula")
    assert rows(spark, p)[1:] == (["bigint"], [(2,)])


def test_empty_values(spark, tmp_path):
    p = make(tmp_path, head("a", "b") + '<row r="2"><c r="A2"><v/></c><c r="B2"><v></v></c></row>')
    assert rows(spark, p)[2] == [(None, "")]


def test_date_lock(spark, tmp_path):
    styled = f'<row r="1">{text("A1", "d", " s=" + chr(34) + "0" + chr(34))}</row><row r="2">{num("A2", 45000, " s=" + chr(34) + "1" + chr(34))}</row>'
    p = make(tmp_path, styled, styles=STYLES)
    assert rows(spark, p)[1:] == (["bigint"], [(45000,)])
    assert rows(spark, p, date_detection="cell")[1:] == (["timestamp_ntz"], [(dt.datetime(2023, 3, 15),)])
    # A self-closing styled cell does not lock; unstyled cells before the lock are numbers.
    later = head("d") + '<row r="2"><c r="A2" s="0"/></row>' + f'<row r="3">{num("A3", 1)}</row><row r="4">{num("A4", 45000, " s=" + chr(34) + "2" + chr(34))}</row><row r="5">{num("A5", 45001)}</row>'
    assert [r[0] for r in rows(spark, make(tmp_path, later, "later", styles=STYLES))[2]] == [None, "1", "2023-03-15 00:00:00", "2023-03-16 00:00:00"]


def test_date_codes():
    codes = {"yyyy-mm-dd": True, "[$-409]d-mmm-yy": False, "0.00": False, "#,##0": False, '"USD"': True, "mm:ss.000": False, "General": False}
    assert {c: is_date_code(c) for c in codes} == codes
    assert is_date_code("[$-409]d-mmm-yy", strict=True) and is_date_code("mm:ss.000", strict=True) and not is_date_code('"USD"', strict=True)


def test_serial_vectors():
    import numpy as np

    known = {-0.5: "1899-12-28T12:00:00", 0: "1899-12-30T00:00:00", 1: "1900-01-01T00:00:00", 59: "1900-02-28T00:00:00", 60: "1900-03-01T00:00:00", 61: "1900-03-01T00:00:00", 45000.75: "2023-03-15T18:00:00"}
    found = serial_micros(np.array(list(known), float)).astype("datetime64[us]")
    assert [str(x)[:19] for x in found] == list(known.values())


def test_empty_sheets_and_missing_parts(spark, tmp_path):
    for i, xml in enumerate(("<worksheet><sheetData/></worksheet>", "<worksheet><sheetData></sheetData></worksheet>")):
        p = plan(make(tmp_path, xml, f"e{i}", whole=True), Options())
        assert p.n_rows == 0 and p.names == []
    df = read_xlsx(make(tmp_path, "", "nothing"), spark=spark).df
    for sink, end in ((sinks.write_csv, "csv"), (sinks.write_parquet, "parquet")):
        for _ in range(2):  # again over what is there
            assert os.path.getsize(sink(df, str(tmp_path / f"out.{end}"))) == 0
            assert os.listdir(sink(df, str(tmp_path / f"parts-{end}"), single=False)) == []
    p = raw_xlsx(str(tmp_path / "missing.xlsx"), {"Sheet1": None})
    with pytest.raises(ValueError, match="missing"):
        plan(p, Options())


def test_positions_may_be_absent(spark, tmp_path):
    body = "<row><c t='str'><v>a</v></c><c t='str'><v>b</v></c></row><row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c><c r='B3'><v>4</v></c></row>"
    assert rows(spark, make(tmp_path, body)) == (["a", "b"], ["bigint", "bigint"], [(1, 2), (3, 4)])
    assert rows(spark, make(tmp_path, body, "cut"), splits=3)[2] == [(1, 2), (3, 4)]


def test_prefixes_and_comments(spark, tmp_path):
    xml = "<x:worksheet xmlns:x='m'><x:sheetData><x:row r='1'><x:c r='A1' t='str'><x:v>a</x:v></x:c></x:row><!-- <row r='9'> --><x:row r='2'><x:c r='A2'><x:v>5</x:v></x:c></x:row></x:sheetData></x:worksheet>"
    assert rows(spark, make(tmp_path, xml, whole=True)) == (["a"], ["bigint"], [(5,)])


def test_sheets(spark, tmp_path):
    p = str(tmp_path / "many.xlsx")
    write_xlsx(p, [(n, ["v"], [(i,)]) for i, n in enumerate(["A", "B", "R&D"])])
    assert Workbook.open(p).sheet_names() == ["A", "B", "R&D"]
    r = read_xlsx(p, spark=spark)
    assert r.select_sheet("R&D").df.collect()[0].v == 2 and r.select_sheet_by_idx(1).df.collect()[0].v == 1
    assert read_xlsx(p, sheet_name="B", sheet_idx=0, spark=spark).df.collect()[0].v == 1
    with pytest.raises(ValueError, match="Worksheet 'nope' not found"):
        read_xlsx(p, sheet_name="nope", spark=spark)
    with pytest.raises(ValueError, match="batch_size"):
        read_xlsx(p, 0, spark=spark)


def test_1904(spark, tmp_path):
    book = '<workbook xmlns:r="r"><workbookPr date1904="1"/><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>'
    p = make(tmp_path, head("d") + f'<row r="2">{num("A2", 0, " s=" + chr(34) + "1" + chr(34))}</row>', styles=STYLES, workbook=book)
    assert rows(spark, p)[2] == [(dt.datetime(1899, 12, 30),)] and rows(spark, p, epoch_1904=True)[2] == [(dt.datetime(1904, 1, 1),)]


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("big") / "big.xlsx")
    words = ["é", "日本", "a<b&c", "🎉", "plain", " spaced "]
    write_xlsx(p, [("S", ["n", "t", "f", "d"], ((i, words[i % 6] * (i % 5 + 1), i / 7, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i) if i > 6000 else None) for i in range(10_000)))])
    return p


def test_splits_do_not_matter(spark, big):
    found = []
    for n in (1, 2, 7):
        df = sheet(spark, big, Options(splits=n, batch_size=999, metadata=True))[0]
        found.append((df.schema.simpleString(), sorted(tuple(r) for r in df.collect())))
    assert found[0] == found[1] == found[2]
    assert [r[-2] for r in sorted(found[0][1], key=lambda r: r[-2])] == list(range(10_000))


def test_a_lock_in_a_later_split(spark, tmp_path):
    q = chr(34)
    body = head("a", "b") + "".join(f'<row r="{i}">{num(f"A{i}", 45000, f" s={q}1{q}" if i >= 400 else "")}{num(f"B{i}", 45000, f" s={q}1{q}" if i == 2 else "")}</row>' for i in range(2, 800))
    found = [rows(spark, make(tmp_path, body, f"l{n}", styles=STYLES), splits=n) for n in (1, 2, 7)]
    assert found[0] == found[1] == found[2] and found[0][1] == ["string", "timestamp_ntz"]
    assert found[0][2][0][0] == "45000" and found[0][2][-1][0] == "2023-03-15 00:00:00"


def test_long_texts_are_written_into_their_cells(spark, tmp_path, monkeypatch):
    from sheetframe.sources import writer

    odd = "a<b>&c ]]> \r\n\t é🎉 &amp; "
    texts = ["short", odd, odd * 200, "x" * 3_000_000, None, odd * 200, "short", " "]
    for shared in (500_000, 1):
        monkeypatch.setattr(writer, "SHARED_TEXTS", shared)
        p = str(tmp_path / f"long{shared}.xlsx")
        write_xlsx(p, [("S", ["n", "t"], enumerate(texts))])
        for n in (1, 3):
            assert rows(spark, p, splits=n)[2] == list(enumerate(texts))


def test_stored_parts_and_broken_files(spark, tmp_path, big):
    p = str(tmp_path / "stored.xlsx")
    with zipfile.ZipFile(big) as z, zipfile.ZipFile(p, "w", zipfile.ZIP_STORED) as out:
        for name in z.namelist():
            out.writestr(name, z.read(name))
    for n in (1, 5):
        assert sorted(rows(spark, p, splits=n)[2]) == sorted(rows(spark, big)[2])
    with zipfile.ZipFile(big) as z:
        info = z.getinfo("xl/worksheets/sheet1.xml")
        with open(big, "rb") as f:
            info.compress_size //= 2  # as if the data ended there
            piece = Part(f, info)
            with pytest.raises(zipfile.BadZipFile):
                while piece.read():
                    pass


def test_later_splits_are_shorter(big):
    part = Workbook.open(big).part(None, None)
    _, ranges = cut(big, part, Options(splits=5))
    sizes = [hi - lo for lo, hi in ranges]
    assert ranges[0][0] == 0 and sizes == sorted(sizes, reverse=True) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_generator_and_cli(spark, tmp_path, capsys, monkeypatch):
    from sheetframe.cli import main

    monkeypatch.chdir(tmp_path)
    assert main(["test", "test-file", "g.xlsx", "-r", "30"]) == 0
    assert main(["-B", "7", "test", "count", "g.xlsx"]) == 0 and capsys.readouterr().out.startswith("5 ")
    assert main(["test", "debug", "g.xlsx"]) == 0
    assert main(["tf", "csv", "g.xlsx", "out.csv"]) == 0 and main(["tf", "parquet", "g.xlsx"]) == 0 and main(["tf", "csv", "none.xlsx"]) == 1
    assert (tmp_path / "out.csv").read_text().startswith("Int,Float,String,Bool,DateTime,DurationIso,Empty\n")
    assert spark.read.parquet(str(tmp_path / "g.parquet")).count() == 30


def test_iteration_matches_the_frame(spark, big):
    r = read_xlsx(big, 3000, spark=spark, splits=3)
    sizes, left = [], [len(r)]
    for b in r:
        sizes.append(b.num_rows)
        left.append(len(r))
    assert sizes == [3000, 3000, 3000, 1000] and left == [4, 3, 2, 1, 0]


def test_stream_of_a_directory(spark, tmp_path):
    from sheetframe.streaming.workbooks import drain, stream_sheet

    for i in range(3):
        write_xlsx(str(tmp_path / f"{i}.xlsx"), [("S", ["v"], [(i * 10 + j,) for j in range(5)])])
    df = drain(stream_sheet(spark, str(tmp_path)), "dir_stream")
    assert sorted(r.v for r in df.collect()) == sorted(i * 10 + j for i in range(3) for j in range(5))
