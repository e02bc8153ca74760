"""Workbooks that tasks write in pieces: what is in them, where they can be entered, and what the driver gets."""

import datetime as dt
import decimal
import random
import zipfile
import zlib

import pytest

from sheetframe.operators.reader import read_xlsx
from sheetframe.plans.scan import Options, cut
from sheetframe.sources import opc, pieces, sinks
from sheetframe.sources.cells import Part
from sheetframe.sources.opc import Workbook
from sheetframe.sources.writer import write_xlsx
from sheetframe.sources.xlsx import sheet

ODD = ["a<b>&c ]]> \r\n\t é🎉 &amp; ", "\x00\x01x\x0b\x1fy", '"q"', " ", "", None, "<row r='1'></sheetData>", "x" * 50_000]


@pytest.fixture
def frame(spark):
    t = dt.datetime(2020, 2, 29, 1, 2, 3, 456_789)
    rows = [(i, i % 3 == 0 if i % 5 else None, [1.0, 0.1, 1e15, -1e-7, float("nan"), 2.5e300, None][i % 7], ODD[i % len(ODD)], t + dt.timedelta(hours=7 * i), t.date() if i % 4 else None, decimal.Decimal(i).scaleb(-2), i - 2**62) for i in range(3000)]
    schema = "i int, b boolean, f double, s string, t timestamp_ntz, d date, m decimal(12, 2), n long"
    return spark.createDataFrame(rows, schema).repartition(5, "i").orderBy(spark.createDataFrame(rows[:1], schema).columns[-1])


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 20_000)
    monkeypatch.setattr(pieces, "KEPT", 30_000)


def cells(spark, path, **options):
    df = sheet(spark, path, Options(**options))[0]
    return df.dtypes, sorted(map(repr, df.collect()))


def test_tasks_write_what_the_driver_writes(spark, frame, tmp_path, small):
    a, b = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    sinks.write_workbook(frame, a)
    write_xlsx(b, [("Sheet1", frame.columns, frame.collect())])
    want = cells(spark, b)
    assert len(want[1]) == 3000
    for n in (None, 1, 2, 7, 40):
        assert cells(spark, a, splits=n, metadata=True)[1] == cells(spark, b, metadata=True)[1]
        assert cells(spark, a, splits=n) == want
    with zipfile.ZipFile(a) as z:
        assert z.testzip() is None and len(opc.pieces(z, "xl/worksheets/sheet1.xml")) > 10


def test_pieces_are_entered_not_inflated_through(spark, frame, tmp_path, small, monkeypatch):
    p = str(tmp_path / "p.xlsx")
    sinks.write_workbook(frame, p)
    part = Workbook.open(p).part()
    _, ranges = cut(p, part, Options(splits=6))
    begun = []
    real = Part.__init__
    monkeypatch.setattr(Part, "__init__", lambda self, file, info, skip=0: (begun.append(skip), real(self, file, info, skip))[1])
    from sheetframe.sources import cells as X

    n = sum(len(set(t["row"].to_pylist())) for lo, hi in ranges for t in X.cells(p, part, lo, hi, False))
    assert n == 3001 and begun[0] == 0 and begun == sorted(set(begun))
    monkeypatch.setattr("sheetframe.plans.scan.SPLIT_BYTES", 10_000)
    assert len(cut(p, part, Options(), 4)[1]) > 16  # as many as the sheet has bytes for


def test_few_splits_are_planned_by_many_tasks(spark, frame, tmp_path, small, monkeypatch):
    from sheetframe.plans import scan

    p = str(tmp_path / "p.xlsx")
    sinks.write_workbook(frame, p)
    tasks = []

    def run(todo, f):
        tasks.extend(todo)
        return [f(t) for t in todo]

    want = scan.plan(p, Options(splits=3), run)
    assert len(tasks) == 3
    monkeypatch.setattr(scan, "SPLIT_BYTES", 20_000)
    tasks.clear()
    assert scan.plan(p, Options(splits=3), run) == want and len(tasks) > 30 and want.n_rows == 3000


def test_pieces_of_a_rewritten_sheet_are_not_used(spark, frame, tmp_path, small):
    p, q = str(tmp_path / "p.xlsx"), str(tmp_path / "q.xlsx")
    sinks.write_workbook(frame, p)
    with zipfile.ZipFile(p) as z, zipfile.ZipFile(q, "w", zipfile.ZIP_DEFLATED) as out:
        for name in z.namelist():
            out.writestr(name, z.read(name))
    with zipfile.ZipFile(q) as z:
        assert opc.pieces(z, "xl/worksheets/sheet1.xml") == []
    assert cells(spark, q, splits=5) == cells(spark, p, splits=5)


def test_checksums_join():
    rng = random.Random(1)
    for n, m in ((0, 0), (10, 0), (0, 7), (1000, 12_345), (3, 1 << 20)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert pieces.crc_joined(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_rows_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    from sheetframe import fixtures, queries

    def no(*_, **__):
        raise AssertionError("rows come to the driver")

    spark.range(5000).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "id / 2 as o_totalprice", "timestamp_ntz '1995-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", no)
    assert fixtures.workbook(spark, str(tmp_path), "orders")
    assert queries.queries()["batch_count"](spark, str(tmp_path)).collect()[0].n_batches == 8


def test_empty_frames(spark, tmp_path):
    p = str(tmp_path / "e.xlsx")
    sinks.write_workbook(spark.createDataFrame([], "a int, b string"), p)
    r = read_xlsx(p, spark=spark)
    assert r.df.columns == ["a", "b"] and r.df.count() == 0


def test_a_stream_is_planned_by_a_job_and_drained_by_tasks(spark, tmp_path, monkeypatch):
    """The stream's process, where no job can be run, gets the plan; rows don't come to the driver's memory."""
    from pyspark.sql.streaming import DataStreamWriter
    from sheetframe.streaming.workbooks import drain, stream_sheet

    p = str(tmp_path / "s.xlsx")
    sinks.write_workbook(spark.range(2000).selectExpr("id", "concat('t', id) t"), p)
    sinks_used = []
    real = DataStreamWriter.format
    monkeypatch.setattr(DataStreamWriter, "format", lambda self, name: (sinks_used.append(name), real(self, name))[1])
    stream = stream_sheet(spark, p, splits=3)
    out = drain(stream, "drained")
    assert sinks_used == ["parquet"] and sorted(map(tuple, out.collect())) == [(i, f"t{i}") for i in range(2000)]
    assert spark.table("drained").count() == 2000


def test_given_plans_are_used_while_the_file_is_the_same(spark, tmp_path, monkeypatch):
    from sheetframe.sources import xlsx

    p = str(tmp_path / "s.xlsx")
    write_xlsx(p, [("S", ["v"], [(i,) for i in range(50)])])
    given = xlsx.plan(p, Options(splits=2))
    stream = xlsx.XlsxStream(p, Options(splits=2), given.fields(), {opc.stamp(p): given.to_json()})
    planned = []
    monkeypatch.setattr(xlsx, "plan", lambda f, o: planned.append(f) or given)
    assert len(stream.partitions({"files": []}, {"files": [p]})) == 2 and planned == []
    write_xlsx(p, [("S", ["v"], [(i,) for i in range(60)])])
    stream.partitions({"files": []}, {"files": [p]})
    assert planned == [p]


def test_batches_are_mapped_in_tasks(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import DataFrame

    p = str(tmp_path / "b.xlsx")
    sinks.write_workbook(spark.range(3000).selectExpr("id", "concat('t', id) t"), p)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: 1 / 0)
    for size, splits in ((700, 3), (7, 5), (None, 4), (30_000, 2)):
        r = read_xlsx(p, size, spark=spark, splits=splits)
        out = r.map_batches(lambda i, t: pa.table({"i": [i], "ids": [t["id"].to_pylist()], "ok": [t["t"].to_pylist() == [f"t{k}" for k in t["id"].to_pylist()]]}), "i long, ids array<long>, ok boolean")
        want = [list(range(i, min(i + (size or 3000), 3000))) for i in range(0, 3000, size or 3000)]
        assert [(x.i, x.ids, x.ok) for x in sorted(out.collect())] == [(i, w, True) for i, w in enumerate(want)]
