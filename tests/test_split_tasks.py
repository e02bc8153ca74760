"""However few splits are asked for, a sheet that can be entered anywhere is read by as many tasks as it fills."""

from sheetframe.plans import scan
from sheetframe.plans.scan import Options


def test_few_splits_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from sheetframe.sources import pieces, sinks
    from sheetframe.sources.xlsx import sheet, splits_of

    monkeypatch.setattr(pieces, "PIECE", 20_000)
    path = str(tmp_path / "p.xlsx")
    sinks.write_workbook(spark.range(5000).selectExpr("id", "concat('t', id) t"), path)
    monkeypatch.setattr(scan, "SPLIT_BYTES", 20_000)
    df, (plan,) = sheet(spark, path, Options(splits=3, metadata=True, batch_size=700))
    assert len(plan.splits) == 3 and len(splits_of(plan)) == df.rdd.getNumPartitions() > 6
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, f"t{i}", i + 1, i, i // 700) for i in range(5000)]
