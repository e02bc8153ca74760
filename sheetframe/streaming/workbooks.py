"""Workbooks as a stream: the splits of a file, or of all files of a directory, in batches."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..plans.scan import Options, cut, plan
from ..sources.opc import Workbook, stamp
from ..sources.writer import temporary
from ..sources.xlsx import files, options_from, register, runner


def stream_sheet(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A streaming DataFrame over a sheet. The schema is that of the first workbook unless it is given; options are the source's.

    Sheets of several splits that are there now are planned by Spark jobs and their plans given to the source, which has no
    session; it plans others by itself, when it meets them.
    """
    register(spark)
    o = options_from(options) if options else Options()
    run, found, plans = runner(spark), files(path), []
    for i, f in enumerate(found):
        if schema is not None and (len(found) == 1 and not os.path.exists(f) or "://" in f):  # not there yet, or not known by its time and size
            continue
        book = Workbook.open(f)
        if len(cut(f, book.part(o.sheet_name, o.sheet_idx), o, run.slots)[1]) > 1 or i == 0 and schema is None:
            plans.append((stamp(f), plan(f, o, run, book)))
    schema = plans[0][1].ddl() if schema is None else schema
    reader = spark.readStream.format("xlsx").schema(schema).option("plans", json.dumps([(s, p.to_json()) for s, p in plans if len(s) > 1]))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def drain(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All that a stream has now, written by its tasks as Parquet into a shared folder and read back as the view `name`."""
    folder = temporary()
    writer = stream.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint or f"{folder}/state")
    if not stream.columns:  # no rows either; Parquet can't hold it
        writer.format("memory").queryName(name).start().awaitTermination()
        return stream.sparkSession.table(name)
    rows = f"{folder}/rows"
    os.makedirs(rows)
    writer.format("parquet").option("path", f"file://{rows}").start().awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"file://{rows}")
    out.createOrReplaceTempView(name)
    return out
