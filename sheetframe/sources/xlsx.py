"""The Spark data source "xlsx": spark.read.format("xlsx") and spark.readStream.format("xlsx")."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.scan import Options, Plan, common_types, plan, read
from .opc import Workbook, stamp


def _flag(x) -> bool:
    return str(x).strip().lower() in ("true", "1", "yes")


def options_from(o: dict) -> Options:
    """Options by their Spark names: sheetName, sheetIdx, header, skipRows, batchSize, metadata, columns, mode, dateDetection, dateFormatDetection, date1904, splits."""
    get = {k.lower(): v for k, v in o.items()}.get
    split = lambda x: [y.strip() for y in x.split(",") if y.strip()] if x else []
    return Options(
        sheet_name=get("sheetname"), sheet_idx=int(get("sheetidx")) if get("sheetidx") not in (None, "") else None, header=_flag(get("header", "true")),
        skip_rows=[int(x) for x in split(get("skiprows"))], batch_size=int(get("batchsize")) if get("batchsize") else None, metadata=_flag(get("metadata", "false")),
        columns=split(get("columns")) or None, mode=get("mode", "table"), date_detection=get("datedetection", "column"), strict_dates=get("dateformatdetection") == "strict",
        epoch_1904=_flag(get("date1904", "false")), splits=int(get("splits")) if get("splits") else None,
    )


def files(path: str) -> list[str]:
    """A file, the workbooks of a directory, or those that a pattern matches, in order of their names."""
    if "://" in path:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        if system.get_file_info(name).type == fs.FileType.Directory:
            prefix = path[: len(path) - len(name)]
            return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".xlsx"))
        return [path]
    path = path if path.startswith("file:") else os.path.abspath(path)  # workers have folders of their own
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/*.xlsx"))
    return sorted(glob.glob(path)) if glob.has_magic(path) and not os.path.exists(path) else [path]


class Split(InputPartition):
    def __init__(self, plan_json: str, index: int):
        self.plan_json, self.index = plan_json, index


def splits_of(p: Plan) -> list[Split]:
    """The splits of a plan, or what they are cut into for more tasks; each holds no other."""
    return [Split(replace(p, splits=[s], tasks=[]).to_json(), 0) for s in p.tasks or p.splits]


class XlsxReader(DataSourceReader):
    """Splits of all files of a path. The files of a directory have the same columns, whose types are joined over all of them."""

    def __init__(self, plans: list[str]):
        self.plans = plans

    def partitions(self) -> list[Split]:
        return [s for p in self.plans for s in splits_of(Plan.from_json(p))] or [Split("", 0)]

    def read(self, partition: Split) -> Iterator:
        if partition.plan_json:
            yield from read(Plan.from_json(partition.plan_json), partition.index)


class XlsxStream(DataSourceStreamReader):
    """Files as a stream: those of a directory now, and others as they appear, whatever their names.

    An offset lists the files seen so far, so a file is read once, also after a restart. Which splits a file has is found
    out once, when it is read, unless `plans` has it as it is (by path, time and size). Values that don't fit the stream's schema are null, as the schema can't widen any more.
    """

    def __init__(self, path: str, options: Options, fields: list, plans: dict[tuple, str]):
        self.path, self.options, self.fields, self.plans = path, options, fields, plans
        self.seen: set[str] = set()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen.update(f for f in files(self.path) if os.path.exists(f) or "://" in f)
        return {"files": sorted(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.seen.update(end["files"])
        out = []
        for f in sorted(set(end["files"]) - set(start["files"])):
            given = self.plans.get(stamp(f))
            p = conform(Plan.from_json(given) if given else plan(f, self.options), self.fields)
            out += splits_of(p)
        return out

    def read(self, partition: Split) -> Iterator:
        yield from read(Plan.from_json(partition.plan_json), partition.index)

    def commit(self, end: dict) -> None:
        pass


def joined(plans: list[Plan]) -> list[Plan]:
    """Plans of the files of one table, with the types that all of them fit."""
    if len(plans) < 2 or plans[0].options.mode == "cells":
        return plans
    types = common_types(plans)
    return [replace(p, types=types) for p in plans]


def conform(p: Plan, fields: list) -> Plan:
    """A plan with given types of its columns."""
    if not fields or p.options.mode == "cells":
        return p
    types = dict(fields)
    if [n for n, _ in p.fields()] != [n for n, _ in fields]:
        raise ValueError(f"{p.path} has columns {p.names}, not {[n for n, _ in fields]}")
    return replace(p, types=[types.get(n, t) for n, t in zip(p.names, p.types, strict=True)])


class XlsxSource(DataSource):
    """Reads worksheets. Options as in options_from(); `plan` takes plans that are made already (one JSON text a line)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _plans(self) -> list[str]:
        if given := self.options.get("plan"):
            return given.split("\n")
        options = options_from(self.options)
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no workbooks at {self.options['path']}")
        return [p.to_json() for p in joined([plan(f, options) for f in found])]

    def schema(self) -> str | StructType:
        return Plan.from_json(self._plans()[0]).ddl()

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self._plans())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        kinds = {"bigint": "long", "int": "int", "double": "double", "boolean": "boolean", "timestamp_ntz": "timestamp_ntz", "string": "string"}
        fields = [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]
        plans = {tuple(s): p for s, p in json.loads(self.options.get("plans") or "[]")}
        return XlsxStream(self.options["path"], options_from(self.options), fields, plans)


def register(spark: SparkSession) -> None:
    """Makes the format "xlsx" known to a session."""
    spark.dataSource.register(XlsxSource)


def sheet(spark: SparkSession, path: str, options: Options | None = None, workbook: Workbook | None = None):
    """A sheet as a DataFrame, planned by a Spark job over its splits where there are several."""
    register(spark)
    found = files(path)
    if not found:
        raise ValueError(f"no workbooks at {path}")
    o = options or Options()
    plans = [plan(found[0], o, runner(spark), workbook)]
    if len(found) > 1:  # one task for each further file
        rest = runner(spark)([(f,) for f in found[1:]], lambda t: {"plan": plan(t[0], o).to_json()})
        plans = joined(plans + [Plan.from_json(x["plan"]) for x in rest])
    df = spark.read.format("xlsx").option("plan", "\n".join(p.to_json() for p in plans)).schema(plans[0].ddl()).load()
    return df, plans


def runner(spark: SparkSession):
    """Maps a function over tasks: in line for one, else as a Spark job whose results are a few flags for each task."""
    def run(tasks: list[tuple], f) -> list[dict]:
        if len(tasks) == 1:
            return [f(tasks[0])]
        rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tasks)], "i int, t string").repartitionById(len(tasks), "i")

        def work(batches):
            import pyarrow as pa

            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([json.dumps(f(tuple(json.loads(t))))])], names=["i", "r"])

        done = rows.mapInArrow(work, "i int, r string").collect()
        return [json.loads(r["r"]) for r in sorted(done, key=lambda r: r["i"])]

    run.slots = spark.sparkContext.defaultParallelism
    return run
