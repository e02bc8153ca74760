"""read_xlsx(): a sheet as a lazy DataFrame, and as an iterator of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import Options
from ..sources.opc import Workbook
from ..sources.xlsx import sheet


class XlsxReader:
    """One sheet of a workbook at a time. `df` is the sheet; iterating gives its batches as Arrow tables, in file order.

    len() is the number of batches that are left, exactly. Selecting a sheet keeps the other options and begins anew.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.workbook = spark, path, Workbook.open(path)
        self._load(options)

    def _load(self, options: Options) -> None:
        self.options = options
        self.df, plans = sheet(self.spark, self.path, options, self.workbook)
        self.plan = plans[0]
        self._done, self._batches = 0, None

    def sheet_names(self) -> list[str]:
        return self.workbook.sheet_names()

    def select_sheet(self, name: str) -> XlsxReader:
        self._load(replace(self.options, sheet_name=name, sheet_idx=None))
        return self

    def select_sheet_by_idx(self, idx: int) -> XlsxReader:
        self._load(replace(self.options, sheet_name=None, sheet_idx=idx))
        return self

    def n_batches(self) -> int:
        size = self.options.batch_size or max(self.plan.n_rows, 1)
        return -(-self.plan.n_rows // size)

    def __len__(self) -> int:
        return self.n_batches() - self._done

    def __iter__(self) -> XlsxReader:
        return self

    def __next__(self) -> pa.Table:
        if self._batches is None:
            self._batches = self.iter_batches()
        out = next(self._batches)
        self._done += 1
        return out

    def iter_batches(self) -> Iterator[pa.Table]:
        """Arrow tables of batch_size rows (the last may be smaller), holding one at a time besides what Spark sends ahead.

        Tasks run in file order, one split ahead of the reader; the sheet is never on the driver as a whole.
        """
        frame, _ = sheet(self.spark, self.path, replace(self.options, metadata=False), self.workbook)
        schema = pa.schema([(f.name, TYPES.get(f.dataType.simpleString(), pa.string())) for f in frame.schema.fields])
        if not len(schema):
            return
        size = self.options.batch_size or max(self.plan.n_rows, 1)
        held, n = [], 0
        for r in frame.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            own = pa.ipc.open_stream(r["batch"]).read_all().cast(schema)
            while n + own.num_rows >= size:
                yield pa.concat_tables([*held, own.slice(0, size - n)]).combine_chunks()
                held, n, own = [], 0, own.slice(size - n)
            if own.num_rows:
                held.append(own)
                n += own.num_rows
        if held:
            yield pa.concat_tables(held).combine_chunks()


    def map_batches(self, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f over each batch - its number and table - in tasks; the tables that f gives are the rows of a DataFrame of this schema.

        What a split holds of a batch travels as one row of bytes to the task that puts the batch together; the driver gets nothing.
        """
        frame, _ = sheet(self.spark, self.path, replace(self.options, metadata=True), self.workbook)
        kinds = pa.schema([(c.name, TYPES.get(c.dataType.simpleString(), pa.string())) for c in frame.schema.fields if c.name not in ("_row", "_ord", "_batch_id")])

        def whole(key: tuple, parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("ord")
            tables = [pa.ipc.open_stream(b).read_all().select(kinds.names).cast(kinds) for b in parts["data"].to_pylist()]
            return f(key[0].as_py(), pa.concat_tables(tables).combine_chunks())

        return frame.mapInArrow(fragments, "batch long, ord long, data binary").groupBy("batch").applyInArrow(whole, schema)


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch of the sheet as one row of bytes, with the batch's number and the first row's."""
    for b in batches:
        number = b.column("_batch_id").to_numpy()
        starts = [*np.flatnonzero(np.diff(number, prepend=number[:1] - 1)).tolist(), len(number)]
        data = [next(packed([b.slice(i, j - i)])).column(0)[0].as_py() for i, j in zip(starts, starts[1:])]
        if data:
            at = pa.array(starts[:-1])
            yield pa.RecordBatch.from_arrays([b.column("_batch_id").take(at), b.column("_ord").take(at), pa.array(data, pa.binary())], names=["batch", "ord", "data"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of bytes, so that its rows travel to the driver without becoming Python objects."""
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def read_xlsx(path: str, batch_size: int | None = 10000, sheet_name: str | None = None, sheet_idx: int | None = None, has_header: bool = True, skip_rows: list[int] | None = None, *, spark: SparkSession | None = None, metadata: bool = False, columns: list[str] | None = None, splits: int | None = None, **options) -> XlsxReader:
    """A reader of a worksheet. See Options for what else can be said."""
    spark = spark or SparkSession.builder.getOrCreate()
    sensitive = spark.conf.get("spark.sql.caseSensitive", "false") == "true"
    o = Options(sheet_name=sheet_name, sheet_idx=sheet_idx, header=has_header, skip_rows=list(skip_rows or ()), batch_size=batch_size, metadata=metadata, columns=columns, splits=splits, case_sensitive=sensitive, **options)
    return XlsxReader(spark, path, o)


def count_batches(df: DataFrame) -> DataFrame:
    """n_batches of a sheet that was read with metadata."""
    return df.agg(F.countDistinct("_batch_id").alias("n_batches"))


def preview(df: DataFrame, batches: int = 10) -> DataFrame:
    """The first batches of a sheet that was read with metadata."""
    return df.where(F.col("_batch_id") < batches)


def types_by_batch(df: DataFrame, batch_size: int) -> DataFrame:
    """column, batch and type of each column as it widens from batch to batch, for a sheet that was read as cells without its header row.

    df: row, col, kind, value of the data rows, and ord, their 0-based number among them. Kinds of a batch are summed up
    before batches are, and the running union takes one row for each column and batch.
    """
    from pyspark.sql import Window

    kinds = df.withColumn("batch", F.floor(F.col("ord") / batch_size)).groupBy("col", "batch").agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("int", "float", "bool", "string", "iso")))
    so_far = Window.partitionBy("col").orderBy("batch")
    run = kinds.select("col", "batch", *(F.max(k).over(so_far).alias(k) for k in ("int", "float", "bool", "string", "iso")))
    text = (F.col("string") + F.col("iso") > 0) | ((F.col("bool") > 0) & (F.col("int") + F.col("float") > 0))
    kind = F.when(text, "string").when(F.col("bool") > 0, "boolean").when(F.col("float") > 0, "double").when(F.col("int") > 0, "long").otherwise("string")
    return run.select("col", "batch", kind.alias("type"))
