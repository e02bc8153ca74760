"""Command line: python -m sheetframe.cli tf {csv|parquet} PATH [OUTPUT] | test {debug|count|test-file} [PATH]."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from .fixtures import generate
from .operators.reader import preview, read_xlsx
from .sources.sinks import named, write_csv, write_parquet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheetframe")
    p.add_argument("-B", "--batchsize", type=int, default=10_000)
    commands = p.add_subparsers(dest="command", required=True)
    tf = commands.add_parser("tf", help="write a sheet as CSV or Parquet")
    tf.add_argument("to", choices=["csv", "parquet"])
    tf.add_argument("path")
    tf.add_argument("output", nargs="?")
    tf.add_argument("-N", "--sheet-name")
    tf.add_argument("-I", "--sheet-idx", type=int, default=0)
    test = commands.add_parser("test", help="count batches, show some, or generate a workbook")
    test.add_argument("what", choices=["debug", "count", "test-file"])
    test.add_argument("path", nargs="?", default="test_data.xlsx")
    test.add_argument("-r", "--rows", type=int, default=100_000)
    test.add_argument("-c", "--col", type=int, default=7)
    test.add_argument("-l", "--no-limit", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "test" and a.what == "test-file":
        generate(a.path, a.rows, a.col)
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "tf":
        try:
            r = read_xlsx(a.path, a.batchsize, a.sheet_name, a.sheet_idx, spark=spark)
            suffix = f".{a.to}"
            out = named(a.output or os.path.basename(a.path), suffix)
            (write_csv if a.to == "csv" else write_parquet)(r.df, os.path.abspath(out))
        except Exception as e:
            print(f"{a.to} failed: {e}", file=sys.stderr)
            return 1
        return 0
    began = time.time()
    r = read_xlsx(a.path, a.batchsize, spark=spark, metadata=True)
    if a.what == "count":
        print(r.df.select("_batch_id").distinct().count(), f"{time.time() - began:.3f}s")
    else:
        preview(r.df, 2**62 if a.no_limit else 10).drop("_row", "_ord").show(10 * 20)
    return 0


if __name__ == "__main__":
    sys.exit(main())
