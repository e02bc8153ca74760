"""Sheets as CSV and Parquet: one file with a header where that is asked for, else a directory of part files.

A sheet without columns, which neither format of Spark's can hold, is a file without bytes or a directory without files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _nothing(df: DataFrame, path: str, single: bool) -> str:
    """The place of a sheet without columns."""
    target, system = _found(df, path)
    system.delete(target, True)
    if single:
        system.create(target, True).close()
    else:
        system.mkdirs(target)
    return path


def _found(df: DataFrame, path: str):
    """path for Hadoop, and the file system that holds it."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _single(df: DataFrame, write, path: str, suffix: str) -> str:
    """Writes one part file beside path and gives it path's name, through Hadoop's file system, whatever it is."""
    place = f"{path}.{uuid.uuid4().hex}.parts"
    write(df.coalesce(1), place)
    jvm = df.sparkSession.sparkContext._jvm
    target, system = _found(df, path)
    found = [s.getPath() for s in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{place}/part-*{suffix}"))]
    system.delete(target, True)
    system.rename(found[0], target)
    system.delete(jvm.org.apache.hadoop.fs.Path(place), True)
    return path


def named(path: str, suffix: str) -> str:
    """path with its ending replaced by suffix."""
    head, slash, name = path.rpartition("/")
    return f"{head}{slash}{name.rsplit('.', 1)[0] if '.' in name else name}{suffix}"


def write_csv(df: DataFrame, path: str, single: bool = True) -> str:
    """CSV with a header. A single file passes through one task; a directory does not."""
    if not df.columns:
        return _nothing(df, named(path, ".csv") if single else path, single)
    if not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        return path
    return _single(df, lambda d, p: d.write.option("header", True).csv(p), named(path, ".csv"), ".csv")


def write_parquet(df: DataFrame, path: str, single: bool = True) -> str:
    """Parquet with the schema of the whole sheet."""
    if not df.columns:
        return _nothing(df, named(path, ".parquet") if single else path, single)
    if not single:
        df.write.mode("overwrite").parquet(path)
        return path
    return _single(df, lambda d, p: d.write.parquet(p), named(path, ".parquet"), ".parquet")


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1", header: bool = True) -> str:
    """One sheet from a DataFrame, in its order, written by tasks. Where those can't (see writable()), rows stream through the driver, a partition at a time."""
    from .pieces import writable, write_frames
    from .writer import write_xlsx

    if writable(df):
        write_frames(path, [(sheet, df, header)])
    else:
        write_xlsx(path, [(sheet, df.columns if header else None, df.toLocalIterator(prefetchPartitions=True))])
    return path
