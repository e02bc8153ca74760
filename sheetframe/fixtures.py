"""Workbooks for queries and tests: tables of Parquet as sheets, and the synthetic generator."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import random
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .sources.pieces import write_frames
from .sources.writer import temporary, write_xlsx

VERSION = 6
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
}


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(*KEYS[name])


def place(spark: SparkSession, sf_dir: str) -> str:
    """A folder that all executors see: in spark.checkpoint.dir where a cluster names one, else (tests, one machine) a temporary one that later sessions find again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = re.sub("^file:/*", "/", shared) if shared else tempfile.gettempdir()
    if "://" in root:
        raise ValueError("workbooks are written to a mounted folder; spark.checkpoint.dir is none")
    whole = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]  # folders of one name in different places are different tables
    out = os.path.join(root, "sheetframe-fixtures", f"{os.path.basename(os.path.normpath(sf_dir))}-{whole}-{VERSION}-{os.getuid()}")
    os.makedirs(out, exist_ok=True)
    return out


def workbook(spark: SparkSession, sf_dir: str, *tables: str, header: bool = True) -> str:
    """A workbook with a sheet for each table, in the order of its key; written once and found again later."""
    path = f"{place(spark, sf_dir)}/{'-'.join(tables)}{'' if header else '-bare'}.xlsx"
    if not os.path.exists(path):
        write_frames(path, [(name, _rows(spark, sf_dir, name), header) for name in tables])
    return path


def generate(path: str, rows: int = 100_000, columns: int = 7, seed: int = 42) -> str:
    """The synthetic sheet: Int, Float, String, Bool, DateTime, DurationIso, Empty, and further text columns without a header."""
    rng = random.Random(seed)
    own = lambda n: f"row_{n}_rnd{rng.getrandbits(32)}"

    def lines() -> Iterator[list]:
        for n in range(1, rows + 1):
            yield [
                rng.randrange(-1_000_000, 1_000_000), rng.uniform(-1e6, 1e6), own(n), rng.random() < 0.5,
                dt.datetime(rng.randint(2000, 2024), rng.randint(1, 12), rng.randint(1, 27), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59)),
                f"PT{rng.randint(0, 99)}H{rng.randint(0, 59)}M{rng.randint(0, 59)}S", "filled" if rng.random() < 0.5 else None, *(own(n) for _ in range(max(columns - 7, 0))),
            ]

    write_xlsx(path, [("Sheet1", ["Int", "Float", "String", "Bool", "DateTime", "DurationIso", "Empty"], lines())])
    return path


def micro(name: str, sheets: dict[str, str], **parts) -> str:
    """A workbook of hand-written sheet XML, kept by name."""
    from .sources.writer import raw_xlsx

    return raw_xlsx(f"{temporary()}/{name}.xlsx", {k: v if v.startswith("<worksheet") else f"<worksheet><sheetData>{v}</sheetData></worksheet>" for k, v in sheets.items()}, **parts)


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)
