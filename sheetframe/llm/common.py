"""What the corpus operators share: shared folders, ASCII-only folding, and vectorised words and hashes.

Hashes are 64-bit and mix every 8 bytes with their place, so two different strings that were not built for it have equal
hashes with a probability of about 2**-64; operators that compare across the whole corpus use 128 bits.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of every contract: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context.getCheckpointDir()
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = found or tempfile.mkdtemp(prefix="sheetframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from now on: later steps neither compute them again nor see other partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read, wherever Spark's file systems keep it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the quick way where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


# ---- vectorised bytes, for Arrow batches ----

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which all bits depend on all bits (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for each span: each 8 bytes are mixed with their place, and the sums are mixed with the length.

    No base, no polynomial: strings built of repeated patterns (such as Thue-Morse words) collide no more than others.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = (ends - starts).astype(np.int64)
    blocks = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded, strides=(1,))[at]  # the 8 bytes from each byte on
    cut = (8 * np.clip(np.repeat(ends, blocks) - at, 0, 8)).astype(np.uint64)
    eight &= np.where(cut < 64, (np.uint64(1) << np.minimum(cut, np.uint64(63))) - np.uint64(1), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        own = np.add.reduceat(mix(eight ^ mix(place.astype(np.uint64) + np.uint64(_SEED))), first)
        return mix(own ^ mix(length.astype(np.uint64) + np.uint64(_SEED)))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch and where each begins and ends; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes in all (a longer text comes alone): working memory follows the longest text, not the batch."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text's border: start, end, text."""
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space, as bytes: start, end, text."""
    return spans(~_GAP[buf], offsets)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n words from each word on, and the positions of those words; windows stay inside a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(0x100000001B3) + hashes[k : len(hashes) - n + 1 + k])
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return out[at], at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags (one for each byte) by text."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]
