"""Which rows have keys in common, for tables whose rows hold many keys each.

Keys travel packed. A map task sorts the keys of some rows (a run) and sees at once which of them several of its rows have;
of every distinct key one entry leaves the run, with the first row that has it. So a key that a third of all rows have costs
one entry for each run. Entries go to ranges of the hash, one compressed piece for each run and range; there equal keys meet.
What a range finds out about a run's rows goes back to that run in one piece. The number of ranges follows the number of keys,
so a task's memory doesn't. Nothing is dropped, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Keys of a run, and keys that a range should hold: some 16 bytes each.
RUN, RANGE = 3_000_000, 2_000_000
MANY = np.uint64(1 << 63)


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of x by significance, so that those that are mostly zero lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys, and a 64-bit value for each, as bytes."""
    raw = planes(np.diff(keys, prepend=np.uint64(0))).tobytes() + planes(values.astype(np.uint64)).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(packed[:8], "little")
    raw = np.frombuffer(pa.decompress(packed[8:], decompressed_size=16 * size, codec="zstd", asbytes=True), np.uint8)
    steps, values = (np.ascontiguousarray(raw[a * size : (a + 8) * size].reshape(8, size).T).view(np.uint64).ravel() for a in (0, 8))
    return np.cumsum(steps, dtype=np.uint64), values


def by_key(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and rows in the order of keys (then rows, if these come in order), where each key begins, and the number of each entry's key."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys, rows, np.flatnonzero(new), np.cumsum(new) - 1


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists of longs: their elements as hashes, the row of each, and the lengths."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), sizes


def listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys of rows whose second column lists them."""
    return flat(batch.column(1))[:2]


def _answer(a: np.ndarray, b: np.ndarray, stars: bool) -> bytes | None:
    """Distinct edges, or rows and how often each occurs, as bytes."""
    if not len(a):
        return None
    a, b = np.unique(np.stack([a, b]), axis=1) if stars else np.unique(a, return_counts=True)
    return pa.compress(planes(a.astype(np.int64)).tobytes() + planes(b.astype(np.int64)).tobytes(), codec="zstd", asbytes=True) + (16 * len(a)).to_bytes(8, "little")


def _answered(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[-8:], "little")
    raw = np.frombuffer(pa.decompress(blob[:-8], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    a, b = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel() for x in np.split(raw, 2))
    return a, b


def _home(base: int, n: int) -> int:
    return int(C.mix(np.array([base], np.uint64))[0] % np.uint64(n))


def _pieces(parts: list, bases: list, blobs: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bases, pa.int64()), pa.array(kinds, pa.bool_()), pa.array(blobs, pa.binary())], names=["part", "base", "answer", "blob"])


def _packed(rows: DataFrame, keys_of: Callable, size: int, stars: bool) -> DataFrame:
    n = max(C.partitions(rows.sparkSession), -(-size // RANGE))
    cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, at, first, of = by_key(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            if not len(keys):
                return
            size = np.diff(first, append=len(keys))
            lead, several = at[first], size > 1
            base = int(at.min())
            parts, blobs = [], []
            # What the run knows by itself: how many shared keys a row has, or the edges of its own stars.
            own = np.repeat(several, size)
            if stars:
                own &= at != lead[of]
            if own.any():
                parts.append(_home(base, n))
                blobs.append(_answer(lead[of][own] if stars else at[own], at[own], stars))
            kinds = [True] * len(parts)
            entry = (lead - base).astype(np.uint64) | np.where(several, MANY, np.uint64(0))
            at_cut = np.searchsorted(keys[first], cuts)
            for part, (k, e) in enumerate(zip(np.split(keys[first], at_cut), np.split(entry, at_cut), strict=True)):
                if len(k):
                    parts.append(part)
                    blobs.append(pack(k, e))
                    kinds.append(False)
            yield _pieces(parts, [base] * len(parts), blobs, kinds)

        size = 0
        for batch in batches:
            keys, at = keys_of(batch)
            held.append((keys, batch.column(0).to_numpy(zero_copy_only=False)[at]))
            size += len(keys)
            if size > RUN:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, base, answer, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if answer:
                    yield _pieces([part], [base], [blob], [True])
                else:
                    entries.setdefault(part, []).append((base, blob))
        for part in list(entries):
            own = sorted(entries.pop(part))  # by run, so in the order of rows
            opened = [unpack(blob) for _, blob in own]
            run = np.repeat(np.arange(len(own)), [len(k) for k, _ in opened])
            values = np.concatenate([e for _, e in opened])
            at = (values & ~MANY).astype(np.int64) + np.array([base for base, _ in own])[run]
            several = (values & MANY) != 0
            _, ref, first, of = by_key(np.concatenate([k for k, _ in opened]), np.arange(len(at)))
            at, several, run = at[ref], several[ref], run[ref]
            lead = at[first][of]
            # Several rows of a run have counted theirs already.
            on = at != lead if stars else (np.diff(first, append=len(at)) > 1)[of] & ~several
            lead, at, run = lead[on], at[on], run[on]
            order = np.argsort(run, kind="stable")
            lead, at, run = lead[order], at[order], run[order]
            cut = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]]) if len(run) else [0]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                base = own[run[x]][0]
                yield _pieces([_home(base, n)], [base], [_answer(lead[x:y] if stars else at[x:y], at[x:y], stars)], [True])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for base, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs_of.setdefault(base, []).append(_answered(blob))
        for base in list(runs_of):
            a, b = (np.concatenate(x) for x in zip(*runs_of.pop(base), strict=True))
            if stars:
                a, b = np.unique(np.stack([a, b]), axis=1)
            else:
                a, of = np.unique(a, return_inverse=True)
                b = np.bincount(of, weights=b).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    piece = "part int, base long, answer boolean, blob binary"
    found = rows.mapInArrow(runs, piece).repartitionById(n, "part").mapInArrow(met, piece)
    return found.repartitionById(n, "part").mapInArrow(settled, "a long, b long")


def shared_counts(rows: DataFrame, keys_of: Callable, size: int) -> DataFrame:
    """(row, shared): how many of its keys other rows have too, for rows with any.

    The first column of `rows` is a long that numbers them, in ascending order within a partition, and must not change if a
    partition is computed again. keys_of(batch) gives 64-bit keys and the position in the batch of the row of each; a row
    has a key once. `size` is about the number of all keys.
    """
    return _packed(rows, keys_of, size, False).groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("shared"))  # a row may lie in two runs


def stars(rows: DataFrame, keys_of: Callable, size: int) -> DataFrame:
    """(a, b), a < b: edges by which all rows with a key are joined, through the first row of a run and the first of all. Arguments as for shared_counts."""
    return _packed(rows, keys_of, size, True).distinct()
