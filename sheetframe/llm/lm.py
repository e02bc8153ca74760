"""Stupid-backoff scores of all documents under the n-gram counts of the corpus itself.

S(w | u) = f(uw) / f(u) if f(uw) > 0, else 0.4 * f(w) / N (Brants et al., 2007), for bigrams. Counts leave out the
document that is scored: its own n-grams are no evidence for it. A word that no other document has counts as half
a word.

Documents are dealt into blocks once. Each block counts its distinct n-grams and sends them to the count table,
which is partitioned by hash: one compressed run of sorted hashes for each block and partition. There runs are
joined and summed; what comes back to a block are the totals of those of its n-grams that other blocks have too
(of the rest it knows the total itself). Then every document's n-grams are joined with their totals and summed.
A frequent n-gram costs one entry for each block, however many rows have it, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import meeting

BACKOFF, UNSEEN = 0.4, 0.5


def ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and their text; hashes of bigrams and the position of their first word. A-Z count as a-z."""
    buf = C.lowered(buf)
    starts, ends, doc = C.words(buf, offsets)
    one = C.span_hashes(buf, starts, ends)
    two, at = C.windows(one, doc, 2)
    return one, doc, C.mix(two + np.uint64(2)), at


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[first], np.add.reduceat(n, first)


def pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted distinct keys and 64-bit counts as bytes."""
    return meeting.pack(keys, n)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, n = meeting.unpack(packed)
    return keys, n.astype(np.int64)


def tallied(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if not len(every):
        return every, np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1])
    return every[first], np.diff(first, append=len(every))


class Tally:
    """Counts of n-grams; raw ones are held up to LIMIT, then counted and merged."""

    LIMIT = 4_000_000

    def __init__(self):
        self.raw, self.size, self.runs = [], 0, []

    def add(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        for a, b in C.chunks(offsets):
            one, _, two, _ = ngrams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            self.raw += [one, two]
            self.size += len(one) + len(two)
            if self.size > self.LIMIT:
                self.settle()

    def settle(self) -> None:
        self.runs.append(tallied(self.raw))
        self.raw, self.size = [], 0
        if len(self.runs) > 4:
            self.runs = [summed(*(np.concatenate(x) for x in zip(*self.runs, strict=True)))]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        return self.runs[0] if len(self.runs) == 1 else summed(*(np.concatenate(x) for x in zip(*self.runs, strict=True)))


#: Beyond so many blocks, they are numbered instead of labelled, and Spark's hash deals them a little unevenly.
MAX_LABELS = 20_000


def block_labels(spark, n: int) -> list[int]:
    """One int for each of n hash partitions, which Spark's partitioning puts there: n rows."""
    rows, size = [], 16 * n + 64
    while len(rows) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("id"))
        rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
        size *= 2
    return [r["id"] for r in rows]


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """key, n_words (long), n_backed_off (long: words without a known bigram), lm_score (double): mean log10 S of the words.

    The first word of a text has no bigram and is backed off. Null and empty texts have 0 words and a null score.
    Repeated rows are documents of their own and so know each other's n-grams. Null keys are scored like others.
    A single document in a table has only unseen words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.small_arrow(spark)
    n_blocks = blocks or C.partitions(spark)
    # One deal for both passes over the texts: Spark finds the exchange of the second to be that of the first. Rows with one key are spread by their text.
    turn = F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)).cast("int")
    label = F.get(F.array(*map(F.lit, block_labels(spark, n_blocks))), turn) if n_blocks <= MAX_LABELS else turn
    dealt = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("block", label).repartition(n_blocks, "block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Tally] = {}
        for batch in batches:
            own = batch.column(2).to_numpy()
            found = np.unique(own).tolist()
            for block in found:
                col = batch.column(1) if len(found) == 1 else batch.column(1).filter(pa.array(own == block))
                held.setdefault(block, Tally()).add(*C.text_bytes(col))
        for block in list(held):
            keys, n = held.pop(block).counts()
            # Hash ranges of equal width are the partitions of the count table.
            cuts = np.searchsorted(keys, np.array([(i << 64) // n_blocks for i in range(1, n_blocks)], np.uint64))
            for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(n, cuts), strict=True)):
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([pack(k, c)], pa.binary())], names=["part", "block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(part, []).append((block, *unpack(counts)))
        for part in list(runs):
            own = runs.pop(part)
            keys, sums = summed(np.concatenate([k for _, k, _ in own]), np.concatenate([n for _, _, n in own]))
            for block, k, n in own:
                all_n = sums[np.searchsorted(keys, k)]
                on = all_n > n
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(k[on], all_n[on])], pa.binary())], names=["block", "totals"])

    counts = dealt.select("id", "t", "block").mapInArrow(count, "part int, block int, counts binary")
    totals = counts.repartitionById(n_blocks, "part").mapInArrow(total, "block int, totals binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [unpack(x) for x in right.column("totals").to_pylist()]
        ids, texts = left.column("id").combine_chunks(), left.column("t")
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
        buf, offsets = C.text_bytes(texts)
        # The block's own counts again, and over them the totals of what others have too.
        tally = Tally()
        tally.add(buf, offsets)
        keys, n = tally.counts()
        for k, whole in known:
            n[np.searchsorted(keys, k)] = whole
        out = [[], [], []]
        for a, b in C.chunks(offsets):
            for values, to in zip(_scored(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keys, n), out, strict=True):
                to.append(values)
        words, backed, sums = (np.concatenate(x) for x in out)
        return pa.table([ids, pa.array(words), pa.array(backed), pa.array(sums)], names=["id", "n_words", "n_backed_off", "sum"])

    kind = docs.schema[key].dataType.simpleString()
    scored = C.kept(dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, n_backed_off long, sum double"))
    size = scored.agg(F.sum("n_words").alias("N")).first()["N"] or 1  # one number
    mean = (F.col("sum") - F.col("n_backed_off") * float(np.log10(size))) / F.col("n_words")
    return scored.select(F.col("id").alias(key), "n_words", "n_backed_off", F.when(F.col("n_words") > 0, mean).alias("lm_score"))


def _scored(buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words backed off, and the sum of log10 S without the factor 1/N of those backed off, by text."""
    one, doc, two, at = ngrams(buf, offsets)
    n = len(offsets) - 1

    def others(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Counts of all documents less this one's. One stable sort by hash leaves a text's equal n-grams side by side."""
        order = np.argsort(hashes, kind="stable")
        h, d = hashes[order], of[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        own = np.concatenate([[True], new[1:] | (d[1:] != d[:-1])])
        first = np.flatnonzero(own)
        total = totals[np.searchsorted(keys, h[new])][np.cumsum(new)[first] - 1]
        out = np.empty(len(h), np.int64)
        out[order] = np.repeat(total - np.diff(first, append=len(h)), np.diff(first, append=len(h)))
        return out

    f1 = others(one, doc) if len(one) else np.zeros(0, np.int64)
    f2 = np.zeros(len(one), np.int64)  # of the bigram that ends at a word
    before = np.ones(len(one), np.int64)
    if len(two):
        f2[at + 1] = others(two, doc[at])
        before[at + 1] = np.maximum(f1[at], 1)
    backed = f2 == 0
    logs = np.where(backed, np.log10(BACKOFF * np.where(f1 > 0, f1, UNSEEN)), np.log10(np.maximum(f2, 1) / before))
    return np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc[backed], minlength=n).astype(np.int64), np.bincount(doc, weights=logs, minlength=n)
