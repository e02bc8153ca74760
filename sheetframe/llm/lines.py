"""Removal of lines that many documents share. DataFrame operations only.

Lines become keys, keys become 128-bit hashes, and only hashes travel. The positions that texts lose travel to the texts where
their bytes, counted beforehand, stay under a bound; beyond it texts move once to meet them. A key's documents are counted by
partial aggregation, so a line that a third of all documents holds costs one row for each task, and the join back to it is
split by Spark where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_strip, kept

#: A checked bound of a broadcast, in repeated lines (24 bytes each).
BROADCAST_LINES = 200_000
#: The same for the positions that texts lose: 48 bytes for a text and 4 for a position.
BROADCAST_BYTES = 64 << 20


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return ascii_lower(ascii_strip(line))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 40, min_docs: int = 5, broadcast_lines: int = BROADCAST_LINES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with `text` rewritten, and n_lines, n_dropped (long) added.

    A key of min_chars code points or more that occurs in min_docs documents (distinct values of `key`) or more
    loses all its lines but those of the largest `key` that has it. The others stay, in their order, joined by
    newlines. Null and empty texts are one empty line and become empty. Rows whose `key` is null are no document:
    they lose nothing and count for nothing. Rows with one `key` are one document, however many and whatever their texts,
    and each loses its own lines.
    Columns of docs named n_lines or n_dropped are replaced.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    lines = source.select("id", F.xxhash64("t").alias("own"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.where(F.length("line") >= min_chars).select("id", "own", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    # Two chained 64-bit hashes with different seeds: 128 bits together.
    lines = lines.select("id", "own", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))
    common = kept(
        lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    few = common.limit(broadcast_lines + 1).count() <= broadcast_lines  # else Spark splits the lines of a hot key
    met = lines.join(F.broadcast(common) if few else common, ["h1", "h2"]).where("id <> keeper")
    # Texts of one key are told apart by their hash; equal ones give a position twice, and the set has it once.
    lost = kept(met.groupBy("id", "own").agg(F.collect_set("pos").alias("_lost")))
    size = lost.agg(F.sum(48 + 4 * F.size("_lost")).alias("bytes")).first()["bytes"] or 0
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("own", F.xxhash64("t"))
    out = rows.join(F.broadcast(lost) if size <= broadcast_bytes else lost, ["id", "own"], "left").withColumn("_lines", F.split("t", "\n"))
    # By hash sets of positions: in proportion to the lines, however many are lost.
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost")), lambda i: F.get("_lines", i))
    rewritten = F.when(F.col("_lost").isNull(), F.col("t")).otherwise(F.array_join(stay, "\n"))
    return out.select(
        *(rewritten.alias(c) if c == text else F.col("row")[c].alias(c) for c in columns),
        F.size("_lines").cast("long").alias("n_lines"), F.greatest(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
