"""Quality rules as a ledger of bits: every rule is evaluated once, policies are masks over the bits.

measure() makes one pass over the texts and adds the measurements; ledger() turns them into one long of
failure bits. A policy is a named, versioned set of rules: applying one is a bitwise AND, and ablations (what
would be kept without a rule) come from the counts of the distinct bit patterns, never from the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_top_word")


@dataclass(frozen=True)
class Rule:
    """A text fails if low <= measure * 1000 / base <= high does not hold (measure alone if base is empty). Integer arithmetic only."""

    bit: int
    name: str
    measure: str
    base: str = ""
    low: int | None = None
    high: int | None = None


#: Bits are never given again once a policy has used them.
RULES = (
    Rule(0, "too_few_words", "n_words", low=50),
    Rule(1, "repeated_windows", "n_repeat_words", "n_words", high=500),
    Rule(2, "symbols", "n_symbols", "n_words", high=300),
    Rule(3, "short_or_long_words", "word_chars", "n_words", low=2000, high=14000),
    Rule(4, "upper_case", "n_upper", "n_letters", high=400),
    Rule(5, "bangs", "n_bangs", "n_words", high=300),
    Rule(6, "duplicate_lines", "n_dup_lines", "n_lines", high=400),
    Rule(7, "one_word_dominates", "n_top_word", "n_words", high=300),
)
#: Name and version of each policy, and the rules that it applies.
POLICIES = {
    "base/1": ("too_few_words", "repeated_windows"),
    "web/1": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


_SYMBOL, _UPPER, _LETTER, _BANG = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_BANG[ord("!")] = True


def _largest(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how often its most frequent key occurs; keys already tell owners apart."""
    out = np.zeros(n, np.int64)
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    np.maximum.at(out, owner[first], count)
    return out


def _measured(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    gap = C._GAP[buf]
    begins = (buf & 0xC0) != 0x80  # first bytes of code points
    starts, ends, doc = C.words(buf, offsets)
    own = C.mix(doc.astype(np.uint64) + np.uint64(1))  # keys of different texts never meet
    hashes = C.span_hashes(buf, starts, ends)
    grams, at = C.windows(hashes, doc, 3)
    _, back, count = np.unique(grams ^ own[at], return_inverse=True, return_counts=True)
    marked = np.zeros(len(starts), bool)
    twice = at[count[back] >= 2] if len(at) else at
    for k in range(3):
        marked[twice + k] = True
    sums = lambda flags: np.bincount(doc[flags], minlength=n).astype(np.int64)
    # Lines with a word, and those among them that an earlier line of the text equals.
    l_starts, l_ends, l_doc = C.spans(buf != 10, offsets)
    run = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~gap, out=run[1:])
    full = run[l_ends] > run[l_starts]
    l_starts, l_ends, l_doc = l_starts[full], l_ends[full], l_doc[full]
    keys = C.span_hashes(buf, l_starts, l_ends) ^ C.mix(l_doc.astype(np.uint64) + np.uint64(1))
    n_lines = np.bincount(l_doc, minlength=n).astype(np.int64)
    distinct = np.bincount(l_doc[np.unique(keys, return_index=True)[1]], minlength=n).astype(np.int64)
    return [
        sums(np.ones(len(doc), bool)), C.per_text(begins & ~gap, offsets), C.per_text(_SYMBOL[buf], offsets), n_lines - distinct, sums(marked),
        n_lines, C.per_text(_UPPER[buf], offsets), C.per_text(_LETTER[buf], offsets), C.per_text(_BANG[buf], offsets), _largest(hashes ^ own, doc, n),
    ]


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with MEASURES (long) added. One pass, no shuffle.

    Words are runs without white space ([\\x20\\x09-\\x0D]); everything is exact over the whole text, whatever
    its length. Null is measured as the empty text: all measurements are 0. Repeated rows are measured each.
    Columns of docs with names of MEASURES are replaced.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in MEASURES)
    C.small_arrow(docs.sparkSession)
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias(C.fresh(docs, "_text")))
    names = [*keep, *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column(batch.num_columns - 1))
            parts = [_measured(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in C.chunks(offsets)]
            sums = [pa.array(np.concatenate(x)) if parts else pa.array([], pa.int64()) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], names=names)

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{m} long" for m in MEASURES)])
    return source.mapInArrow(run, fields)


def failed(rule: Rule) -> Column:
    value = F.col(rule.measure) * (1000 if rule.base else 1)
    base = F.col(rule.base) if rule.base else F.lit(1)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low * base)
    if rule.high is not None:
        out = out | (value > rule.high * base)
    return out


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with failed_bits (long): bit r.bit is set where rule r fails. A rule over a base of 0 fails only if its measure is over 0."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(failed(r), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: str, to: str = "kept") -> DataFrame:
    """A ledger with the verdict of a policy: kept where none of the policy's bits is set."""
    return rows.withColumn(to, F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only, n_kept, n_kept_without for each rule of a policy; an empty ledger gives zeros.

    Patterns of bits are counted first (at most 2 to the number of rules rows), so each row of the ledger is read once.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    whole, out = mask(policy), None
    hit = F.col("failed_bits").bitwiseAND(F.lit(whole))
    named = [r for r in RULES if r.name in POLICIES[policy]]
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    sums = patterns.agg(*(total(c).alias(f"{k}_{r.bit}") for r in named for k, c in (("failed", hit.bitwiseAND(F.lit(1 << r.bit)) != 0), ("only", hit == (1 << r.bit)))), total(hit == 0).alias("kept"))
    for r in named:
        one = sums.select(F.lit(r.name).alias("rule"), F.col(f"failed_{r.bit}").alias("n_failed"), F.col(f"only_{r.bit}").alias("n_only"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"only_{r.bit}")).alias("n_kept_without"))
        out = one if out is None else out.unionAll(one)
    return out
