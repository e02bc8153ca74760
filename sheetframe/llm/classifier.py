"""A quality classifier without labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Labellers vote good, bad or nothing on measurements of a text. Votes of all documents are counted by pattern (at
most 3 to the number of labellers rows); expectation-maximisation over these counts estimates how each labeller
votes on good and on bad texts, and so the chance that a pattern is good. A bounded sample of documents with these
chances as soft labels trains a linear scorer over hashed features of the text itself, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import quality as Q

#: Documents that the scorer is trained on at most (those with the smallest hashes of their ids), and its features: trigrams of kinds, levels, words.
SAMPLE = 8_000
TRIGRAMS, LEVELS, WORDS = 512, 512, 512
BUCKETS = TRIGRAMS + LEVELS + WORDS
#: name, measure, base, bad from this share of it on (per thousand), plain up to this share. Each votes bad or nothing.
LABELLERS = (
    ("repeats", "n_repeat_words", "n_words", 500, 150),
    ("symbols", "n_symbols", "n_words", 300, 50),
    ("capitals", "n_upper", "n_letters", 400, 100),
    ("bangs", "n_bangs", "n_words", 300, 20),
    ("same_lines", "n_dup_lines", "n_lines", 400, 50),
    ("one_word", "n_top_word", "n_words", 300, 150),
)
#: The labellers above and one more, which votes good where all shares are plain.
VOTERS = len(LABELLERS) + 1
#: Before any counts: bad votes on good texts are this rare, and this share of all texts says so.
RARE, BELIEF = 0.002, 0.05
#: A good text isn't plain with this chance at least, however few of a corpus are not.
NOT_PLAIN = 0.2


def _votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One digit for each voter in base 3: 0 nothing, 1 good, 2 bad. Texts of under 5 words get no votes."""
    enough = m["n_words"] >= 5
    plain, out = enough.copy(), np.zeros(len(enough), np.int64)
    for k, (_, measure, base, bad, good) in enumerate(LABELLERS):
        share, whole = m[measure] * 1000, m[base]
        out += np.where(enough & (whole > 0) & (share >= bad * whole), 2 * 3**k, 0)
        plain &= share <= good * whole
    return out + np.where(plain, 3 ** len(LABELLERS), 0)


@dataclass
class LabelModel:
    """Chances of a good text, and of each labeller's votes on bad (row 0) and good (row 1) texts."""

    good: float
    votes: np.ndarray  # labeller, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(np.array([[1 - self.good], [self.good]])) + np.zeros((2, len(patterns)))
        for k in range(VOTERS):
            seen = np.log(self.votes[k])
            if k == VOTERS - 1:
                seen[1, 0] = max(seen[1, 0], np.log(NOT_PLAIN))
            log += seen[:, patterns // 3**k % 3]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Accuracies of overlapping labellers and the share of good texts, from the counts of vote patterns.

    Kinds of bad texts differ, and mostly one labeller sees each; so the prior says what no count can: that bad votes
    on good texts are RARE. How often each labeller sees a bad text, and how common these are, is estimated.
    """
    digits = np.stack([patterns // 3**k % 3 for k in range(VOTERS)])
    p = np.where((digits == 2).any(0), 0.1, 0.9)
    prior = np.ones((VOTERS, 2, 3))
    weight = BELIEF * counts.sum()
    prior[:-1, 1, 2] += RARE * weight
    prior[:-1, 1, 0] += (1 - RARE) * weight
    model = LabelModel(0.5, prior / prior.sum(2, keepdims=True))
    for _ in range(rounds):
        weights = np.stack([(1 - p) * counts, p * counts])
        votes = prior + np.stack([[[weights[c][d == v].sum() for v in range(3)] for c in range(2)] for d in digits])
        model = LabelModel(float((weights[1].sum() + 1) / (weights.sum() + 2)), votes / votes.sum(2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


_KIND = np.arange(256, dtype=np.uint32)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _features(buf: np.ndarray, offsets: np.ndarray, measures: dict[str, np.ndarray]) -> np.ndarray:
    """Shares of hashed trigrams of character kinds (length 1), hashed levels of the measured shares, and shares of hashed words (length 1)."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    out = np.zeros((n, BUCKETS), np.float32)
    if len(buf) > 2:
        kind = _KIND[buf]
        grams = ((kind[:-2] * np.uint32(0x9E3779B1)) ^ (kind[1:-1] * np.uint32(0x85EBCA77)) ^ (kind[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(23)  # to TRIGRAMS
        on = doc[:-2] == doc[2:]
        out[:, :TRIGRAMS] = _shares(doc[:-2][on], grams[on].astype(np.int32), n, TRIGRAMS)
    low = C.lowered(buf)
    starts, ends, of = C.words(low, offsets)
    if len(starts):
        out[:, TRIGRAMS + LEVELS :] = _shares(of, (C.span_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int32), n, WORDS)
    for k, (_, measure, base, _, _) in enumerate(LABELLERS):
        level = np.minimum(20, measures[measure] * 20 // np.maximum(measures[base], 1))
        out[np.arange(n), TRIGRAMS + (C.mix((level + 100 * k).astype(np.uint64)) % np.uint64(LEVELS)).astype(np.int64)] += 0.5
    return out


def _shares(doc: np.ndarray, feature: np.ndarray, n: int, width: int) -> np.ndarray:
    """Roots of the counts of features by text, each row of length 1 (0 without features)."""
    out = np.sqrt(np.bincount(doc.astype(np.int64) * width + feature, minlength=n * width).reshape(n, width)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    buf, offsets = C.text_bytes(batch.column(batch.num_columns - 1))
    for a, b in C.chunks(offsets, 1 << 19):
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, part, at, dict(zip(Q.MEASURES, Q._measured(part, at), strict=True))


@dataclass
class Scorer:
    weights: np.ndarray
    offset: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30)))


def train(features: np.ndarray, target: np.ndarray, steps: int = 300, ridge: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by gradient steps of adapted size; both classes weigh the same."""
    w, b = np.zeros(features.shape[1], np.float32), 0.0
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    weight = (weight / weight.sum()).astype(np.float32)
    target = target.astype(np.float32)
    sums, sum_b = np.full(len(w), 1e-8, np.float32), 1e-8
    for _ in range(steps):
        error = weight * (Scorer(w, b).score(features) - target)
        g, gb = error @ features + np.float32(ridge) * w, float(error.sum())
        sums, sum_b = sums + g * g, sum_b + gb * gb
        w, b = w - np.float32(0.5) * g / np.sqrt(sums), b - 0.5 * gb / float(np.sqrt(sum_b))
    return Scorer(w.astype(np.float32), float(b))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model over all documents, and the scorer from at most `sample` of them. Without rows, a scorer that finds all good."""
    spark = docs.sparkSession
    C.small_arrow(spark)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.concatenate([_votes(m) for *_, m in _read(batch)] or [np.zeros(0, np.int64)])
            found, n = np.unique(votes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["p", "n"])

    counted = docs.select(F.col(text).alias("t")).mapInArrow(patterns, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()  # 3 ** labellers rows at most
    if not counted:
        return LabelModel(0.5, np.full((VOTERS, 2, 3), 1 / 3)), Scorer(np.zeros(BUCKETS, np.float32), 1.0)
    model = expectation_maximisation(np.array([r["p"] for r in counted]), np.array([r["n"] for r in counted], float))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at, m in _read(batch):
                rows = _features(buf, at, m).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(model.posterior(_votes(m)))], names=["x", "y"])

    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.select(F.col(key).alias("_id"), F.col(text).alias("t")).join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("t").alias("t")).select("t")  # of repeated ids, the least text
    rows = chosen.mapInArrow(sampled, "x binary, y double").toArrow()  # at most `sample` rows of 3 KB
    if not rows.num_rows:
        return model, Scorer(np.zeros(BUCKETS, np.float32), 1.0)
    found = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True))  # equal tables give equal weights, in whatever order rows come
    features = np.stack([np.frombuffer(x, np.float16) for x, _ in found]).astype(np.float32)
    return model, train(features, np.array([y for _, y in found]))


def classify(docs: DataFrame, model: LabelModel, scorer: Scorer, text: str = "text", keep: tuple[str, ...] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs (or its columns `keep`) with weak_label (double, the label model's chance of good; its own votes only), quality_score (0 to 1) and kept.

    Null and empty texts are scored like any other, from the offset alone. One pass, no shuffle.
    Columns of docs with the names of these three are replaced; repeated rows are scored each.
    """
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in ("weak_label", "quality_score", "kept"))
    C.small_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at, m in _read(batch):
                score = scorer.score(_features(buf, at, m)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(model.posterior(_votes(m))), pa.array(score), pa.array(score >= threshold)], names=[*keep, "weak_label", "quality_score", "kept"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "weak_label double", "quality_score double", "kept boolean"])
    return docs.select(*keep, F.col(text).alias(C.fresh(docs, "_text"))).mapInArrow(run, fields)
