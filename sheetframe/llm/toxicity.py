"""Toxicity by a composed grammar of weighted finite-state transducers over clauses, learned from labels.

A lexical transducer turns the words of a clause into symbols: insult (with its weight), act, modal, target, negation, report,
other. Four small transducers are composed into one machine, each reading what the one before puts out:

    threats      an act within reach of a modal verb becomes a threat, any other act nothing
    negations    insults and threats within reach of a negation are marked n
    reports      insults and threats after a verb of reported speech are marked r
    targets      passes all on, and says at the clause's end whether somebody was addressed (t)

What comes out of a clause are matches of patterns (kind, n, r, t); of each pattern only the strongest match of the clause counts.
A text's evidence is, for each pattern, the sum of its clauses' matches; a weight for each pattern turns it into a score. A word
that no clause matches with scores nothing, and repeating it within its clause adds nothing.

Learned from labels: the lexicon (words, and beginnings of words, of any language that stand in significantly more toxic texts than
chance would put there; copies of a text prove nothing), and the patterns' weights, drawn towards the grammar's own where data are few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that a model is fitted on at most, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Words of the transducers in English, German, French and Spanish (fixed values). Insults here carry a weight of their own; labels raise or drop them.
INSULTS = (
    "asshole", "bastard", "bitch", "cretin", "dumb", "filth", "fool", "freak", "garbage", "imbecile", "jerk", "scumbag", "ugly", "vermin",
    "arschloch", "abschaum", "drecksau", "dummkopf", "schlampe", "trottel", "connard", "salope", "crétin", "ordure", "cabrón", "imbécil", "gilipollas", "escoria",
)
ACTS = (
    "kill", "hurt", "beat", "destroy", "shoot", "stab", "burn", "hang", "töten", "umbringen", "schlagen", "erschießen", "tuer", "frapper", "brûler", "matar", "golpear", "quemar",
)
MODALS = ("will", "gonna", "shall", "should", "must", "werde", "wird", "soll", "muss", "vais", "va", "doit", "dois", "voy", "vas", "debe", "debes")
TARGETS = (
    "you", "your", "yours", "u", "ur", "he", "she", "him", "her", "they", "them", "their", "everyone", "people",
    "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "ils", "tú", "ti", "vosotros", "ustedes", "ellos",
)
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "won't", "nobody", "without", "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "nunca", "sin")
REPORTS = ("said", "says", "wrote", "quoted", "called", "reported", "claims", "according", "allegedly", "sagte", "schrieb", "angeblich", "nannte", "dit", "écrit", "selon", "prétend", "dijo", "escribió", "según")
PRIOR = 1.0
#: What the grammar itself says of a pattern's weight: of a threat, and under each mark.
THREAT, NEGATED, REPORTED, TARGETED = 0.8, 0.3, 0.4, 1.25
WORD = re.compile(r"\w+(?:'\w+)?")
CLAUSE = re.compile(r"[.!?;:\n]")
BORDERS = ".!?;:\n"
PREFIXES = range(4, 9)
PATTERNS = tuple("".join(p) for p in product("IX", ("", "n"), ("", "r"), ("", "t")))


@dataclass(frozen=True)
class Transducer:
    """A deterministic finite-state transducer: step[state, symbol] is (next state, output); last[state] is put out at the end."""

    step: dict
    last: dict
    start: object = 0

    def run(self, symbols: list[str]) -> tuple[list[str], str]:
        state, out = self.start, []
        for symbol in symbols:
            state, put = self.step[state, symbol]
            out.append(put)
        return out, self.last[state]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one puts out, symbol by symbol."""
        begin = (self.start, other.start)
        step, last, open_ = {}, {}, [begin]
        symbols = {symbol for _, symbol in self.step}
        while open_:
            state = open_.pop()
            if state in last:
                continue
            last[state] = self.last[state[0]] + other.last[state[1]]
            for symbol in symbols:
                a, put = self.step[state[0], symbol]
                b, put = other.step[state[1], put]
                step[state, symbol] = ((a, b), put)
                open_.append((a, b))
        return Transducer(step, last, begin)


def _machine(states: range, symbols: tuple[str, ...], rule, last=lambda state: "") -> Transducer:
    return Transducer({(q, x): rule(q, x) for q in states for x in symbols}, {q: last(q) for q in states})


def threats(reach: int) -> Transducer:
    """I, K, M, T, N, R, . to I, X, T, N, R, . ; the state counts down from a modal verb."""

    def rule(q: int, x: str) -> tuple[int, str]:
        if x == "M":
            return reach, "."
        return max(0, q - 1), ("X" if q else ".") if x == "K" else x

    return _machine(range(reach + 1), ("I", "K", "M", "T", "N", "R", "."), rule)


def negations(reach: int) -> Transducer:
    """Marks I and X with n while the state counts down from a negation; with a reach of 0, never."""

    def rule(q: int, x: str) -> tuple[int, str]:
        if x == "N":
            return reach, "."
        return max(0, q - 1), x + "n" if q and x in "IX" else x

    return _machine(range(reach + 1), ("I", "X", "T", "N", "R", "."), rule)


def reports(marks: bool = True) -> Transducer:
    """Marks I and X with r from a report on, if it marks at all."""

    def rule(q: int, x: str) -> tuple[int, str]:
        if x == "R":
            return int(marks), "."
        return q, x + "r" if q and x[0] in "IX" else x

    return _machine(range(2), ("I", "X", "In", "Xn", "T", "R", "."), rule)


def targets(marks: bool = True) -> Transducer:
    """Passes matches on and says t at the end if a target was met, wherever in the clause, if it marks at all."""

    def rule(q: int, x: str) -> tuple[int, str]:
        return (int(marks), ".") if x == "T" else (q, x)

    return _machine(range(2), (*(k + n + r for k in "IX" for n in ("", "n") for r in ("", "r")), "T", "."), rule, lambda q: "t" if q else "")


def grammar(reach: int = 4, negate: bool = True, report: bool = True, target: bool = True) -> Transducer:
    """The composition of all four; those switched off pass everything on."""
    return threats(reach).then(negations(reach if negate else 0)).then(reports(report)).then(targets(target))


def own_weight(pattern: str) -> float:
    """The grammar's own weight of a pattern."""
    out = THREAT if pattern[0] == "X" else 1.0
    for mark, factor in (("n", NEGATED), ("r", REPORTED), ("t", TARGETED)):
        out *= factor if mark in pattern else 1.0
    return out


@dataclass
class Lexicon:
    """Weights (in log odds) of words, and of beginnings of longer words; weights of the patterns, and the offset of the score."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=lambda: {p: own_weight(p) for p in PATTERNS})
    offset: float = -2.5

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for k in PREFIXES:
            if len(word) <= k:
                break
            found = max(found, self.prefixes.get(word[:k], 0.0))
        return found

    def score(self, found: dict[str, float]) -> float:
        z = self.offset + sum(self.patterns[p] * x for p, x in found.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Reader:
    """The lexical transducer and a grammar over the clauses of texts."""

    def __init__(self, lexicon: Lexicon, machine: Transducer | None = None):
        import ahocorasick

        self.lexicon, self.machine = lexicon, machine or grammar()
        self.symbols = {w: m for m, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", MODALS), ("K", ACTS)) for w in ws}
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for entry in {*lexicon.words, *lexicon.prefixes, *ACTS}:
            self.matcher.add_word(entry)
        self.matcher.make_automaton()

    def clause(self, words: list[str]) -> dict[str, float]:
        """The strongest match of each pattern."""
        weights = [self.lexicon.insult(w) for w in words]
        out, end = self.machine.run(["I" if x else self.symbols.get(w, ".") for w, x in zip(words, weights, strict=True)])
        found: dict[str, float] = {}
        for put, x in zip(out, weights, strict=True):
            if put[0] in "IX":
                found[put + end] = max(found.get(put + end, 0.0), x or PRIOR)
        return found

    def text(self, text: str) -> dict[str, float]:
        """Sums over a text's clauses. Only clauses with a possible match are read, from border to border, however long."""
        low = text.lower()
        total: dict[str, float] = {}
        done = 0
        for end, size in self.matcher.iter(low):
            at = end - size
            if end < done or at >= 0 and (low[at].isalnum() or low[at] == "_"):
                continue
            begin = max(done, *(low.rfind(c, done, end + 1) + 1 for c in BORDERS))
            stop = CLAUSE.search(low, end + 1)
            done = stop.start() if stop else len(low)
            for p, x in self.clause(WORD.findall(low, begin, done)).items():
                total[p] = total.get(p, 0.0) + x
        return total


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _features(text: str) -> dict[str, int]:
    """Words and beginnings of words, each with the least hash of its surroundings: near copies of a text mostly agree in it."""
    words = WORD.findall(text.lower())
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        if len(w) < 3:
            continue
        around = zlib.crc32(" ".join(words[max(0, i - 1) : i + 2]).encode())
        for f in (w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)):
            out[f] = min(out.get(f, around), around)
    return out


def significance(s: np.ndarray, s0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of s toxic and s0 clean texts against the rate of all texts, 0 where toxic ones are no more than expected."""
    expected = (s + s0) * n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = s * np.log(s / expected) + np.where(s0 > 0, s0 * np.log(s0 / np.maximum(s + s0 - expected, 1e-9)), 0.0)
    return np.where(s > expected, g, 0.0)


#: A lexicon's entry stands in so many different toxic texts at least, in so many times more than in clean ones by rate, and is so significant beyond the log of the number of entries tried.
SUPPORT, RATIO, MARGIN = 6, 4.0, 5.0


def _telling(found: dict[str, tuple[float, float]], n1: int, n0: int) -> list[str]:
    """Features (with their toxic and clean texts) less the beginnings of words that say little beyond their most frequent longer feature.

    The texts that a beginning has beyond those must by themselves satisfy SUPPORT and RATIO.
    """
    longer: dict[str, tuple[float, float]] = {}
    for f, (s, s0) in found.items():
        k = f.rstrip("*")
        for at in PREFIXES:
            if at < len(k):
                longer[f"{k[:at]}*"] = max(longer.get(f"{k[:at]}*", (0.0, 0.0)), (s, s0))
    out = []
    for f in sorted(found):
        s, s0 = (a - b for a, b in zip(found[f], longer.get(f, (0.0, 0.0)), strict=True))
        if f not in longer or s >= SUPPORT and (s + 0.5) * (n0 + 1) >= RATIO * (max(s0, 0) + 0.5) * (n1 + 1):
            out.append(f)
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon and weights from the labelled rows outside the held-out fifth, at most `sample` of them (smallest hashes first).

    Null labels and texts teach nothing. Without toxic or clean rows, the fixed words and the grammar's own weights are all.
    Keys may be of any type; they are compared as texts. What comes to the driver grows with `sample`, not with docs.
    """
    spark = docs.sparkSession
    C.small_arrow(spark)
    taught = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    taught = taught.select(F.col(key).cast("string").alias("_id"), (F.col(label) > 0).alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)  # top-k: bounded
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("_id"), F.col(text).alias("t")).join(F.broadcast(taught), "_id").select("t", "y")
    rows = C.kept(rows.repartition(min(64, C.partitions(spark))))
    counts = {bool(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    lexicon = Lexicon({w: PRIOR for w in INSULTS})
    if not n1 or not n0:
        return lexicon

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({pair for t in batch.column(0).to_pylist() for pair in _features(t).items()})
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([a for _, a in pairs], pa.int64())], names=["f", "around"])

    # Different texts with a feature: those whose least surroundings differ.
    found = rows.where("y").select("t").mapInArrow(of_toxic, "f string, around long")
    toxic_texts = C.kept(found.groupBy("f", "around").agg(F.lit(1).alias("one")).groupBy("f").agg(F.count("*").alias("texts")))
    tried = toxic_texts.count()
    toxic = {r["f"]: r["texts"] for r in toxic_texts.where(F.col("texts") >= SUPPORT).collect()}  # bounded by the sample
    held = spark.sparkContext.broadcast(frozenset(toxic))

    def of_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(f for t in batch.column(0).to_pylist() for f in _features(t).keys() & held.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "texts"])

    # Of clean texts copies count, which can only lower a feature's strength.
    clean = {r["f"]: r["texts"] for r in rows.where("not y").select("t").mapInArrow(of_clean, "f string, texts long").groupBy("f").agg(F.sum("texts").alias("texts")).collect()}
    names = sorted(toxic)
    s, s0 = (np.array([c.get(f, 0) for f in names], float) for c in (toxic, clean))
    strength = np.log((s + 0.5) / (n1 + 1)) - np.log((s0 + 0.5) / (n0 + 1))
    proven = (significance(s, s0, n1, n0) >= np.log(max(tried, 1)) + MARGIN) & (strength >= np.log(RATIO))
    known = {f: (toxic[f], clean.get(f, 0), w) for f, w, ok in zip(names, strength.tolist(), proven, strict=True) if ok}
    for f in _telling({f: x[:2] for f, x in known.items()}, n1, n0):
        (lexicon.prefixes if f.endswith("*") else lexicon.words)[f.rstrip("*")] = known[f][2]
    for w in INSULTS:  # a fixed word that is frequent without being a sign of toxic texts is dropped
        if w in toxic and lexicon.words[w] == PRIOR:
            del lexicon.words[w]

    points = rows.select("y", _reader_udf(lexicon, False)("t").alias("x")).groupBy("y", "x").agg(F.count("*").alias("n")).collect()  # at most `sample` rows
    return _weighted(lexicon, [(r["x"], r["y"], r["n"]) for r in points])


def _weighted(lexicon: Lexicon, points: list[tuple[list[float], bool, int]], ridge: float = 4.0) -> Lexicon:
    """Logistic regression by Newton steps: a common slope over the grammar's own weights, an offset, and what each pattern departs from it."""
    x = np.array([p[0] for p in points], float).reshape(len(points), len(PATTERNS))
    y, n = np.array([p[1] for p in points], float), np.array([p[2] for p in points], float)
    own = np.array([own_weight(p) for p in PATTERNS])
    design = np.column_stack([x @ own, np.ones(len(points)), x])
    penalty = np.diag([0.01, 0.01] + [ridge] * len(PATTERNS))
    w = np.zeros(design.shape[1])
    w[:2] = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + penalty, design.T @ (n * (p - y)) + penalty @ w)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    lexicon.patterns = dict(zip(PATTERNS, np.maximum(max(w[0], 0.1) * own + w[2:], 0.0).tolist(), strict=True))
    lexicon.offset = min(float(w[1]), -0.1)
    return lexicon


def _reader_udf(lexicon: Lexicon, scored: bool):
    """texts to scores, or to the sums of all patterns."""
    import pandas as pd

    def read(batches: Iterator) -> Iterator:
        reader = Reader(lexicon)
        for texts in batches:
            found = [reader.text(t) if t else {} for t in texts]
            yield pd.Series([lexicon.score(x) for x in found], dtype="float64") if scored else pd.Series([[x.get(p, 0.0) for p in PATTERNS] for x in found])

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(read, "double" if scored else "array<double>")


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "toxicity") -> DataFrame:
    """docs with `to` (double, 0 to 1, higher is more toxic). Null and empty texts have no evidence and the lowest score.

    Whole texts and whole clauses are read. No shuffle. A column of docs named `to` is replaced; repeated rows are scored each.
    """
    C.small_arrow(docs.sparkSession)
    return docs.withColumn(to, _reader_udf(lexicon, True)(F.col(text)))
