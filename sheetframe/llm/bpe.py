"""Byte-level BPE by a sentencepiece model that is written straight from a table of ranks.

Each of the 256 bytes becomes one printable character; a token of the table becomes the piece of its mapped
bytes, scored by its negative rank, so sentencepiece's best merge is the lowest rank. Normalisation is the
identity. Texts are split into pre-tokens first; each goes through the model alone, and ids are decoded by the
inverse of the byte map. Nothing is trained.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Distinct pre-tokens that a task remembers. A full memory is emptied; results do not depend on it.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a rank file: base64 of the bytes, a space, the rank, one token a line. Read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_map() -> list[str]:
    """A printable character for each byte: the byte's own where Latin-1 prints it, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A serialised sentencepiece model of type BPE, and the rank of each of its piece ids. The unknown piece comes last and is never met."""
    chars = byte_map()
    order = sorted(ranks, key=ranks.__getitem__)
    out = b"".join(_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(ranks[t]))) for t in order)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(order)) + b"".join(_field(k, -1 & (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return out + _field(2, trainer) + _field(3, normalizer), [ranks[t] for t in order]


#: Between pre-tokens in one call of the model; the byte map doesn't reach it.
BAR = "\u0700"
#: Below this code point, classes of characters can be written out for Python's own, faster re.
PLAIN = 0x250


def splitter(pattern: str):
    """A function from a text to its pre-tokens, the matches of pattern.

    Texts all below PLAIN go through re, with \\p{L}, \\p{N} and white space as explicit classes; others, and patterns with more than those, through regex.
    """
    import re
    import unicodedata

    import regex

    full = regex.compile(pattern).findall

    def body(test) -> str:
        return "".join(f"\\u{c:04x}" for c in range(PLAIN) if test(chr(c)))

    classes = {"\\p{L}": body(lambda c: unicodedata.category(c)[0] == "L"), "\\p{N}": body(lambda c: unicodedata.category(c)[0] == "N"), "\\s": "\\t-\\r \\x85\\xa0"}
    out, at, inside = [], 0, False
    while at < len(pattern):
        if name := next((k for k in (*classes, "\\S") if pattern.startswith(k, at)), None):
            if name == "\\S" and inside:
                return full
            out.append(f"[^{classes[name.lower()]}]" if name == "\\S" else classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
            continue
        c = pattern[at]
        if c == "\\":
            return full
        inside = c == "[" or inside and c != "]"
        out.append(c)
        at += 1
    quick, beyond = re.compile("".join(out)).findall, re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]").search
    return lambda text: full(text) if beyond(text) else quick(text)


class Encoder(dict):
    """pre-token -> list of ids. Those not remembered go through the model, all of a call together."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        model, self.ids = sentencepiece_model(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks, self.chars = ranks, dict(enumerate(byte_map()))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(tokens)
        merged = []
        for t in new:
            raw = t.encode()
            # A pre-token that is a token of the table as it stands needs no merges.
            if (whole := self.ranks.get(raw)) is not None:
                self[t] = (whole,)
            else:
                merged.append((t, raw.decode("latin-1").translate(self.chars)))
        for at in range(0, len(merged), 512):
            self._merge(merged[at : at + 512])

    def _merge(self, tokens: list[tuple[str, str]]) -> None:
        """Many pre-tokens in one call: no piece holds the bar between them, so no merge crosses it, and it comes back as the unknown id."""
        found, lo, ids = self.model.encode(BAR.join([m for _, m in tokens])), 0, self.ids
        found.append(len(ids))
        for t, _ in tokens:
            hi = found.index(len(ids), lo)
            self[t] = tuple([ids[i] for i in found[lo:hi]])
            lo = hi + 1

    def encode(self, texts: list[list[str]]) -> list[list[int]]:
        """Ids of texts that are given as pre-tokens."""
        self.learn(set().union(*texts))
        return [list(chain.from_iterable(map(self.__getitem__, tokens))) for tokens in texts]


def _schema(docs: DataFrame, added: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{k}` {v}" for k, v in added.items())])


def _mapped(docs: DataFrame, rank_table: dict[bytes, int], pattern: str, source: str, steps: tuple[str, ...], to: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    rows = docs.select(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in to))  # earlier columns of these names are replaced
    schema = _schema(rows, to)
    C.small_arrow(docs.sparkSession)
    # A vocabulary's size is fixed (under a few MB), whatever the data.
    held = docs.sparkSession.sparkContext.broadcast(rank_table)
    rows = docs.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(source).alias(C.fresh(docs, "_source")))
    names = [*rows.columns[:-1], *to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, encoder = splitter(pattern), None
        inverse = {v: k for k, v in held.value.items()}
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                values, out = batch.column(batch.num_columns - 1), []
                if "encode" in steps:
                    encoder = encoder or Encoder(held.value)
                    ids = encoder.encode([split(t) if t else [] for t in values.to_pylist()])
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                else:
                    ids = values.to_pylist()
                if "decode" in steps:
                    out.append(pa.array([b"".join(map(inverse.__getitem__, x or ())) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=names)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with `to` (array of int): the ids of the whole text. Null and empty texts have none. No shuffle; rows stay as they are, repeated ones too."""
    return _mapped(docs, ranks, pattern, text, ("encode",), {to: "array<int>"})


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with `to` (binary): the bytes of `ids`. Null and empty lists give no bytes; an id that the table lacks is an error."""
    return _mapped(docs, ranks, "", ids, ("decode",), {to: "binary"})


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", to: tuple[str, str] = ("ids", "decoded"), keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() of its ids in one pass; with `keep`, only those of docs' columns stay."""
    return _mapped(docs, ranks, pattern, text, ("encode", "decode"), {to[0]: "array<int>", to[1]: "binary"}, keep)
