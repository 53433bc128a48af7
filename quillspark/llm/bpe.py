"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: its protocol buffer is written from the ranks of a
public vocabulary. Every byte is shown as one printable character, a piece is
the byte-mapped form of a token and scores minus its rank, and normalisation is
the identity, so the best-scoring merge of sentencepiece is the lowest-ranked
merge of the vocabulary. Texts are cut into pre-tokens first and each pre-token
is encoded by itself; decoding maps ids to pieces and pieces to bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; equal
texts have equal ids; special tokens are ordinary text. One document is held in
memory at a time besides a bounded cache of pre-tokens. The model is a few
megabytes for any input and travels to the tasks with the function.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Sequence
from itertools import chain

import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType

from quillspark.llm.batches import map_texts

CACHED_PRETOKENS = 400_000
NARROW = 0x250
# A name that no byte-mapped text contains.
UNKNOWN = "▁unknown"


def byte_characters() -> list[str]:
    """One printable character per byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank file; ids are ranks and the unknown piece comes last.

    Field numbers are those of the published sentencepiece_model.proto.
    """
    shown = byte_characters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [("".join(shown[b] for b in token), -float(rank), 1) for rank, token in enumerate(order)] + [(UNKNOWN, 0.0, 2)]
    out = [_bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind)) for text, score, kind in pieces]
    out.append(_bytes(2, _number(3, 2) + _number(4, len(pieces)) + _bytes(45, UNKNOWN.encode())))
    out.append(_bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


def narrow_pattern(pattern: str) -> re.Pattern:
    """The pattern with its character classes written out for texts below U+0250, where the plain engine is faster."""
    listed = {c: "".join(re.escape(chr(i)) for i in range(NARROW) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def written(match):
        found = match[0]
        if found[0] == "[":
            for name, characters in listed.items():
                found = found.replace(name, characters)
            return found
        return f"[^{listed[chr(92) + 's']}]" if found == r"\S" else f"[{listed[found]}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", written, pattern))


class Codec:
    """Encoder and decoder of one model; lives in one task."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.wide = regex.compile(pattern).findall
        self.narrow = narrow_pattern(pattern).findall
        self.beyond = re.compile(f"[^\0-{chr(NARROW - 1)}]").search
        shown = byte_characters()
        self.show = dict(enumerate(shown))
        hidden = {ord(c): b for b, c in enumerate(shown)}
        names = self.pieces.id_to_piece(list(range(self.pieces.get_piece_size() - 1)))
        self.token = [bytes(hidden[ord(c)] for c in name) for name in names]
        self.whole = {name: i for i, name in enumerate(names)}
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.wide(text) if self.beyond(text) else self.narrow(text)

    def _learn(self, new: list[str]) -> None:
        mapped = [t.encode("utf-8").decode("latin-1").translate(self.show) for t in new]
        encoded = self.pieces.encode(mapped, out_type=int, num_threads=1)
        for pretoken, name, ids in zip(new, mapped, encoded):
            # A pre-token that is a token stays whole, as in the public tokenizer.
            self.cache[pretoken] = array("I", [self.whole[name]] if name in self.whole else ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        if len(self.cache) > CACHED_PRETOKENS:
            self.cache.clear()
        new = set(chain.from_iterable(split)).difference(self.cache)
        if new:
            self._learn(list(new))
        known = self.cache.__getitem__
        return [b"".join(map(known, pretokens)) for pretokens in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


def encode(docs: DataFrame, model: bytes, pattern: str, keep: Sequence[str], text: str = "text",
           names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """The kept columns, the packed ids of each text and the bytes they decode to."""

    def make():
        codec = Codec(model, pattern)

        def work(texts):
            ids = codec.encode(texts)
            return ids, [codec.decode(i) for i in ids]

        return work

    return map_texts(docs, keep, make, [(n, BinaryType()) for n in names], text)
