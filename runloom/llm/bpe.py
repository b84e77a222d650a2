"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut into pieces by the pattern of the vocabulary. The symbols of a piece are the leaves of a
segment tree, each with the rank of the pair that it forms with its right neighbour; the root holds the
lowest rank and, among equal ones, the leftmost place. A merge changes three leaves, and each change climbs
to the root, so that a piece of n symbols costs O(n log n) however long it is. Pieces met lately are kept.

Defined results: null and empty texts give no ids. The string of a special token in a text is that token,
as the library has it. Every row is encoded by itself: repeated rows, other columns and empty tables need
no rule.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed: the pattern that cuts texts for byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62
_PLACE = 1 << 32
_CACHED_PIECES = 600_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    named = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [named[b] for b in range(256)]


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges: again and again the leftmost pair of lowest rank, until no pair has a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    get = pairs.get
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found:
            tree[width + i] = found[0] * _PLACE + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def put(place: int, value: int) -> None:
        k = width + place
        tree[k] = value
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            low = a if a < b else b
            k >>= 1
            if tree[k] == low:
                return
            tree[k] = low

    def rank(left: int, right: int) -> int:
        found = get((symbols[left], symbols[right]))
        return found[0] * _PLACE + left if found else _NONE

    while tree[1] < _NONE:
        i = tree[1] % _PLACE
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        end = after[i] = after[j]
        if j < width:
            put(j, _NONE)
        if end >= 0:
            before[end] = i
            put(i, rank(i, end))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], rank(before[i], i))
    return [s for s in symbols if s >= 0]


class _Pieces(dict):
    """The ids of a piece of text, as bytes of 32 bits each, kept for pieces met lately.

    When it is full its pieces become the older ones; of these only what is met again comes back.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.pop(piece, None)
        if value is None:
            codec = self.codec
            ids = merge([codec.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")], codec.pairs)
            value = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= _CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


class Codec:
    """Encode and decode with the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        byte_of = {c: b for b, c in enumerate(chars)}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in specials}
        self.tokens |= {i: token.encode() for token, i in specials.items()}
        self.specials = {token: np.array([i], "<u4").tobytes() for token, i in specials.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.find = regex.compile(PATTERN).findall
        self.pieces = _Pieces(self)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.specials):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        parts = self.cut.split(text)
        return b"".join(self.specials[p] if p in self.specials else b"".join(map(self.pieces.__getitem__, self.find(p))) for p in parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also the ids (bytes) and the decoded text."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = known.encode(text)
                back = known.decode(ids)
                values = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
                for column, value in zip(out, (*values, *((ids, back) if keep else ())), strict=False):
                    column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                arrays += [pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return rows.mapInArrow(apply, schema + (", ids binary, decoded string" if keep else ""))


__all__ = ["Codec", "codec", "encode", "merge"]
