"""Byte-level BPE by a segment tree.

Method: the leaves of a segment tree over the byte positions of a pre-token hold the rank of the pair that starts
there; every node holds the leftmost minimum of its range. The root is the next merge; a merge updates the pairs of
the merged part and of its live left neighbour, each by a walk to the root. A pre-token of n bytes takes
O(n log n), however long it is, so texts with hardly any place to cut stay cheap.

Texts are cut before every white-space run into chunks; the pre-tokenizer's pattern never matches across such a cut,
so chunks are encoded alone and kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenizer pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
NO_PAIR = 1 << 30
CACHE = 400_000

_SPLIT = regex.compile(PATTERN)
_CHUNK = regex.compile(r"\s*\S+|\s+$")


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one line per token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of the bytes of one pre-token."""
    n = len(data)
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    get = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    # leaf i: the rank of the pair whose left part starts at byte i
    tree = [NO_PAIR] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(data[i : i + 2], NO_PAIR)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))  # of the part that starts here, where it ends; the next live part starts there
    before = list(range(-1, n - 1))  # where the live part before it starts
    while tree[1] != NO_PAIR:
        low, k = tree[1], 1
        while k < size:  # down to the leftmost leaf with the minimum
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        j = end[i]
        e = end[j]
        end[i] = e
        if e < n:
            before[e] = i
        h = before[i]
        updates = [(i, get(data[i : end[e]], NO_PAIR) if e < n else NO_PAIR)]
        if j < size:
            updates.append((j, NO_PAIR))
        if h >= 0:
            updates.append((h, get(data[h:e], NO_PAIR)))
        for at, rank in updates:
            k = size + at
            if tree[k] == rank:
                continue
            tree[k] = rank
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; keeps the ids of chunks and pre-tokens it has seen, up to a bounded number."""

    def __init__(self, path: str, limit: int = CACHE):
        self.ranks = load_ranks(path)
        self.limit = limit
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.sizes: np.ndarray | None = None

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = merge_bytes(piece.encode("utf-8", "surrogatepass"), self.ranks)
            if len(piece) < 64:
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk as packed 32-bit integers."""
        got = self.chunks.get(chunk)
        if got is None:
            ids: list[int] = []
            for piece in _SPLIT.findall(chunk):
                ids += self._piece(piece)
            got = np.array(ids, np.int32).tobytes()
            if len(chunk) < 64:
                if len(self.chunks) >= self.limit:
                    self.chunks.clear()
                self.chunks[chunk] = got
        return got

    @staticmethod
    def split(text: str) -> list[str]:
        """The chunks of a text: each a white-space run and what follows it."""
        if "  " in text or text.endswith(" "):
            return _CHUNK.findall(text)
        head, *rest = text.split(" ")
        return [head, *[f" {x}" for x in rest]] if head else [f" {x}" for x in rest]

    def packed(self, text: str) -> bytes:
        if not text:
            return b""
        get, chunk = self.chunks.get, self.chunk
        if "  " in text or text[-1] == " ":
            return b"".join([get(x) or chunk(x) for x in _CHUNK.findall(text)])
        first, *rest = text.split(" ")
        parts = [chunk(first)] if first else []
        parts += [get(y := " " + x) or chunk(y) for x in rest]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def sizes_of(self, packed: bytes) -> list[int]:
        """The number of bytes of every token of packed ids."""
        if self.sizes is None:
            self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int32)
            for token, i in self.ranks.items():
                self.sizes[i] = len(token)
        return self.sizes[np.frombuffer(packed, np.int32)].tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_texts(df: DataFrame, key: str, text: str, path: str, ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens. No shuffle; one Arrow pass.

    Defined results: a null text and an empty text both give an empty list; blanks are tokens like any other.
    Keys may repeat and be null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            packed = [e.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, {ids} array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str, out: str = "n_tokens") -> DataFrame:
    """(key, out): the number of tokens of every text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n = pa.array([e.count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {kind}, {out} bigint")
