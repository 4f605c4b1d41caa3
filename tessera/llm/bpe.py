"""Byte-level BPE encoding and decoding with a given vocabulary file.

A pre-token's bytes start as one part each. A contiguous list holds the parts, a second one the
merge rank of every adjacent pair; the lowest rank (leftmost on ties) is found by scanning, its
right boundary deleted, and only the two neighbouring ranks refreshed. Pre-tokens of more than
SHORT parts take the same merges from a heap, so a text without spaces costs n log n.

Equal chunks of text repeat, so a worker keeps the ids of chunks as packed bytes in two
generations of CACHE_CHUNKS: a full one becomes the old one, from which chunks in use return.
This bounds memory and never changes results.

Defined cases: null is the empty text (no ids). The vocabulary's added tokens are matched in the
text first. Any other text, whatever its length, decodes to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

SHORT = 256
CACHE_CHUNKS = 120_000
NO_RANK = 1 << 60
#: Unicode white space, as the pre-tokenizer's \s has it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000, ord("-"), 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: the split pattern of byte-level BPE.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Cuts between chunks fall only where PIECES cuts too.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_short(parts: list, ranks: dict, made: list) -> list:
    """Merge parts (token ids below 2**20) in place: scan for the least rank, delete a boundary, refresh two ranks."""
    get = ranks.get
    adjacent = [get(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while adjacent:
        least = min(adjacent)
        if least == NO_RANK:
            break
        i = adjacent.index(least)
        parts[i] = made[least]
        del parts[i + 1], adjacent[i]
        if i:
            adjacent[i - 1] = get(parts[i - 1] << 20 | parts[i], NO_RANK)
        if i < len(adjacent):
            adjacent[i] = get(parts[i] << 20 | parts[i + 1], NO_RANK)
    return parts


def merge_long(parts: list, ranks: dict, made: list) -> list:
    """The same merges for long pre-tokens: a heap of (rank, position) over a linked list."""
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] << 20 | parts[i + 1], NO_RANK)) < NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = made[r], None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (k := ranks.get(parts[x] << 20 | parts[y], NO_RANK)) < NO_RANK:
                heapq.heappush(heap, (k, x, parts[x], parts[y]))
    return [p for p in parts if p is not None]


class Codec(dict):
    """Chunk of text to its ids as little-endian uint32 bytes; missing chunks are encoded."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab, byte_of = spec["model"]["vocab"], byte_symbols()
        self.of_byte = [0] * 256
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PIECES)
        self.old: dict = {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.old.get(chunk) or self.merged(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    def merged(self, chunk: str) -> bytes:
        ids: list = []
        for piece in self.pieces.findall(chunk):
            parts = [self.of_byte[b] for b in piece.encode()]
            ids += (merge_short if len(parts) <= SHORT else merge_long)(parts, self.ranks, self.made)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed."""
        if self.cuts is None or not any(t in text for t in self.added):
            return b"".join(map(self.__getitem__, CHUNKS.findall(text)))
        return b"".join(np.array([self.added[s]], "<u4").tobytes() if s in self.added else b"".join(map(self.__getitem__, CHUNKS.findall(s))) for s in self.cuts.split(text))

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path(name: str) -> str:
    """Where the tokenizer file called name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """(doc_id, text) to counts and digests of the ids and of the text decoded from them; keep adds both.

    vocabulary: the name of a tokenizer file, found on each worker.
    """

    def encode(batches):
        tool = codec(vocabulary_path(vocabulary))
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                packed = tool.encode(text or "")
                back = tool.decode(packed)
                row = [i, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]
                rows.append([*row, np.frombuffer(packed, "<u4").astype(np.int32), back] if keep else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * keep]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, DIGEST_SCHEMA + ", ids array<int>, decoded string" * keep)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k byte-level vocabulary and decoded again."""
    return encode_texts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", keep=False)


QUERIES = {"op5_bpe_codec": op5_bpe_codec}
