"""Byte-level BPE with the vocabulary of a public tokenizer.

A text is split by the tokenizer's pattern; the merges of a piece are driven by a segment tree over
the ranks of its adjacent pairs.  The root holds the leftmost pair of lowest rank; a merge changes at
most three leaves, each updated in logarithmic time, so that a piece of n bytes (a run of thousands of
letters without a space, say) takes n log n steps and not n squared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.session import public_path, spread

# Fixed value: the pattern that comes with the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30
#: Pieces up to this many characters are remembered; at most CACHE of them a worker.
SHORT, CACHE = 48, 400_000


class BytePairs:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        ranks = self.ranks
        n = len(data)
        if data in ranks:
            return [ranks[data]]
        size = 1 << max(1, (n - 1).bit_length())
        # leaves hold rank << 24-or-more | position, so the smallest is the leftmost of the lowest rank
        shift = max(1, n.bit_length())
        none = NONE << shift
        tree = [none] * (2 * size)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := ranks.get(data[i : i + 2])) is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] < none:
            i = tree[1] & ((1 << shift) - 1)
            j = after[i]
            merged = parts[i] + parts[j]
            parts[i], parts[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            put(j, none)
            r = ranks.get(merged + parts[k]) if k < n else None
            put(i, none if r is None else r << shift | i)
            if (h := before[i]) >= 0:
                r = ranks.get(parts[h] + merged)
                put(h, none if r is None else r << shift | h)
        return [ranks[p] for p in parts if p is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for null and empty."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                ids = tuple(self.piece(p.encode("utf-8", "replace")))
                if len(p) <= SHORT and len(known) < CACHE:
                    known[p] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def encode_corpus(documents: DataFrame, *, vocabulary: str = "byte_bpe_50k.tiktoken", keep: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``) of every document by a public rank file, without special tokens.

    Null and empty texts get an empty list (0 tokens); blank, very long and odd texts are encoded in
    full; rows that repeat stay; other columns are ignored.  A map over the scan; no shuffle where its files are many.
    """
    path = public_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            if ids:
                lists = [coder.encode(t) for t in texts]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array([coder.count(t) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    slim = documents.select(F.col(keep).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(slim).mapInArrow(run, "doc_id long, ids array<int>" if ids else "doc_id long, n_tokens long")


def p6_ids(documents: DataFrame) -> DataFrame:
    return encode_corpus(documents)
