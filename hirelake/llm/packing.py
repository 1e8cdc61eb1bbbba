"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's tokens are cut into pieces of ``size`` tokens, which are windows by themselves; what is left is cut every ``piece`` tokens, since
differencing needs several pieces in a window to level it. These pieces, and no whole windows, are dealt by a hash of id, place and row number into
groups of bounded size, so neither a giant document nor repeated rows fill one group. Each group is divided among m windows by differencing: every piece
starts as a partition of m bins with one of them filled; the two partitions with the largest spread between their bins are merged again and again, the fullest bin of one with the
emptiest of the other, until one partition is left. Its bins are nearly equal. m starts at the fewest windows that could hold the group and rises
whenever a bin exceeds ``size``. Groups keep memory and time bounded, so a longer table only has more of them.

Tokens come from a public tokenizer file, whose path is a parameter. Words between ASCII blanks are tokenized apart and remembered, which gives
the ids of the whole text as the tokenizer normalizes and splits by character classes that no match spans. They are remembered without regard to
case, but for words that may hold an added token, which the tokenizer looks for before it normalizes.

Defined cases: ids are integers; a null or empty text is the end token alone; each row is a document of its own, also when ids repeat or are null; extra
columns are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SIZE, PIECE, END = 2048, 512, 1
#: Pieces in a group, on average, and words that a task remembers.
GROUP, WORDS = 768, 600_000


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """word (bytes, A-Z lower-cased, no ASCII blanks) -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.whole.get_added_tokens_decoder().values()]

    def of(self, text: str) -> bytes:
        raw = text.encode()
        low = raw.lower()
        if not any(t in low for t in self.added):
            return b"".join(map(self.__getitem__, low.split()))
        return b"".join([self.cased(w) if any(t in w.lower() for t in self.added) else self[w.lower()] for w in raw.split()])

    def cased(self, w: bytes) -> bytes:
        return _packed(self.whole.encode(w.decode(), add_special_tokens=False).ids)

    def __missing__(self, w: bytes) -> bytes:
        if w[-1] in b".," and w[:-1].isalpha():  # an ASCII word and its full stop are never one token
            ids = self[w[:-1]] + self[w[-1:]]
        elif w.isalpha():  # ASCII letters only: nothing to normalize, one piece
            ids = _packed([t.id for t in self.whole.model.tokenize(w.decode())])
        else:
            ids = self.cased(w)
        if len(self) >= WORDS:
            self.clear()
        self[w] = ids
        return ids


_words: dict[str, WordIds] = {}


def token_bytes(text: str, path: str) -> bytes:
    if path not in _words:  # once for each Python worker
        _words[path] = WordIds(path)
    return _words[path].of(text)


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, piece: int = PIECE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's tokens cut every ``size``, the rest every ``piece``."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_bytes(t.as_py(), path) + tail
                n = len(ids) // 4
                full = n - n % size
                cuts = [*range(0, full, size), *range(full, n, piece), n]
                for at, upto in zip(cuts, cuts[1:]):
                    part = ids[4 * at : 4 * upto]
                    for column, value in zip(out, (i, at, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(cut_up, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """m lists of positions of ``sizes`` with nearly equal sums. Empty bins of a partition are not stored."""
    if not sizes:
        return [[] for _ in range(m)]
    order = itertools.count()
    heap = [(-s, next(order), [(s, k)]) for k, s in enumerate(sizes)]  # bins ascending; a bin: (sum, tree of positions)
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = max(0, len(a) + len(b) - m)  # so many bins of either meet a filled bin of the other
        merged = a[both:] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:both], reversed(b[:both]))] + b[both:]
        merged.sort(key=lambda x: x[0])
        emptiest = merged[0][0] if len(merged) == m else 0
        heapq.heappush(heap, (emptiest - merged[-1][0], next(order), merged))
    bins = []
    for _, tree in heap[0][2]:
        found, left = [], [tree]
        while left:
            x = left.pop()
            if isinstance(x, tuple):
                left += x
            else:
                found.append(x)
        bins.append(sorted(found))
    return [[] for _ in range(m - len(bins))] + bins


def windows(sizes: list[int], size: int = SIZE) -> list[list[int]]:
    """As few windows of at most ``size`` as differencing finds."""
    m = max(1, -(-sum(sizes) // size))
    while True:
        bins = difference(sizes, m)
        if max(sum(sizes[k] for k in b) for b in bins) <= size:
            return [b for b in bins if b]
        m += 1


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece. Whole windows have odd sequence ids, levelled ones even."""
    cut_up = cut(pieces(docs, path, id, text, size, end, piece).withColumn("n", F.monotonically_increasing_id()))
    whole = F.col("length") == size
    full = cut_up.where(whole).withColumn("sequence_id", 2 * F.col("n") + 1).withColumn("offset", F.lit(0).cast("long")).drop("n")
    groups = max(1, -(-cut_up.where(~whole).count() // group))
    dealt = cut_up.where(~whole).withColumn("g", F.pmod(F.xxhash64("id", "start", "n"), F.lit(groups))).drop("n")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        length = pdf.length.to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for n, b in enumerate(windows(length.tolist(), size)):
            sequence[b] = 2 * ((int(pdf["g"].iloc[0]) << 31) + n)
            offset[b] = np.cumsum([0, *length[b][:-1]])
        return pdf.assign(sequence_id=sequence, offset=offset).drop(columns="g")

    out = dealt.groupBy("g").applyInPandas(fill, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.unionByName(full).withColumnRenamed("id", id)
