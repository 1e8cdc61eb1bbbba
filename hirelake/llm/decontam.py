"""Benchmark decontamination by greedy string tiling.

The benchmark's runs of ``least`` tokens (seeds) form a sorted hash index. Every document looks up its own runs; the item tokens under shared seeds
bound the coverage from above, and items whose bound reaches ``threshold`` are the document's candidates. For each candidate the item is tiled with
the document: the longest matches of tokens unmarked on both sides are found by running Karp-Rabin hashes over windows of a search length, marked
without overlap, longest first, and the search length sinks until it is ``least``. The share of the item's tokens under tiles is its
coverage, whatever the order of the tiles, so reordered passages are found too. A document is contaminated by an item from a coverage of
``threshold`` on. Items of fewer than ``shortest`` tokens are no evidence and left out.

The benchmark is taken in blocks of at most ``block`` tokens, each broadcast to a pass over the documents, so what a task holds is bounded.

Tokens are runs of word characters, lower-cased. Defined cases: null or empty texts and documents shorter than a seed match nothing; with ``shortest``
below ``least``, an item shorter than ``least`` is looked up as a whole; ids are integers; null ids are ids like any other; each row of a repeated id is judged by itself; repeated items are judged
each; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small, text_or_empty, window_hashes

LEAST, THRESHOLD, BLOCK, SHORTEST = 5, 0.6, 2_000_000, 5
_token = re.compile(r"\w+")


def tokens(text: str) -> np.ndarray:
    words = _token.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles of a greedy tiling; of equally long matches the first in the item, then in the doc, goes first."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        heap: list[tuple[int, int, int]] = []
        if size <= min(len(item), len(doc)):
            open_i = np.convolve(free_i, np.ones(size, int), "valid") == size
            open_d = np.convolve(free_d, np.ones(size, int), "valid") == size
            by_hash: dict[int, list[int]] = {}
            for k, h in zip(np.flatnonzero(open_i).tolist(), window_hashes(item, size)[open_i].tolist()):
                by_hash.setdefault(h, []).append(k)
            h = window_hashes(doc, size)
            for d in np.flatnonzero(open_d & np.isin(h, np.fromiter(by_hash, np.uint64, len(by_hash)))).tolist():
                for i in by_hash[int(h[d])]:
                    if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                        continue  # part of the match that begins before
                    n = size
                    while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                        n += 1
                    heap.append((-n, i, d))
        heapq.heapify(heap)
        if heap and -heap[0][0] > 2 * size:  # look for matches of that length first
            size = -heap[0][0]
            continue
        while heap:
            n, i, d = heapq.heappop(heap)
            free = free_i[i : i - n] & free_d[d : d - n]
            if free.all():
                free_i[i : i - n] = free_d[d : d - n] = False
                found.append((i, d, -n))
            else:  # what longer tiles have left of it
                edges = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]]))).tolist()
                for x, y in zip(edges[::2], edges[1::2]):
                    if y - x >= size:
                        heapq.heappush(heap, (x - y, i + x, d + x))
        if size == least:
            return found
        size = max(least, size // 2)


class Index:
    """The seeds of a bounded block of items."""

    def __init__(self, items: list[tuple[object, str]], least: int, threshold: float, shortest: int):
        own = [(i, w) for i, t in items if len(w := tokens(t)) >= max(1, shortest)]
        self.threshold = threshold
        self.ids = [i for i, _ in own]
        self.words = [w for _, w in own]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.by_size = {}
        for n in sorted({min(least, len(w)) for w in self.words}):
            rows = [(window_hashes(w, n), k) for k, w in enumerate(self.words) if (len(w) == n if n < least else len(w) >= n)]
            h = np.concatenate([x for x, _ in rows])
            owner, at = np.concatenate([np.full(len(x), k) for x, k in rows]), np.concatenate([np.arange(len(x)) for x, _ in rows])
            order = np.argsort(h, kind="stable")
            self.by_size[n] = h[order], owner[order], at[order]

    def candidates(self, doc: np.ndarray) -> list[int]:
        """The items of which so many tokens lie under seeds shared with the document that tiles may cover enough."""
        out: list[int] = []
        for n, (h, owner, at) in self.by_size.items():
            mine = np.unique(window_hashes(doc, n))
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            some = np.flatnonzero(hi > lo)
            if len(some):
                rows = np.concatenate([np.arange(x, y) for x, y in zip(lo[some].tolist(), hi[some].tolist())])
                order = np.lexsort((at[rows], owner[rows]))
                o, p = owner[rows][order], at[rows][order]
                step = np.full(len(o), n)
                same = o[1:] == o[:-1]
                step[:-1][same] = np.minimum(n, (p[1:] - p[:-1])[same])  # tokens up to the next seed of the item
                which, first = np.unique(o, return_index=True)
                covered = np.add.reduceat(step, first)
                out += which[covered >= self.threshold * self.sizes[which]].tolist()
        return sorted(out)


def blocks(bench: DataFrame, block: int, item: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of at most ``block`` tokens or one item, the item's length at most being its characters."""
    rows = bench.select(F.col(item).cast("long").alias("item"), text_or_empty(text).alias("t"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("item", "t"), F.lit(4096)))
    size = rows.groupBy("bucket").agg(F.sum(F.length("t") + 1).alias("n"))  # at most 4096 rows
    number = F.floor((F.sum("n").over(Window.orderBy("bucket")) - 1) / block)
    parts = cut(rows.join(F.broadcast(size.select("bucket", number.alias("part"))), "bucket").select("item", "t", "part"))
    return [parts.where(F.col("part") == p[0]) for p in parts.select("part").distinct().orderBy("part").collect()]  # as many as the benchmark has blocks


def contamination(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block: int = BLOCK, shortest: int = SHORTEST) -> DataFrame:
    """id, item, n_tiles, covered, n_tokens, coverage: a row for each document and item that contaminates it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("t"))
    schema = "id long, item long, n_tiles long, covered long, n_tokens long, coverage double"
    out = None
    for part in blocks(bench, block, item, item_text):
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in part.select("item", "t").collect()], least, threshold, shortest))  # bounded by block

        def judge(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            for b in batches:
                found: list[list] = [[], [], [], [], [], []]
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    doc = tokens(t.as_py())
                    for k in x.candidates(doc):
                        words = x.words[k]
                        own = tiles(words, doc, min(least, len(words)))
                        covered = sum(n for _, _, n in own)
                        if covered >= threshold * len(words):
                            for column, value in zip(found, (i, x.ids[k], len(own), covered, len(words), covered / len(words))):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in found[:5]], pa.array(found[5], pa.float64())], ["id", "item", "n_tiles", "covered", "n_tokens", "coverage"])

        hits = rows.mapInArrow(judge, schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id, "item": item})


def decontaminate(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of docs that no item contaminates, columns unchanged."""
    name = fresh(docs, "_gone")
    gone = cut(contamination(docs, bench, id, text, **options).select(F.col(id).alias(name)).distinct())
    return docs.join(small(gone), F.col(id).eqNullSafe(F.col(name)), "left_anti")
