"""Periodic runs of words, by the branching-tandem test on enhanced suffix arrays.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least max(least, times * q) that
no neighbouring word extends keeping the period. Within a batch of documents:

1. In a run every word is covered by a window of a few words (five, for the default lengths) that occurs again in the document. The stretches of
   such words are taken out; all else has no run, and needs no suffix array.
2. The stretches, with a different end mark behind each, get one suffix array by prefix doubling, which refines only groups that are still equal. The ranks
   after each doubling are kept: two of them tell whether two parts of any length are equal, and give the common-prefix lengths of neighbours.
3. A stack scan over these lengths gives the intervals. For each with depth d, the suffixes i of all children but the largest are tried: a square
   of period d starts at i (or i - d) where the inverse suffix array puts i + d (or i - d) into the same interval but another child. No square is
   missed, none is extended by the word behind it, and each run has exactly one of each of its periods: its last.
4. Each square is rotated to the left, by doubling steps, as far as words q apart stay equal, which gives the whole run; runs over the same words are
   merged into the one with the smallest period.

Defined cases: a null text has no words; equal rows and rows that share an id are documents of their own; a document is never cut, however long
(memory: a few hundred bytes for each word of its repeated stretches); extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shared_dir, text_or_empty, window_hashes

LEAST, TIMES = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of short documents that share a suffix array; a longer document has its own.
TOGETHER = 1 << 18


def window(least: int, times: int) -> int:
    """The widest window such that each word of any run is covered by one that occurs again in the run: a window, or its image q words before or after,
    must fit in, so a run of length L needs L >= 2q + window - 1."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 2)))


def _covered(codes: np.ndarray, doc: np.ndarray, wide: int) -> np.ndarray:
    """Whether each word is in a window that occurs again in its document (or seems to, by a hash; that only adds work)."""
    inside = np.zeros(len(codes) + 1, np.int32)
    if len(codes) >= wide:
        key = mix64(window_hashes(mix64(codes.astype(np.uint64)), wide) + mix64(doc[: len(codes) - wide + 1].astype(np.uint64) + np.uint64(1)))
        at = np.flatnonzero(doc[: len(doc) - wide + 1] == doc[wide - 1 :])
        order = np.argsort(key[at])
        k = key[at][order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        twice = at[order[same[1:] | same[:-1]]]
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + wide, -1)
    return np.cumsum(inside[:-1]) > 0


def prefix_ranks(t: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to where all differ: the first place that suffixes with an equal beginning take. The last symbol occurs once."""
    m = len(t)
    order = np.argsort(t, kind="stable")
    s = t[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(m, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    ranks, h = [rank], 1
    single = new & np.concatenate([new[1:], [True]])
    active = order[~single]
    while len(active):
        key = rank[active].astype(np.int64) * m + rank[active + h]  # what is still equal has no end mark among its first h symbols
        o = np.argsort(key)
        active, key = active[o], key[o]
        old = rank[active]
        at = np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.concatenate([[True], old[1:] != old[:-1]])
        rank = rank.copy()
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        ranks.append(rank)
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the array with the one before; 0 for the first."""
    x, y = sa[:-1].astype(np.int64), sa[1:].astype(np.int64)
    length = np.zeros(len(sa), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        length[1:] += (ranks[k][x + length[1:]] == ranks[k][y + length[1:]]).astype(np.int64) << k
    return length


def small_children(lcp: np.ndarray, deepest: int) -> np.ndarray:
    """Rows (depth, interval from, to, child from, to), ends inclusive: all children but the largest of every interval of depth 1 to ``deepest``."""
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, from, starts of all children but the first
    values = lcp.tolist()
    values.append(0)
    for j in range(1, len(values)):
        v, since = values[j], j - 1
        while v < stack[-1][0]:
            depth, since, starts = stack.pop()
            if depth <= deepest:
                edges = [since, *starts, j]
                sizes = [y - x for x, y in zip(edges, edges[1:])]
                largest = sizes.index(max(sizes))
                found += [(depth, since, j - 1, x, y - 1) for n, (x, y) in enumerate(zip(edges, edges[1:])) if n != largest]
        if v > stack[-1][0]:
            stack.append((v, since, [j]))
        elif v:
            stack[-1][2].append(j)
    return np.array(found, np.int64).reshape(-1, 5)


def last_squares(sa: np.ndarray, isa: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that the word behind does not extend."""
    starts, periods = [], []
    sizes = children[:, 4] - children[:, 3] + 1
    edges = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1, [len(sizes)]])  # about a million suffixes at once
    for lo, hi in zip(edges[:-1], edges[1:]):
        depth, since, upto, first, last = (np.repeat(x, sizes[lo:hi]) for x in children[lo:hi].T)
        begin = np.cumsum(sizes[lo:hi]) - sizes[lo:hi]
        i = sa[first + np.arange(len(first)) - np.repeat(begin, sizes[lo:hi])].astype(np.int64)
        for j, start in ((i + depth, i), (i - depth, i - depth)):
            fits = (j >= 0) & (j < len(sa))
            r = isa[np.where(fits, j, 0)]
            ok = fits & (r >= since) & (r <= upto) & ((r < first) | (r > last))
            starts.append(start[ok])
            periods.append(depth[ok])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], 1), axis=0) if starts else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def _runs_of(t: np.ndarray, deepest: int, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of the runs in t, which has a different mark at each stretch's end."""
    ranks = prefix_ranks(t)
    isa = ranks[-1]
    sa = np.empty(len(t), np.int32)
    sa[isa] = np.arange(len(t), dtype=np.int32)
    start, period = last_squares(sa, isa, small_children(common_prefixes(ranks, sa), deepest))
    end = start + 2 * period
    for k in range(len(ranks) - 1, -1, -1):  # rotate to the left
        back = start - (1 << k)
        ok = back >= 0
        ok[ok] = ranks[k][back[ok]] == ranks[k][back[ok] + period[ok]]
        start = np.where(ok, back, start)
    good = end - start >= np.maximum(least, times * period)
    rows = np.stack([start[good], end[good], period[good]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[smallest]


def find_runs(codes: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of the runs in documents whose words' codes lie one after the other; doc: the document of each word, ascending."""
    none = np.empty((0, 3), np.int64)
    on = _covered(codes, doc, window(least, times))
    at = np.flatnonzero(on)
    if not len(at):
        return none
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(at)]]))
    since, size = at[first[size >= least]], size[size >= least]
    out, lo = [none], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), TOGETHER, side="right")) + lo)
        s, n = since[lo:hi], size[lo:hi]
        begin = np.cumsum(n + 1) - n - 1  # of each stretch in t
        t = np.empty(int((n + 1).sum()), np.int64)
        where = np.arange(len(t)) - np.repeat(begin, n + 1)
        mark = where == np.repeat(n, n + 1)
        t[~mark] = codes[np.repeat(s, n) + where[~mark]]
        t[mark] = int(codes.max()) + 1 + np.arange(len(s))
        found = _runs_of(t, int(n.max()) // times, least, times)
        shift = (s - begin)[np.searchsorted(begin, found[:, 0], side="right") - 1]
        out.append(np.stack([found[:, 0] + shift, found[:, 1] + shift, found[:, 2]], 1))
        lo = hi
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batches(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for b in batches:
        words = [WORD.findall(t) for t in b.column(1).to_pylist()]
        count = np.array([len(w) for w in words], np.int64)
        codes = pa.array([x for w in words for x in w], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(words)), count)
        base = np.cumsum(count) - count
        rows = find_runs(codes, doc, least, times)
        of = doc[rows[:, 0]]
        gone = np.zeros(len(codes) + 1, np.int64)
        np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
        np.add.at(gone, rows[:, 1], -1)
        gone = np.cumsum(gone[:-1]) > 0
        changed = set(of.tolist())
        text = [" ".join(w if n not in changed else [x for x, g in zip(w, gone[base[n] : base[n] + len(w)].tolist()) if not g]) for n, w in enumerate(words)]
        inner = pa.StructArray.from_arrays([pa.array(rows[:, 0] - base[of]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(triple))
        edges = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), pa.ListArray.from_arrays(pa.array(edges), inner), pa.array(text, pa.string())], ["id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs (array of start, length, period in words, by start, then period), collapsed (the words joined by one space, without those
    that some run contains behind its first period); one row for each row of docs. times: at least 3."""
    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_or_empty(f"`{text}`").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(partial(_batches, least=least, times=times), f"id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return done.withColumnRenamed("id", id)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The longest run (ties: smallest start, then period) and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    b = F.col("best")
    return found.withColumn("best", best).select(
        id, F.size("runs").cast("long").alias("n_runs"), (-b["start"]).alias("start"), b["length"].alias("length"), (-b["period"]).alias("period"),
        F.expr("1000 * best.length div -best.period").cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the check: where h = crc32(decimal id) ends in 0, the words from a on repeat with period p (g = h // 10, a = g % n,
    p = 1 + (n - a) // (3 + g % 8)), joined by one space. A null id leaves its text alone."""
    h = F.crc32(F.col(f"`{id}`").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("_t"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(h / 10)
    plain = docs.select(F.col(f"`{id}`"), text_or_empty(f"`{text}`").alias("_t"))
    chosen = plain.withColumn("_w", F.when(F.coalesce(h % 10 == 0, F.lit(False)), words)).withColumn("_g", g)
    n = F.size("_w")
    chosen = chosen.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int"))).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return chosen.select(F.col(f"`{id}`"), F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("_t")).alias(text))
