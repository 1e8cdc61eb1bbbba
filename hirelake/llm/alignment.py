"""Alignment of two tokenizers over the same bytes, by lockstep merging of their token boundaries.

Every text is encoded by a byte-level BPE (A, with a space before the text) and a piece BPE with byte fallback (B, which adds that space itself). A
token of A and one of B are linked where their byte ranges overlap; where both end at one byte they cut the text into groups.

1. All documents of a batch are merged at the same time: one state vector holds a pointer into A's and one into B's tokens for each lane. A step emits
   the link of every lane's two tokens, emits a cut where they end together, and moves on whichever ends first, or both. Lanes that are through are
   compacted away. A lane is a document, or a part of about LANE tokens of a long one between two common ends, so one long text does not
   keep a batch in single steps.
2. A document keeps its different id pairs with their numbers, in a written table. They are counted by pair, combined before the shuffle: how many
   documents hold it. The most of each A id is one row for each vocabulary entry.
3. The counts go back to the documents by broadcast joins of bounded slices of the pair table, so no link is ever shuffled: one slice where the pairs are
   few, else as many as keep each within SLICE rows. Each slice is one more pass over the narrow table, never over texts, and the number of
   pairs is bounded by the product of the vocabularies, whatever the corpus.

Both tokenizers work on stretches that start with a space after a character that is none: A's pattern puts a space before a word only in front of its own
token, and no piece of B has a space behind another character (checked when the model is read), so the tokens of a text are those of its stretches.
A task remembers the tokens of the stretches that it has seen.

Defined cases: a text that is null or empty, or whose joined A or B bytes are not a space and the text (as for texts that hold U+2581), has no tokens:
all numbers are 0 and groups is the empty string; special tokens in a text are ordinary text; equal rows and rows that share an id are documents
of their own; extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, scratch, shared_dir, text_or_empty

#: A's tokens in a lane, stretches that a task remembers, characters up to which one is remembered, and pairs in a broadcast.
LANE, STRETCHES, LONGEST, SLICE = 256, 600_000, 64, 2_000_000
SPACE = "▁"
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens(dict):
    """stretch -> (A's ids, B's ids) as 32-bit bytes, and each vocabulary's bytes by id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = _byte_of()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space behind another character need whole texts")
        a = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = pa.array([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in a], pa.binary())
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)], pa.binary())

    def encode(self, stretches: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each stretch with a space before it; stretches that are not remembered yet are encoded together."""
        out = list(map(self.get, stretches))
        new = [k for k, x in enumerate(out) if x is None]
        for lo in range(0, len(new), 1000):
            part = [stretches[k] for k in new[lo : lo + 1000]]
            a = self.a.encode_batch_fast([" " + s for s in part], add_special_tokens=False)
            b = self.b.encode(part, num_threads=1)
            for k, s, x, y in zip(new[lo : lo + 1000], part, a, b):
                out[k] = array("i", x.ids).tobytes(), array("i", y).tobytes()
                if len(s) <= LONGEST and len(self) < STRETCHES:  # the frequent ones come early, so those that come first are kept
                    self[s] = out[k]
        return out

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: the ids of all texts, one after the other, and their number in each."""
        split = [_SPLIT.split(t) if t else [] for t in texts]
        each = pa.array([s for x in split for s in x], pa.string()).dictionary_encode()
        codes = each.indices
        known = self.encode(each.dictionary.to_pylist())
        edges = np.concatenate([[0], np.cumsum([len(x) for x in split])])
        out = []
        for k in (0, 1):
            sizes = np.array([len(x[k]) >> 2 for x in known], np.int64)
            values = np.frombuffer(b"".join([x[k] for x in known]), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            total = np.concatenate([[0], np.cumsum(sizes[codes.to_numpy()])])
            out.append((lists.take(codes).flatten().to_numpy(), np.diff(total[edges])))
        return out


@functools.cache
def tokens(a_path: str, b_path: str) -> Tokens:
    """Once for each Python worker."""
    return Tokens(a_path, b_path)


def _text_bytes(ids: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The end of each token among the joined bytes of all, and these bytes."""
    taken = vocabulary.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1, taken.offset * 4)
    return offsets[1:].astype(np.int64), memoryview(taken.buffers()[2] or b"")


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """(A from, A to, B from, B to) of the lanes. a_from, b_from: each document's first token, and behind the last the number of all; ends rise over all documents."""
    starts = [np.stack([a_from[:-1], b_from[:-1]], 1)]
    n = np.diff(a_from)
    inner = np.maximum(0, (n - 1) // lane)  # so many cuts are tried in each document
    at = np.repeat(a_from[:-1], inner) + lane * (np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1)
    last = np.repeat(a_from[1:], inner)
    while len(at):  # the first token that starts where one of B does
        b = np.searchsorted(b_end, a_end[at - 1])
        met = b_end[b] == a_end[at - 1]
        starts.append(np.stack([at[met], b[met] + 1], 1))
        at, last = at[~met] + 1, last[~met]
        at, last = at[at < last], last[at < last]
    both = np.unique(np.concatenate(starts), axis=0)
    both = both[np.concatenate([both[1:, 0], [len(a_end)]]) > both[:, 0]]  # documents without tokens
    return both[:, 0], np.append(both[1:, 0], len(a_end)), both[:, 1], np.append(both[1:, 1], len(b_end))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as (A's index, B's index), and whether each link's tokens end together."""
    a, b, stop = a_from.astype(np.int32), b_from.astype(np.int32), a_to.astype(np.int32)
    a_end, b_end = a_end.astype(np.int32), b_end.astype(np.int32)
    left, right, cuts = [], [], []
    while len(a):
        x, y = a_end[a], b_end[b]
        left.append(a)
        right.append(b)
        cuts.append(x == y)
        a, b = a + (x <= y), b + (y <= x)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    if not left:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)
    return np.concatenate(left), np.concatenate(right), np.concatenate(cuts)


@functools.cache
def _decimals(most: int) -> pa.Array:
    """Decimal ids, each followed by ',', '|' and ';'."""
    return pa.array([f"{k}{c}" for k in range(most) for c in ",|;"], pa.string())


def _written(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, n: int, most: int) -> list[str]:
    """The groups of each of n documents as text: A's ids | B's ids ; and so on. a_last, b_last: whether a token is the last of its group."""
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
    at_a = np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(sizes_a)[group_b]
    codes = np.empty(len(a) + len(b), np.int64)
    codes[at_a] = a.astype(np.int64) * 3 + a_last
    codes[at_b] = b.astype(np.int64) * 3 + 2 * b_last
    text = _decimals(most).take(pa.array(codes))
    ends = np.frombuffer(text.buffers()[1], np.int32, len(codes) + 1, text.offset * 4)
    whole = memoryview(text.buffers()[2] or b"")
    edge = np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n))
    edge = np.concatenate([[0], edge])
    return [bytes(whole[ends[x] : max(ends[x], ends[y] - 1)]).decode() for x, y in zip(edge[:-1], edge[1:])]


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, texts: bool) -> Iterator[pa.RecordBatch]:
    known = tokens(a_path, b_path)
    wide = len(known.b_bytes)
    most = max(len(known.a_bytes), wide)
    for batch in batches:
        n = batch.num_rows
        strings = batch.column(1).to_pylist()
        (a_ids, a_count), (b_ids, b_count) = known.of(strings)
        count = np.stack([a_count, b_count], 1)
        (a_end, a_raw), (b_end, b_raw) = _text_bytes(a_ids, known.a_bytes), _text_bytes(b_ids, known.b_bytes)
        edges = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(count, axis=0)])
        bytes_at = [np.concatenate([[0], e])[edges[:, k]] for k, e in ((0, a_end), (1, b_end))]
        good = np.zeros(n, bool)
        for k, t in enumerate(strings):
            if t:
                raw = b" " + t.encode()
                good[k] = all(bytes(m[x[k] : x[k + 1]]) == raw for m, x in zip((a_raw, b_raw), bytes_at))
        if not good.all():  # documents without tokens
            keep_a, keep_b = np.repeat(good, count[:, 0]), np.repeat(good, count[:, 1])
            gap = [np.repeat(np.cumsum(np.where(good, 0, np.diff(x))), count[:, k]) for k, x in enumerate(bytes_at)]
            a_ids, b_ids, a_end, b_end = a_ids[keep_a], b_ids[keep_b], (a_end - gap[0])[keep_a], (b_end - gap[1])[keep_b]
            count[~good] = 0
            edges = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(count, axis=0)])
        doc_a, doc_b = (np.repeat(np.arange(n), count[:, k]) for k in (0, 1))
        a_from, a_to, b_from, _ = lanes(a_end, b_end, edges[:, 0], edges[:, 1])
        left, right, together = lockstep(a_end, b_end, a_from, a_to, b_from)
        a_last, b_last = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        a_last[left[together]] = True
        b_last[right[together]] = True
        pair = (doc_a[left].astype(np.uint64) << np.uint64(44)) | (a_ids[left].astype(np.uint64) * np.uint64(wide) + b_ids[right].astype(np.uint64))
        pair.sort()
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
        times = np.diff(np.concatenate([new, [len(pair)]])).astype(np.int32)
        pair = pair[new]
        of = np.searchsorted(pair >> np.uint64(44), np.arange(n + 1, dtype=np.uint64)).astype(np.int32)
        values = (pair & np.uint64((1 << 44) - 1)).astype(np.int64)
        written = _written(a_ids, b_ids, a_last, b_last, doc_a, doc_b, n, most) if len(a_ids) else [""] * n
        if not texts:
            written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
        per = lambda doc, on=None: pa.array(np.bincount(doc if on is None else doc[on], minlength=n).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count[:, 0]), pa.array(count[:, 1]), per(doc_a, a_last), per(doc_a[left]), pa.array(written, pa.string()),
             pa.ListArray.from_arrays(pa.array(of), pa.array(values)), pa.ListArray.from_arrays(pa.array(of), pa.array(times))],
            ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
        )


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups (as text, 'a1,a2|b1;a3|b2,b3', or unless ``texts`` its SHA-256), pairs and times (the different linked id
    pairs, A's id * B's vocabulary + B's id, and how often each); one row for each row of docs."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_or_empty(f"`{text}`").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"
    return rows.mapInArrow(partial(_aligned, a_path=a_path, b_path=b_path, texts=texts), schema).withColumnRenamed("id", id)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, docs, best): how many documents hold the pair, and whether no pair of its A id is in more."""
    counted = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    a = F.floor(F.col("pair") / b_size)
    most = cut(counted.groupBy(a.alias("a")).agg(F.max("docs").alias("most")))  # a row for each id of A's vocabulary
    return counted.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", slice_rows: int = SLICE) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its A id exceeds), count_sum (over links, the documents of the pair),
    groups_sha256 (or the empty string); one row for each row of docs."""
    spark = docs.sparkSession
    b_size = len(tokens(a_path, b_path).b_bytes)
    path = scratch(spark, "aligned")
    align(docs, a_path, b_path, id, text, texts=False).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    pairs = cut(pair_counts(aligned, b_size))
    slices = -(-pairs.count() // slice_rows) or 1
    slices += slices // 10 if slices > 1 else 0  # slices by hash are not of one size
    number = F.pmod(F.xxhash64("pair"), F.lit(slices))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    parts = []
    for k in range(slices):  # each result is written before the next slice is broadcast
        part = links.where(number == k).join(F.broadcast(pairs.where(number == k)), "pair").groupBy("row").agg(*sums)
        parts.append(cut(part) if slices > 1 else part)
    total = reduce(DataFrame.unionByName, parts)
    if slices > 1:
        total = total.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    heads = aligned.select("row", id, "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias("groups_sha256"))
    done = cut(heads.join(total, "row", "left").select(id, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"))
    remove(spark, path)
    return done
