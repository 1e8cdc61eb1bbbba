"""Removal of repeated byte substrings with common-prefix interval trees over enhanced suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or same document and smaller position).

A suffix array of a whole corpus is one unbounded sort, so windows of LENGTH bytes are first brought together by content. Every window has
an anchor, the least-hashed of its GRAM-byte substrings (leftmost if equal). The windows that follow each other with one anchor form a
stretch; equal windows have equal anchors at equal offsets, so they lie in stretches of one anchor hash.

1. Each text yields its stretches (anchor hash, content hash, id, start, length). The content hash only tells which stretches are the same, so that
   each different stretch goes on once, with its first place (its head) and whether it has later places; the later places wait as rows of their own.
   Batches do this before the shuffle, so a passage in a third of all texts is no hot key, and parts of the keys once more after it. An anchor with
   several contents in a batch needs no counting: one row of it goes to the count, and its stretches are dealt by content, so an anchor with a
   third of all contents is no hot key either.
2. An anchor whose single content has a single place has no repeats. The heads of all others are cut out of the texts.
3. Groups of anchors go to tasks of bounded size, each of which sorts the suffixes of its stretches (those whose first LENGTH bytes are not
   unique, and whole stretches with several places), takes the common-prefix lengths of neighbours, and scans them with a stack for the intervals
   of the common-prefix tree. An interval of at least LENGTH bytes whose occurrences differ in the byte to their left is a maximal repeat: all its
   occurrences but the first are removed. An interval with one left byte is part of a longer one and skipped. A leaf with several places is an
   interval too; the later places of its stretch lose what it says by a join on the stretch. All that is removed comes from intervals.
4. An anchor with more than HOT different stretches is split by the bytes around it. Windows that hold the anchor at one of a range of offsets have
   more bytes in common than the anchor; pieces of the stretches that hold these windows are grouped by those bytes and go to trees as above. Groups
   that are still too large are split by narrower ranges (WIDTHS). With a single offset all pieces of a group are the same LENGTH bytes: the tree is
   one leaf, whose first place is a minimum that every task takes a part of.

Texts are shuffled only where a stretch is to be cut out of them or a span to be removed, as long as the ids of these documents may be broadcast.

``repeat_groups`` returns the intervals themselves with all their occurrences. A repeat longer than a stretch is reported stretch by stretch there.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows that share an id are one document whose texts lie over each
other: what is found in any of them is removed from each, and equal rows are no repeats of one another; a null id comes after all others, as one
document; extra columns are not looked at. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, mix64, small, stored, text_or_empty

LENGTH, GRAM = 100, 32
#: Bytes hashed at once; stretches in a suffix array, on average; stretches of a group in it at most; bytes of text (a stretch in 23 of them) whose
#: stretches one task sorts.
BLOCK, TASK, HOT, PART = 1 << 19, 4096, 20_000, 24 << 20
#: Offsets of the anchor in a range, by which groups that are too large are split one after the other.
WIDTHS = 23, 8, 1
LAST = 2**63 - 1  # stands for a null id

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _span_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of ``width`` bytes, from those of half the width."""
    h, have = _BYTE[b], 1
    while have < width:
        step = min(have, width - have)
        h = mix64(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        have += step
    return h


def stretches(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, start, stop) of the stretches in texts that lie one after the other in b, the k-th up to ends[k]."""
    none = np.empty(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none
    h = _span_hashes(b, GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, have = LENGTH - GRAM + 1, 1
    while have < wide:
        step = min(have, wide - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each position
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(b) + 1, np.int32)
    fits = ends - starts >= LENGTH
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - LENGTH + 1, -1)
    q = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    if not len(q):
        return none, none, none
    a = anchor[q]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (q[1:] != q[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(q)]]) - 1
    return h[a[new]].view(np.int64), q[new], q[last] + LENGTH


def _blocks(ids: list, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, ids) of consecutive texts, BLOCK bytes or one text at a time."""
    own, parts, size = [], [], 0
    for i, t in zip(ids, texts):
        part = t.as_py().encode()
        own.append(i)
        parts.append(part)
        size += len(part)
        if size >= BLOCK:
            yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(own, np.int64)
            own, parts, size = [], [], 0
    if own:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(own, np.int64)


def _part(k: np.ndarray, parts: int) -> np.ndarray:
    return (k.view(np.uint64) >> np.uint64(32)).astype(np.int64) % parts


def _stretch_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows (part, data), see _unpack: a batch's different stretches by part of the key that they are to meet by. That is the anchor a of a stretch
    whose anchor has one content in the batch, and a ^ c, with c the content, of the others, of whose anchor one key a more goes to the count."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for b, ends, ids in _blocks(batch.column(0).to_pylist(), batch.column(1)):
            anchor, start, stop = stretches(b, ends)
            raw = memoryview(b.tobytes())
            content = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), stop.tolist())), np.uint64, len(start)).view(np.int64)
            doc = np.searchsorted(ends, start, side="right")
            for column, value in zip(found, (anchor, content, ids[doc], start - np.concatenate([[0], ends[:-1]])[doc], stop - start)):
                column.append(value)
        a, c, doc, start, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        order = np.lexsort((start, doc, c, a))
        a, c, doc, start, size = (x[order] for x in (a, c, doc, start, size))
        head, later, many = _heads(a, c, doc, start)
        rest = (mix64(doc[later].view(np.uint64) + start[later].view(np.uint64)).view(np.int64), a[later], c[later], doc[later], start[later])
        a, c, doc, start, size, many = (x[head] for x in (a, c, doc, start, size, many))
        again = np.zeros(len(a), bool)  # of the anchor of the row before
        again[1:] = a[1:] == a[:-1]
        several = again.copy()
        several[:-1] |= again[1:]
        one, counted = ~several, a[several & ~again]  # once each
        groups = (
            (a[one], c[one], doc[one], start[one].astype(np.int32), size[one].astype(np.uint8), many[one].astype(np.uint8)),
            (a[several] ^ c[several], c[several], doc[several], start[several].astype(np.int32), size[several].astype(np.uint8), many[several].astype(np.uint8)),
            (counted,),
            (rest[1], rest[2], rest[3], rest[4].astype(np.int32)),
        )
        cuts, sorted_groups = [], []
        for g, key in zip(groups, (groups[0][0], groups[1][0], counted, rest[0])):
            part = _part(key, parts)
            order = np.argsort(part, kind="stable")
            cuts.append(np.searchsorted(part[order], np.arange(parts + 1)))
            sorted_groups.append([x[order] for x in g])
        number, data = [], []
        for part in np.flatnonzero(np.any([np.diff(x) for x in cuts], axis=0)).tolist():
            sizes = np.array([x[part + 1] - x[part] for x in cuts], np.int64)
            number.append(part)
            data.append(sizes.tobytes() + b"".join(x[y[part] : y[part + 1]].tobytes() for g, y in zip(sorted_groups, cuts) for x in g))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])


_PACKED = (("<i8", "<i8", "<i8", "<i4", "<u1", "<u1"), ("<i8", "<i8", "<i8", "<i4", "<u1", "<u1"), ("<i8",), ("<i8", "<i8", "<i8", "<i4"))


def _unpack(data: list[bytes]) -> list[list[np.ndarray]]:
    """The columns of (key, content, doc, start, length, many) alone with their anchor, the same of several, keys to count, and later (anchor, content, doc, start)."""
    found = [[[] for _ in g] for g in _PACKED]
    for x in data:
        sizes, at = np.frombuffer(x, "<i8", 4).tolist(), 32
        for g, kinds, n in zip(found, _PACKED, sizes):
            for column, kind in zip(g, kinds):
                column.append(np.frombuffer(x, kind, n, at))
                at += n * int(kind[2])
    return [[np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in g] for g in found]


def _heads(k: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of all four: which are the first of their key and content (128 bits), which have the content but another place than the first, and
    of which firsts there are such others."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later = (doc != doc[first]) | (start != start[first])
    many = np.zeros(len(k), bool)
    many[first[later]] = True
    return new, later, many


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, c, doc, start, size) of a bounded part of all keys: stretches of anchors that may repeat, with their length, negative where there are later places;
    and the later places, of length 0."""
    one, several, counted, rest = _unpack([x.as_py() for b in batches for x in b.column(0)])
    out = [[], [], [], [], []]

    def add(*columns: np.ndarray) -> None:
        for column, x in zip(out, columns):
            column.append(x)

    for alone, (k, c, doc, start, size, many) in ((True, one), (False, several)):
        order = np.lexsort((start, doc, c, k))
        k, c, doc, start, size, many = (x[order] for x in (k, c, doc, start, size, many))
        head, later, more = _heads(k, c, doc, start)
        a = k if alone else k ^ c
        add(a[later], c[later], doc[later], start[later], np.zeros(later.sum(), np.int64))
        more[np.flatnonzero(head)] |= np.bincount(np.cumsum(head) - 1, many, head.sum()) > 0
        k, a, c, doc, start, size, more = (x[head] for x in (k, a, c, doc, start, size, more))
        take = np.ones(len(k), bool)
        if alone and len(k):
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            last = np.concatenate([new[1:], [len(k)]]) - 1
            take = np.repeat((last > new) | np.isin(k[new], counted), last - new + 1) | more
        add(a[take], c[take], doc[take], start[take], np.where(more, -size, size)[take])
    add(*rest, np.zeros(len(rest[0]), np.int64))
    columns = [np.concatenate(x) for x in out]
    for at in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in columns], ["a", "c", "doc", "start", "size"])


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, document by document; spans that touch become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # the largest stop so far within the document: a document's spans are lifted above those of the documents before
    lift = np.cumsum(new) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    new[1:] |= start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last] - lift[first]


def intervals(suffixes: list[bytes], left: list[int], order: list, several: list[bool] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(length, from, to, first) of the maximal repeats of at least LENGTH bytes among sorted suffixes: the interval from..to (inclusive) of the
    suffix array and the position in it of the occurrence that is least by ``order``. left: the byte before each suffix, negative and
    different from all others where there is none. several: which suffixes have further places with other bytes before them, so that the leaf alone is an
    interval, unless it is as long as the one around it."""

    def common(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8

    stack: list[list] = []  # open intervals: [length, from, left byte or None once they differ, first]
    n, before = len(suffixes), 0
    for k in range(1, n + 1):
        length = common(suffixes[k - 1], suffixes[k]) if k < n else 0
        leaf = [None, k - 1, left[k - 1], k - 1]
        if several and several[k - 1] and len(suffixes[k - 1]) > max(before, length):
            leaf[2] = None
            yield len(suffixes[k - 1]), k - 1, k - 1, k - 1
        before = length
        carry = leaf
        while stack and stack[-1][0] > length:
            top = stack.pop()
            _join(top, carry, order)
            if top[0] >= LENGTH and top[2] is None:
                yield top[0], top[1], k - 1, top[3]
            carry = top
        if stack and stack[-1][0] == length:
            _join(stack[-1], carry, order)
        else:
            stack.append([length, carry[1], carry[2], carry[3]])


def _join(into: list, part: list, order: list) -> None:
    if into[2] != part[2]:
        into[2] = None
    if order[part[3]] < order[into[3]]:
        into[3] = part[3]


def _nodes(pdf: pd.DataFrame) -> Iterator[tuple[int, list[tuple[list, int]], tuple[int, int]]]:
    """The suffix array of a bounded set of pieces: (length, members, first occurrence) of its maximal repeats. A member is the places of a piece, (doc, start,
    anchor, content, base, many) each, and the offset of the repeat in the piece; an occurrence is (doc, start)."""
    places: dict[bytes, set[tuple]] = {}
    for row in zip(*(pdf[c].tolist() for c in ("bytes", "doc", "start", "a", "c", "base", "many"))):
        places.setdefault(row[0], set()).add(row[1:])
    texts, where = list(places), [sorted(x) for x in places.values()]
    several = [x[0][:2] != x[-1][:2] or any(p[5] for p in x) for x in where]
    b = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    h = _span_hashes(b, LENGTH)
    owner = np.repeat(np.arange(len(texts)), ends - begins - LENGTH + 1)
    at = np.arange(len(owner)) + (owner * (LENGTH - 1))  # window starts: all but the last LENGTH - 1 positions of each piece
    _, back, count = np.unique(h[at], return_inverse=True, return_counts=True)
    offset = at - begins[owner]
    taken = np.flatnonzero((count[back] > 1) | ((offset == 0) & np.array(several, bool)[owner]))
    own, off = owner[taken].tolist(), offset[taken].tolist()
    suffixes = [texts[o][p:] for o, p in zip(own, off)]
    array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    first_of = [(where[own[k]][0][0], where[own[k]][0][1] + off[k]) for k in array]
    left = [texts[own[k]][off[k] - 1] if off[k] else -1 - k for k in array]
    for length, lo, hi, first in intervals([suffixes[k] for k in array], left, first_of, [off[k] == 0 and several[own[k]] for k in array]):
        yield length, [(where[own[k]], off[k]) for k in array[lo : hi + 1]], first_of[first]


_SPANS = "doc long, start long, stop long, a long, c long"


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans to remove; and, without an id, those of leaves, which all later places of the stretch (a, c) lose."""
    doc, start, stop, leaves = [], [], [], {}
    for length, members, first in _nodes(pdf):
        for every, off in members:
            for d, s, a, c, base, many in every:
                if (d, s + off) != first:
                    doc.append(d)
                    start.append(s + off)
                    stop.append(s + off + length)
                if many and base + off == 0:
                    leaves[a, c] = max(length, leaves.get((a, c), 0))  # the whole stretch is among them
    d, s, e = merged(np.array(doc, np.int64), np.array(start, np.int64), np.array(stop, np.int64))
    spans = pd.DataFrame({"doc": d, "start": s, "stop": e}).astype("Int64")
    late = pd.DataFrame([(None, 0, n, a, c) for (a, c), n in leaves.items()], columns=["doc", "start", "stop", "a", "c"]).astype("Int64")
    return pd.concat([spans.assign(a=pd.NA, c=pd.NA).astype("Int64"), late])


_MEMBERS = "group string, length long, doc long, start long, a long, c long, off long, many boolean"


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for length, members, first in _nodes(pdf):
        name = f"{first[0]}:{first[1]}:{length}"
        rows += sorted({(name, length, d, s + off, a, c, base + off, many) for every, off in members for d, s, a, c, base, many in every})
    return pd.DataFrame(rows, columns=["group", "length", "doc", "start", "a", "c", "off", "many"])


def _parts(a: int, piece: bytes, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(group, offset, bytes) of the parts of a piece with anchor hash a that hold the windows with the anchor at one range of offsets; the group is a hash
    of the bytes that all windows of the range have in common."""
    at = np.flatnonzero(_span_hashes(np.frombuffer(piece, np.uint8), GRAM).view(np.int64) == a)
    p = int(at[0]) if len(at) else 0
    for low in range(0, (LENGTH - GRAM + 1) * (len(at) > 0), width):  # cut out of another text of the same id, a piece has no anchor
        lo, hi = max(low, p - (len(piece) - LENGTH)), min(low + width - 1, LENGTH - GRAM, p)
        if lo <= hi:
            top = min(low + width - 1, LENGTH - GRAM)
            common = piece[p - low : p - top + LENGTH]
            yield xxhash.xxh3_64_intdigest(common, low) - (1 << 63), p - hi, piece[p - hi : p - lo + LENGTH]


_PIECE = "doc long, start long, a long, c long, base long, many boolean, g long, bytes binary"


def _split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces (_PIECE) as parts by narrower ranges of offsets."""
    for b in batches:
        rows: list[tuple] = []
        for d, s, a, c, base, many, piece in zip(*(b.column(k).to_pylist() for k in ("doc", "start", "a", "c", "base", "many", "bytes"))):
            rows += [(d, s + at, a, c, base + at, many, g, part) for g, at, part in _parts(a, piece, width)]
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], ["doc", "start", "a", "c", "base", "many", "g", "bytes"])


class _Pieces:
    """Steps 1 and 2: the different stretches that may repeat, cut out of the texts, and the later places of equal ones."""

    def __init__(self, docs: DataFrame, id: str, text: str):
        self.rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("doc"), text_or_empty(text).alias("t")).where(F.octet_length("t") >= LENGTH)
        n = 1 + (self.rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // PART
        found = self.rows.mapInArrow(partial(_stretch_rows, parts=4 * n), "part long, data binary").repartition(n, "part")
        found = stored(found.select("data").mapInArrow(_distinct, "a long, c long, doc long, start long, size long"), "stretches")
        self.later = found.where("size = 0").drop("size")
        need = found.where("size != 0").select("a", "c", "doc", "start", F.abs("size").alias("size"), (F.col("size") < 0).alias("many"))
        hot = cut(need.groupBy("a").count().where(F.col("count") > HOT).select("a"))
        self.hot = None
        calm = need.withColumn("own", F.lit(False))  # whether it has a tree of its own, away from its anchor's
        if hot.limit(1).count():
            self.hot = need.join(small(hot), "a", "left_semi").withColumn("own", F.lit(False))
            calm = calm.join(small(hot), "a", "left_anti").unionByName(self.hot.where("many").withColumn("own", F.lit(True)))
        self.calm, self.total = calm, calm.count()

    def cut_out(self, need: DataFrame) -> DataFrame:
        """The given stretches with their bytes (_PIECE)."""
        place = F.col("start") * 1024 + F.col("size") * 4 + F.col("many").cast("long") * 2 + F.col("own").cast("long")  # a stretch has at most 2 * LENGTH - GRAM bytes
        per = stored(need.groupBy("doc").agg(F.collect_list(F.struct("a", "c", place.alias("place"))).alias("cuts")), "cuts")  # at most the stretches of a document

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for d, t, cuts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    raw = t.as_py().encode()
                    for a, c, place in zip(*(cuts.values.field(k).to_pylist() for k in range(3))):
                        start, size = place >> 10, place >> 2 & 255
                        if start + size <= len(raw):
                            rows.append((d, start, a, c, 0, bool(place & 2), a ^ c if place & 1 else a, raw[start : start + size]))
                yield _batch(rows)

        some = self.rows.join(small(per.select("doc")), "doc", "left_semi")  # else all texts would be shuffled
        return some.join(per, "doc").select("doc", "t", "cuts").mapInArrow(of, _PIECE)

    def trees(self, work, schema: str) -> DataFrame:
        """work on the pieces of each bounded group."""

        def grown(pieces: DataFrame, total: int) -> DataFrame:
            tasks = max(1, -(-total // TASK))
            return pieces.withColumn("task", F.pmod("g", F.lit(tasks))).groupBy("task").applyInPandas(work, schema)

        out = grown(self.cut_out(self.calm), self.total)
        if self.hot is None:
            return out
        pieces = self.cut_out(self.hot)
        for width in WIDTHS:
            pieces = cut(pieces.mapInArrow(partial(_split, width=width), _PIECE))
            counts = cut(pieces.groupBy("g").count().where("count > 1"))
            if width > 1:
                calm = counts.where(F.col("count") <= HOT)
                out = out.unionByName(grown(pieces.join(small(calm.select("g")), "g", "left_semi"), calm.agg(F.sum("count")).first()[0] or 0))
                pieces = pieces.join(small(counts.where(F.col("count") > HOT).select("g")), "g", "left_semi")
        self.leaves = pieces.join(small(counts.select("g")), "g", "left_semi")
        return out

    def classes(self) -> DataFrame:
        """(_MEMBERS and first): the windows that are left after the last split and occur more than once, with their first occurrence."""
        windows = self.leaves.withColumn("w", F.sha2("bytes", 256))
        earliest = cut(windows.groupBy("w").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).where("first < last").select("w", "first"))
        group = F.concat_ws(":", "first.doc", "first.start", F.lit(LENGTH))
        return windows.join(small(earliest), "w").select(group.alias("group"), F.lit(LENGTH).cast("long").alias("length"), "doc", "start", "a", "c", F.col("base").alias("off"), "many", "first")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans array<struct<start, stop>>): the bytes to remove of each document that has some; spans may overlap."""
    x = _Pieces(docs, id, text)
    found = stored(x.trees(_repeats, _SPANS), "intervals")
    spans = found.where("doc is not null").select("doc", "start", "stop")
    leaves = found.where("doc is null").select("a", "c", F.col("stop").alias("size"))
    later = x.later.join(small(leaves), ["a", "c"])
    spans = spans.unionByName(later.select("doc", "start", (F.col("start") + F.col("size")).alias("stop")))
    if x.hot is not None:
        late = x.classes().where(F.col("first") != F.struct("doc", "start"))
        spans = spans.unionByName(late.select("doc", "start", (F.col("start") + LENGTH).alias("stop")))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def repeat_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, length, id, start): the maximal repeats of at least LENGTH bytes with all their occurrences, a row for each. A group is named by its first
    occurrence and length."""
    x = _Pieces(docs, id, text)
    members = x.trees(_groups, _MEMBERS)
    if x.hot is not None:
        members = members.unionByName(x.classes().drop("first"))
    members = cut(members)
    more = members.where("many").select("group", "length", "a", "c", "off").distinct()
    more = x.later.join(more, ["a", "c"]).select("group", "length", "doc", (F.col("start") + F.col("off")).alias("start"))
    out = members.select("group", "length", "doc", "start").unionByName(more).distinct()
    return out.withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc"))).withColumnRenamed("doc", id)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans; one row for each row of docs."""
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("doc"), text_or_empty(text).alias("t"))
    spans = stored(repeats(docs, id, text), "spans")
    hit = spans.select("doc")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, spans in zip(b.column(1), b.column(2)):
                raw = t.as_py().encode()
                s = spans.as_py() or []
                start, stop = (np.minimum(np.array([x[k] for x in s], np.int64), len(raw)) for k in ("start", "stop"))
                full = start < stop
                _, start, stop = merged(np.zeros(full.sum(), np.int64), start[full], stop[full])
                edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])])
                for column, value in zip(out, (kept, len(raw), len(raw) - len(kept), len(start))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc", "kept", "n_bytes", "n_removed", "n_spans"])

    if hit.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # texts that stay whole need no shuffle
        whole = rows.join(F.broadcast(hit), "doc", "left_anti").select("doc", "t", F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("spans"))
        rows = whole.unionByName(rows.join(F.broadcast(hit), "doc", "left_semi").join(spans, "doc").select("doc", "t", "spans"))
    else:
        rows = rows.join(spans, "doc", "left").select("doc", "t", "spans")
    done = rows.mapInArrow(take, "doc long, kept binary, n_bytes long, n_removed long, n_spans long")
    return done.withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc"))).withColumnRenamed("doc", id)


def digest(result: DataFrame, id: str = "doc_id") -> DataFrame:
    return result.select(id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str]]) -> dict[int, tuple[int, int, int, str]]:
    """The definition itself, for tests: id -> (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - LENGTH + 1):
            if (w := raw[p : p + LENGTH]) in seen:
                mark[p : p + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        kept = bytes(x for x, m in zip(raw, mark) if not m)
        out[i] = (len(raw), sum(mark), sum(1 for p in range(len(raw)) if mark[p] and (p == 0 or not mark[p - 1])), hashlib.sha256(kept).hexdigest())
    return out
