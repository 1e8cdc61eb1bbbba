"""MinHash near-dedup with odd sketches.

1. Each document becomes its set of word shingles, ``BANDS x ROWS`` MinHash samples of it, a hash of each band, and an odd sketch: a bitmap
   in which every (sample number, sample) flips one bit. Of two sketches the XOR has about as many ones as samples differ, which tells
   high similarities precisely.
2. Documents with equal sets are one class, linked to its smallest id without further ado; only classes go on.
3. Classes that share a band are candidates. First every member of a bucket is compared with the bucket's head only (a star), the member
   that shares most with others: the sketches must not rule out the threshold, then the full sets, from the texts, decide. The links give
   provisional components.
4. What is left are pairs of a bucket in different components. In buckets of up to ``FEW`` members they are listed, filtered by sketches and
   compared on full sets. Larger buckets are cut into blocks of members, and each pair of blocks, of which one has no member of the bucket's
   largest component, is looked through in one task on sketches; it returns only enough pairs to tie the components that may belong
   together. The components so tied are compared on full sets in the same blockwise way. So every candidate pair is compared on full sets,
   or ruled out by its sketch, or inside one component already, and no stage lists the square of a group.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with probability 5e-8. Of its 128 samples 25.6 differ on average, and the XOR
of its sketches has 42 ones, with a deviation of 7.5. ``cutoff`` gives the number of ones that a pair at the threshold exceeds with probability
``MISS`` at most: 78 for 0.8. Below 0.6 the bands would miss pairs, so ``percent`` must not be less.

No group is one task's work: what is aggregated by bucket is checkpointed, and then broadcast if its counted size allows it, or joined so that
adaptive execution may split a hot bucket; pairs of blocks are dealt by group and block numbers.

Defined cases: a text without words, or null, has an empty set, is linked with nothing and kept; fewer words than a shingle count as one shingle;
rows that share an id are one node, linked by any of their texts, each with its own n_shingles (ids are integers); a null id is linked with nothing, its
component is null and it is kept; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix64, small, text_or_empty, window_hashes
from .graph import components

BANDS, ROWS, BITS = 32, 4, 256
#: Probability with which sketches may rule out a pair at the threshold; members of a bucket whose pairs are listed; members in a block.
MISS, FEW, MEMBERS = 1e-6, 32, 512

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Runs of other than the six ASCII blanks, A-Z lower-cased: what bytes.split and bytes.lower know."""
    return text.encode().lower().split()


def shingle_set(text: str, n: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < n else set(zip(*[w[k:] for k in range(n)]))


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    return np.unique(window_hashes(h, min(n, len(w)) or n))


def samples(h: np.ndarray) -> np.ndarray:
    """The MinHash samples: for each multiply-add hash function the least value over the set."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(low, (h[at : at + 2048, None] * _MUL + _ADD).min(0), out=low)
    return low


_ORD = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(56)


def sketch(low: np.ndarray) -> np.ndarray:
    """The odd sketch as BITS / 64 words."""
    at = mix64((low >> np.uint64(8)) ^ _ORD ^ (_ORD >> np.uint64(30))) % np.uint64(BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


@cache
def cutoff(percent: int, miss: float = MISS) -> int:
    """The least c so that the XOR of the sketches of two sets at similarity ``percent`` / 100 has more than c ones with probability ``miss`` at most."""
    total, differ = BANDS * ROWS, 1 - percent / 100
    k = np.arange(BITS + 1)
    ones = np.zeros(BITS + 1)  # the distribution of the number of ones after two flips for each differing sample
    ones[0] = 1
    tail = np.zeros(BITS + 1)
    for d in range(total + 1):
        weight = math.comb(total, d) * differ**d * (1 - differ) ** (total - d)
        tail += weight * (1 - np.cumsum(ones))
        for _ in range(2):
            ones = np.concatenate([[0], (ones * (BITS - k) / BITS)[:-1]]) + np.concatenate([(ones * k / BITS)[1:], [0]])
    return int(np.flatnonzero(tail <= miss)[0])


def signatures(docs: DataFrame, n: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, f1, f2, bands, sketch): f1, f2 a 128-bit hash of the set; bands and sketch are null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, f1, f2, bands, sketches = [], [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), n)
                sizes.append(len(h))
                both = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                f1.append(int(both[0]))
                f2.append(int(both[1]))
                if len(h):
                    low = samples(h)
                    folded = low.reshape(BANDS, ROWS)
                    band = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
                    for k in range(ROWS):
                        band = mix64(band ^ folded[:, k])
                    bands.append(band.view(np.int64))
                    sketches.append(sketch(low))
                else:
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["id", "n_shingles", "f1", "f2", "bands", "sketch"])

    rows = docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(of, "id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _ones(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(BITS // 64)])


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, id: str, text: str) -> DataFrame:
    """(a, b, linked) for each pair, decided on the full sets of the two texts."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("_want")).distinct())
    texts = docs.select(F.col(id).cast("long").alias("_id"), text_or_empty(text).alias("_t")).join(small(ids), F.col("_id") == F.col("_want"), "left_semi")
    two = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_t").alias("ta")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if len(known) > 64:
                    known.clear()
                for t in (x, y):
                    if t not in known:
                        known[t] = shingle_hashes(t, n)
                p, q = known[x], known[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return cut(two.mapInArrow(decide, "a long, b long, linked boolean").groupBy("a", "b").agg(F.bool_or("linked").alias("linked")))


def _near_sketches(left: list, right: list, far: int) -> np.ndarray:
    a, b = (np.stack([np.asarray(x, np.int64).view(np.uint64) for x in side]) for side in (left, right))  # bitwise_count takes the absolute value of signed numbers
    ones = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        ones += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return ones <= far


def _near_sets(percent: int):
    def near(left: list, right: list) -> np.ndarray:
        """Of sets given as the bytes of their distinct shingle hashes: intersections by products of 0/1 matrices, some shingles at a time."""
        sets = [np.frombuffer(x, np.uint64) for x in [*left, *right]]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1  # what one set has alone does not matter
        owner, at = owner[count[at] > 1], place[at[count[at] > 1]]
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            x, y = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[x:y], at[x:y] - lo] = 1
            common += m[: len(left)] @ m[len(left) :].T
        common = np.rint(common).astype(np.int64)
        return (common > 0) & (100 * common >= percent * (sizes[: len(left), None] + sizes[None, len(left) :] - common))

    return near


def _ties(near):
    """For one pair of blocks: pairs that tie the components with near members, no more than it takes."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, even = pdf["i"].iloc[0], pdf["j"].iloc[0], bool(pdf["even"].iloc[0])
        left = pdf[pdf["odd"] & (pdf["chunk"] == i)]
        right = pdf[(pdf["odd"] != even) & (pdf["chunk"] == j)]
        a, b = [], []
        if len(left) and len(right):
            cl, cr = left["c"].to_numpy(), right["c"].to_numpy()
            x, y = np.nonzero(near(left["data"].tolist(), right["data"].tolist()) & (cl[:, None] != cr[None, :]))
            both = np.stack([np.minimum(cl[x], cr[y]), np.maximum(cl[x], cr[y])], 1)
            _, first = np.unique(both, axis=0, return_index=True)
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while up.setdefault(c, c) != c:
                    up[c] = c = up[up[c]]
                return c

            li, ri = left["id"].to_numpy(), right["id"].to_numpy()
            for k in first.tolist():
                p, q = root(int(both[k, 0])), root(int(both[k, 1]))
                if p != q:
                    up[q] = p
                    a.append(int(li[x[k]]))
                    b.append(int(ri[y[k]]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return of


def _blockwise(members: DataFrame, near) -> DataFrame:
    """(a, b): near pairs that tie the components c within each group g of members (g, id, c, data)."""
    by = members.groupBy("g", "c").count().groupBy("g").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("c", F.struct("count", "c")).alias("main"), F.count("c").alias("parts"))
    by = cut(by.where("parts > 1").select("g", "main", F.ceil(F.col("most") / MEMBERS).alias("ne"), F.ceil((F.col("n") - F.col("most")) / MEMBERS).alias("no")))
    rows = members.join(small(by), "g").withColumn("odd", F.col("c") != F.col("main"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("odd"), F.col("no")).otherwise(F.col("ne"))))
    block = lambda i, even, j: F.struct(i.alias("i"), F.lit(even).alias("even"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    k = F.col("chunk")
    odd = F.concat(F.transform(upto("ne"), lambda j: block(k, True, j)), F.transform(upto("no"), lambda j: block(F.least(k, j), False, F.greatest(k, j))))
    even = F.transform(upto("no"), lambda i: block(i, True, k))
    rows = rows.select("g", "id", "c", "data", "odd", "chunk", F.explode(F.when(F.col("odd"), odd).otherwise(even)).alias("x")).select("*", "x.*").drop("x")
    key = ("g", "i", "even", "j")  # dealt by all of it, also where the rows are already dealt by g
    return rows.repartition(*key).groupBy(*key).applyInPandas(_ties(near), "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, n: int, id: str, text: str) -> DataFrame:
    """(id, data): the bytes of the shingle hashes of the given documents' texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py(), n).tobytes() for t in b.column(1)], pa.binary())], ["id", "data"])

    texts = docs.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("_t")).join(small(ids), F.col("id") == F.col("_want"), "left_semi")
    return texts.mapInArrow(of, "id long, data binary")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: for each row its component at similarity ``percent`` / 100 of n-word shingle sets."""
    if percent < 60:
        raise ValueError("percent must be at least 60")
    far = cutoff(percent)
    sig = cut(signatures(docs, n, id, text))
    some = sig.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    content = ["f1", "f2", "n_shingles"]
    firsts = cut(some.groupBy(*content).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    same = cut(some.select("id", *content).join(small(firsts), content).where(F.col("id") != F.col("first")).select("id", "first", *content).distinct())
    classes = some.join(small(same.drop("first"), 1_000_000), ["id", *content], "left_anti").select("id", "bands", "sketch")
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    counts = cut(rows.groupBy("bucket").agg(F.count("id").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("bucket", "n"))
    shared = cut(rows.join(small(counts), "bucket"))  # of buckets with two classes at least
    sketches = cut(classes.select("id", "sketch").join(shared.select("id").distinct(), "id", "left_semi"))

    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    heads = cut(shared.join(weight, "id").groupBy("bucket").agg(F.max_by("id", F.struct(F.col("weight"), -F.col("id"))).alias("head")))
    stars = shared.join(small(heads), "bucket").where(F.col("id") != F.col("head")).select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()
    first, second = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    stars = cut(stars.join(first, "a").join(second, "b").where(_ones(F.col("sa"), F.col("sb")) <= far).select("a", "b").distinct())
    compared = verified(stars, docs, n, percent, id, text)
    links = compared.where("linked").select("a", "b")
    comp = cut(components(links))

    member = shared.join(small(comp), F.col("id") == F.col("node"), "left").select("bucket", "n", "id", F.coalesce("component", "id").alias("c"))
    mixed = cut(member.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("bucket"))
    member = cut(member.join(small(mixed), "bucket", "left_semi").join(sketches, "id"))
    few = member.where(F.col("n") <= FEW)
    left, right = (few.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "c", "sketch")]) for s in "lr")
    cross = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("id_l") < F.col("id_r")) & (F.col("c_l") != F.col("c_r")) & (_ones(F.col("sketch_l"), F.col("sketch_r")) <= far))
    cross = cut(cross.select(F.col("id_l").alias("a"), F.col("id_r").alias("b")).distinct().join(compared, ["a", "b"], "left_anti"))
    links = links.unionAll(verified(cross, docs, n, percent, id, text).where("linked").select("a", "b"))
    many = member.where(F.col("n") > FEW)
    if many.limit(1).count():
        ties = _blockwise(many.select(F.col("bucket").alias("g"), "id", "c", F.col("sketch").alias("data")), partial(_near_sketches, far=far))
        owner = cut(many.select("id", "c").distinct())
        ties = ties.join(owner.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(owner.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        tied = cut(components(ties.select(F.col("ca").alias("a"), F.col("cb").alias("b")))).select(F.col("node").alias("c"), F.col("component").alias("g"))
        owner = cut(owner.join(small(tied), "c"))
        sets = _sets(docs, cut(owner.select(F.col("id").alias("_want")).distinct()), n, id, text)
        more = _blockwise(owner.join(sets, "id").select("g", "id", "c", "data"), _near_sets(percent))
        links = links.unionAll(cut(more).select("a", "b"))
    links = links.unionAll(same.select(F.col("first").alias("a"), F.col("id").alias("b")))
    comp = cut(components(links)).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    out = sig.select("id", "n_shingles").join(small(comp), F.col("id") == F.col("_node"), "left")
    out = out.select("id", "n_shingles", F.coalesce("_component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id)


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, columns unchanged."""
    name = fresh(docs, "_gone")
    gone = cut(near_components(docs, n, percent, id, text).where(~F.col("kept")).select(F.col(id).alias(name)).distinct())
    return docs.join(small(gone), F.col(id) == F.col(name), "left_anti")
