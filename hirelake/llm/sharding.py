"""Sharding by extendible hashing.

Documents are addressed by the leading bits of a hash of their id. The directory starts at no bits; a bucket over the byte limit, and only
such a one, splits on one more bit, until every bucket fits. Bytes are summed once per prefix of ``step`` bits beyond those that an
even spread needs, all shorter prefixes are sums of these, and a bucket is the shortest prefix that fits while its parent does not. Where even the
longest prefix summed is too large, its documents alone go on with ``step`` more bits, up to BITS.

Documents with one hash cannot be parted by it: a bucket of BITS bits may exceed the limit (a single document larger than the limit, or many rows of
one id); it is marked ``oversize``. Defined cases: a null text has no bytes; a null id is hashed as the empty string; an empty table has no shards;
extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, text_or_empty

BITS, LIMIT = 60, 32 << 20


def addresses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bits, n_bytes): bits are the first BITS bits of md5 of the id, as a string of 0 and 1."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))), 1, BITS // 4), 16, 2)
    return docs.select(F.col(id).alias("id"), F.lpad(h, BITS, "0").alias("bits"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"))


def _leaves(cells: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, fits): from cells (cell: prefix of ``depth`` bits, n_bytes) the buckets below prefixes of ``base`` bits."""
    tree = cells.select("n_bytes", F.explode(F.transform(F.sequence(F.lit(base), F.lit(depth)), lambda d: F.struct(d.alias("d"), F.substring("cell", F.lit(1), d).alias("p")))).alias("x"))
    sums = tree.groupBy(F.col("x.d").alias("d"), F.col("x.p").alias("shard")).agg(F.sum("n_bytes").alias("shard_bytes"))
    parents = sums.select((F.col("d") + 1).alias("d"), F.col("shard").alias("parent"), (F.col("shard_bytes") > limit).alias("split"))
    own = sums.withColumn("parent", F.expr("substring(shard, 1, d - 1)")).join(parents, ["d", "parent"], "left")
    reached = (F.col("d") == base) | F.col("split")
    fits = F.col("shard_bytes") <= limit
    return own.where(reached & (fits | (F.col("d") == depth))).select("shard", F.col("d").alias("depth"), "shard_bytes", fits.alias("fits"))


def directory(addressed: DataFrame, limit: int = LIMIT, step: int = 6) -> DataFrame:
    """(shard: bits, depth, shard_bytes, oversize): the buckets."""
    total = addressed.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    cells = cut(addressed.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")))
    leaves = cut(_leaves(cells, 0, depth, limit))
    done = leaves.where("fits")
    full = leaves.where("not fits").select(F.col("shard").alias("cell"), F.col("shard_bytes").alias("n_bytes"))
    while depth < BITS and full.limit(1).count():
        base, depth = depth, min(BITS, depth + step)
        rest = addressed.withColumn("_up", F.substring("bits", 1, base)).join(small(full.select(F.col("cell").alias("_up"))), "_up", "left_semi")
        cells = cut(rest.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")))
        leaves = cut(_leaves(cells, base, depth, limit))
        done = done.unionByName(leaves.where("fits"))
        full = leaves.where("not fits").select(F.col("shard").alias("cell"), F.col("shard_bytes").alias("n_bytes"))
    over = full.select(F.col("cell").alias("shard"), F.length("cell").alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("oversize"))
    return cut(done.select("shard", "depth", "shard_bytes", F.lit(False).alias("oversize")).unionByName(over))


def assign(docs: DataFrame, limit: int = LIMIT, id: str = "doc_id", text: str = "text", step: int = 6) -> DataFrame:
    """id, n_bytes, shard, depth, shard_bytes, oversize for each row."""
    addressed = cut(addresses(docs, id, text))
    buckets = directory(addressed, limit, step)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most BITS + 1
    keys = F.array(*[F.substring("bits", 1, int(d)) for d in depths]) if depths else F.array().cast("array<string>")
    # exactly one prefix of a document's bits is a bucket
    placed = addressed.withColumn("_shards", keys)
    names = small(buckets)
    rows = placed.select("id", "n_bytes", F.explode("_shards").alias("shard")).join(names, "shard")
    return rows.select(F.col("id").alias(id), "n_bytes", "shard", "depth", "shard_bytes", "oversize")


def slots(buckets: DataFrame) -> DataFrame:
    """(slot, shard): the directory as a table of 2^g slots, g the greatest depth of a bucket that is not oversize: where each hash prefix of g bits leads."""
    fine = buckets.where("not oversize")
    depth = fine.agg(F.max("depth")).first()[0] or 0
    free = F.lit(depth) - F.col("depth")
    tails = F.when(free > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), free).cast("long") - 1), lambda n: F.lpad(F.conv(n, 10, 2), free.cast("int"), F.lit("0")))).otherwise(F.array(F.lit("")))
    return fine.select("shard", F.explode(tails).alias("_tail")).select(F.concat("shard", "_tail").alias("slot"), "shard")


def write(docs: DataFrame, path: str, limit: int = LIMIT, id: str = "doc_id", text: str = "text") -> None:
    """The documents as Parquet folders, one for each shard (``shard=`` and its bits; a column of that name is not written)."""
    of = fresh(docs, "_sid")
    shards = cut(assign(docs, limit, id, text).select(F.col(id).alias(of), "shard").distinct())
    docs.drop("shard").join(small(shards), F.col(id).eqNullSafe(F.col(of))).drop(of).repartition("shard").write.partitionBy("shard").parquet(path)
