"""Exact dedup: two passes with a Bloom filter find the texts that may repeat, and only their rows are shuffled.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts the row with the most characters in
the original text stays, then the smallest id.

1. Each row becomes a narrow one: id, length, SHA-256 of the normalized text. The digest picks a 64-bit word of a blocked Bloom filter and BITS
   bits in it. The first pass notes for every word which bits were set at least twice. It counts equal (word, bits) before the shuffle, so a text in
   a third of all rows leaves one row in each task; a word then holds only the few different bit sets that chance deals to it.
2. The second pass tests every row against the words that hold a set of bits all set twice. Rows that fail are unique for certain and pass straight
   through. The rest (true repeats and about one unique row in two hundred) are grouped by digest.

The filter, and the groups that are joined back to their members, are broadcast only after a count. Beyond the bound the few keys with many rows are
still broadcast, at most one for every HEAVY rows, and the others meet by a shuffle of narrow rows, so no hot key fills one task.

``keep_longest`` returns the rows that stay, with all columns; there the texts that may repeat are shuffled, and no others.

Defined cases: a null text is empty, and all empty or blank texts are equal; a null id comes after all others; of rows with one id and length in one
group exactly one stays; extra columns may have any name; an empty table gives no rows. Built-in expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

BLANKS = " \t\n\x0b\x0c\r"
#: Rows for a word of the filter, bits for a row, and rows of one key from which it is looked up by broadcast in any case.
PER_WORD, BITS, HEAVY = 4, 4, 20_000


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


def _bits(digest: Column) -> Column:
    g = F.xxhash64(digest, F.lit(1))
    one = F.lit(1).cast("long")
    return reduce(lambda x, y: x.bitwiseOR(y), [F.call_function("shiftleft", one, F.shiftrightunsigned(g, 6 * k).bitwiseAND(63).cast("int")) for k in range(BITS)])


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def repeated_bits(rows: DataFrame, words: int) -> DataFrame:
    """First pass over rows (word, bits): (word, twice, rows) of the words in which some row's bits were all set at least twice."""
    seen = rows.groupBy("word", "bits").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(0).cast("long")

    def add(s: Column, x: Column) -> Column:
        again = F.when(x["n"] > 1, x["bits"]).otherwise(s["once"].bitwiseAND(x["bits"]))
        return F.struct(s["once"].bitwiseOR(x["bits"]).alias("once"), s["twice"].bitwiseOR(again).alias("twice"))

    sets = seen.groupBy("word").agg(F.collect_list(F.struct("bits", "n")).alias("sets"), F.sum("n").alias("rows"))
    twice = F.aggregate("sets", F.struct(nothing.alias("once"), nothing.alias("twice")), add)["twice"]
    full = F.exists("sets", lambda x: x["bits"].bitwiseAND(F.col("twice")) == x["bits"])
    return sets.withColumn("twice", twice).where(full).select("word", "twice", "rows")


def _looked_up(rows: DataFrame, keyed: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """rows left-joined with the checkpointed table that has one row for each key; weight: its column that says how many rows have the key."""
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), key, "left")
    heavy = keyed.where(F.col(weight) >= HEAVY)  # at most one for HEAVY rows
    if heavy.limit(most + 1).count() > most:
        return rows.join(keyed, key, "left")
    hot = F.broadcast(heavy)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(weight) < HEAVY), key, "left"))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """id, keep_id (the id of the row that stays), group_size, kept, text_sha256; one row for each row of docs. most: rows of a broadcast."""
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = cut(source.select("id", F.coalesce(F.length("t"), F.lit(0)).alias("size"), _digest(F.col("t")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    words = 1 + rows.count() // PER_WORD
    rows = rows.withColumn("word", _word(F.col("digest"), words)).withColumn("bits", _bits(F.col("digest")))
    filter = cut(repeated_bits(rows.select("word", "bits"), words))
    tested = _looked_up(rows, filter, "word", "rows", most)
    may = F.coalesce(F.col("twice").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))
    out = (F.col("id").alias(id), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    alone = tested.where(~may).select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = cut(tested.where(may).select("id", "size", "digest", "row"))
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("last"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = cut(again.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "best.keep_id", "best.keep_row", "n"))
    member = F.col("n").isNotNull()
    told = _looked_up(again, groups, "digest", "n", most).select(
        "id", "digest", F.when(member, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (~member | (F.col("row") == F.col("keep_row"))).alias("kept")
    )
    return alone.unionByName(told).select(*out)


def keep_longest(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay. Where the filter is beyond what may be broadcast, all rows are grouped."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).withColumn("digest", _digest(F.col("r")[text]))
    words = 1 + whole.count() // PER_WORD
    keyed = whole.withColumn("word", _word(F.col("digest"), words)).withColumn("bits", _bits(F.col("digest")))
    filter = cut(repeated_bits(keyed.select("word", "bits"), words))
    order = F.struct(-F.coalesce(F.length(F.col("r")[text].cast("string")), F.lit(0)), F.col("r")[id].isNull(), F.col("r")[id])
    longest = F.min_by("r", order).alias("r")
    if filter.limit(most + 1).count() > most:
        return keyed.groupBy("digest").agg(longest).select("r.*")
    tested = keyed.join(F.broadcast(filter), "word", "left")
    may = F.coalesce(F.col("twice").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))
    return tested.where(~may).select("r").unionByName(tested.where(may).groupBy("digest").agg(longest).select("r")).select("r.*")
