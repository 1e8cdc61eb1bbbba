"""Ingestion units: what a message, a link, a file or a pasted text is cut into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.matching import strip
from hirelake.functions.text import with_bench_lines
from hirelake.session import spread

#: Items of these kinds are rows of tables and stay whole.
TABLES = ("google_sheet", "direct_csv", "direct_xlsx")
UNIT = ("text", "source_type", "external_url", "external_kind", "external_locator")


def external_text(text: Column, url: Column, kind: Column, row: Column, base: Column | None = None) -> Column:
    """An item's text under a head that tells where it is from; below the message's own text, if there is any."""
    head = F.concat(F.lit("External source kind: "), kind, F.lit("\nExternal source URL: "), url, F.lit("\n"), F.coalesce(F.concat(F.lit("Row: "), row.cast("string"), F.lit("\n")), F.lit("")), F.lit("\n"))
    part = strip(F.concat(head, strip(text)))
    if base is None:
        return part
    own = strip(F.coalesce(base, F.lit("")))
    return F.when(own == "", part).otherwise(F.concat(own, F.lit("\n\n---\n"), part))


def expand_items(items: DataFrame, key: str) -> DataFrame:
    """items (key, item, kind, url, text, row_index) as units: lists of cards in other than tables are cut into lines, which count on from the item's row;
    other items are one unit. Adds local (place within the item) and the columns of UNIT."""
    own = items.select(key, "item", "kind", "url", "text", "row_index")
    table = F.coalesce(F.col("kind").isin(*TABLES), F.lit(False))
    cut_up = with_bench_lines(spread(own.where(~table)), "text", "_cards").select(*own.columns, F.explode_outer("_cards").alias("_u"))
    rows = cut_up.unionByName(own.where(table).withColumn("_u", F.lit(None).cast(cut_up.schema["_u"].dataType)))
    rows = rows.select("*", F.col("_u.idx").alias("_idx"), F.col("_u.text").alias("_line"))
    row = F.when(F.col("_idx").isNull(), F.col("row_index")).otherwise(F.coalesce(F.col("row_index") + F.col("_idx") - 1, F.col("_idx")))
    rows = rows.select(key, "item", F.coalesce("_idx", F.lit(0)).alias("local"), F.coalesce("_line", "text").alias("_t"), "url", "kind", row.alias("_row"))
    return rows.select(
        key, "item", "local", external_text(F.col("_t"), F.col("url"), F.col("kind"), F.col("_row")).alias("text"), F.lit("external_link").alias("source_type"), F.col("url").alias("external_url"),
        F.col("kind").alias("external_kind"), F.concat(F.lit("row:"), F.col("_row").cast("string")).alias("external_locator"),
    )


def text_units(texts: DataFrame, key: str, whole: str = "telegram_message", split: str = "telegram_line_split") -> DataFrame:
    """(key, text) as units: the lines of a list of cards, else the text itself."""
    rows = with_bench_lines(spread(texts.select(key, "text")), "text", "_cards").select("*", F.explode_outer("_cards").alias("_u"))
    rows = rows.select(key, "text", F.col("_u.idx").alias("_idx"), F.col("_u.text").alias("_line"))
    one, none = F.col("_idx").isNull(), F.lit(None).cast("string")
    return rows.select(
        key, F.lit(0).alias("item"), F.coalesce("_idx", F.lit(0)).alias("local"), F.coalesce("_line", "text").alias("text"), F.when(one, whole).otherwise(split).alias("source_type"),
        none.alias("external_url"), none.alias("external_kind"), F.concat(F.lit("line:"), F.col("_idx").cast("string")).alias("external_locator"),
    )


def message_units(messages: DataFrame, linked: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """The units of each message (key, text): of its links' items if there are any, else of its attachment's, else of its text; blank texts give none.

    linked and attached: items as in expand_items. Each step takes the messages that the one before has left over."""
    first = expand_items(linked, key)
    rest = attached.join(first.select(key).distinct(), key, "left_anti")
    second = expand_items(rest, key).withColumn("source_type", F.lit("telegram_attachment"))
    third = messages.where(strip(F.coalesce("text", F.lit(""))) != "").join(first.select(key).unionAll(second.select(key)).distinct(), key, "left_anti")
    return first.unionByName(second).unionByName(text_units(third.select(key, "text"), key))


def numbered(units: DataFrame, key: str) -> DataFrame:
    """units with unit_no from 1 on within their message, by item and line."""
    from pyspark.sql import Window

    return units.withColumn("unit_no", F.row_number().over(Window.partitionBy(key).orderBy("item", "local")))


def trace_id(message_id: Column, unit: Column, item: Column) -> Column:
    """The number that a trace row is stored under, as older rows have it; new rows are keyed by (channel, message, unit, item), which cannot collide."""
    return message_id * 1000 + unit * 1000 + item
