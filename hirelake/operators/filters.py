"""Filters and list views over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions.matching import MATCH_THRESHOLD
from hirelake.session import cut


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def active(entities: DataFrame, as_of: str) -> DataFrame:
    return entities.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > _at(as_of))))


def embedded_active(entities: DataFrame, as_of: str) -> DataFrame:
    return active(entities, as_of).where(F.col("embedding").isNotNull())


def newest(df: DataFrame, by: str, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by), F.desc(tie)).offset(offset).limit(limit)


def visible(entities: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return newest(entities.where(F.col("status") != "hidden"), "updated_at", limit, offset)


def bench_scope(specialists: DataFrame, scope: str) -> DataFrame:
    inner = F.coalesce(F.col("is_internal"), F.lit(False))
    return {"own": specialists.where(inner), "partner": specialists.where(~inner)}.get(scope, specialists)


def lexical_search(entities: DataFrame, queries: DataFrame, k: int, as_of: str) -> DataFrame:
    """query_id, id, sim, rank: for each (query_id, query) the newest k active entities that have its first 80 characters as a LIKE pattern.

    A query meets the entities at the rarest trigram of its longest part without wildcards, by an equi-join, and is then matched as a whole; queries
    without such a part of three characters are compared with all entities."""
    from .joins import trigrams

    pattern = F.concat(F.lit("%"), F.lower(F.substring("query", 1, 80)), F.lit("%"))
    q = queries.select("query_id", pattern.alias("pattern"))
    part = F.array_max(F.transform(F.split("pattern", "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    q = q.withColumn("_part", part)
    hit = F.expr(" OR ".join(f"lower(coalesce({c}, '')) LIKE pattern" for c in ("role", "description", "original_text")))
    rows = active(entities, as_of).select("id", "updated_at", "role", "description", "original_text")
    # only the trigrams that some query asks for leave the scan
    asked = cut(q.where(F.length("_part") >= 3).select(F.explode(trigrams(F.col("_part"))).alias("_gram")).distinct())
    asked = F.broadcast(asked) if asked.limit(100_001).count() <= 100_000 else asked
    grams = rows.select("id", F.explode(trigrams(F.lower(F.concat_ws("\n", "role", "description", "original_text")))).alias("_gram")).join(asked, "_gram", "left_semi")
    count = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = q.where(F.length("_part") >= 3).select("query_id", "pattern", F.explode(trigrams(F.col("_part"))).alias("_gram")).join(count, "_gram", "left")
    rarest = own.groupBy("query_id", "pattern").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    found = grams.join(rarest, "_gram").select("id", "query_id", "pattern").join(rows, "id").where(hit).select("id", "updated_at", "query_id")
    odd = q.where(F.length("_part") < 3).drop("_part")
    if odd.limit(1).count():
        found = found.unionByName(rows.join(F.broadcast(odd) if odd.limit(10_001).count() <= 10_000 else odd, hit).select("id", "updated_at", "query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", F.lit(0.0).alias("sim"), "rank")


def optional(df: DataFrame, limit: int, by: str = "created_at", **equal: object) -> DataFrame:
    """Only the given predicates count; newest first."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return newest(df, by, limit)


def inbox(messages: DataFrame, limit: int) -> DataFrame:
    text = F.coalesce("raw_text", F.lit(""))
    return (
        messages.select(
            "channel_id", "message_id", F.coalesce("chat_title", "chat_username", F.col("channel_id").cast("string"), F.lit("-")).alias("source"),
            F.coalesce("sender_name", F.lit("-")).alias("author"), F.left(text, F.lit(500)).alias("preview"),
            F.when(F.trim(text) == "", "empty").otherwise("received").alias("status"), F.coalesce("message_date", "created_at").alias("received_at"),
        )
        .orderBy(F.desc("received_at"), F.desc("message_id"))
        .limit(max(1, min(500, limit)))
    )


def logs(events: DataFrame, limit: int) -> DataFrame:
    duration = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("duration_ms", "duration", "latency_ms")], F.lit("—"))
    rows = events.select(F.coalesce("kind", F.lit("event")).alias("status"), F.coalesce(F.col("user_id").cast("string"), F.lit("system")).alias("actor"), "id", duration.alias("duration"), "created_at")
    return newest(rows, "created_at", limit)


def unprocessed(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("entity_type").isNull() & (F.length("raw_text") > 0)).orderBy("created_at", "id")


def active_channels(channels: DataFrame, kind: str | None = None) -> DataFrame:
    out = channels.where("is_active").select("telegram_id", "title", F.ltrim(F.col("username"), F.lit("@")).alias("username"), F.coalesce("source_kind", F.lit("chat")).alias("source_kind"), "added_at")
    return (out.where(F.col("source_kind") == kind) if kind else out).orderBy("added_at", "telegram_id")


def full_text(df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose lower-cased JSON has every term."""
    hay = F.lower(F.to_json(F.struct("*")))
    for t in terms:
        same = ("ok", "ок") if t.lower() in ("ok", "ок") else (t.lower(),)
        df = df.where(reduce(lambda a, b: a | b, [F.contains(hay, F.lit(s)) for s in same]))
    return df


def over_threshold(hits: DataFrame, rate_given: bool = False, least: float = MATCH_THRESHOLD) -> DataFrame:
    out = hits.where(F.col("score") >= least)
    return out.where(F.col("rate_score") > 0) if rate_given else out


def setting_forms(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value, items, entries: the stored value if not blank, else the environment's, else the default (columns env and value of defaults); read as a JSON
    list and as a JSON object of texts too, blanks dropped, an object's entries by key."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = defaults.select("key", full("env").alias("_env"), F.col("value").alias("_default"))
    rows = d.join(settings.select("key", full("value").alias("_stored")), "key", "left").select("key", F.coalesce("_stored", "_env", "_default").alias("value"))
    items = F.filter(F.transform(F.from_json("value", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.filter(F.array_sort(F.map_entries(F.from_json("value", "map<string,string>"))), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    none = F.array().cast("array<string>")
    return rows.select("key", "value", F.coalesce(items, none).alias("items"), F.coalesce(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.trim(e["value"]))), none).alias("entries"))


def setting(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value: the stored value if not blank, else the default."""
    d = defaults.select("key", F.col("value").alias("default"))
    return d.join(settings.select("key", F.nullif(F.trim("value"), F.lit("")).alias("stored")), "key", "left").select("key", F.coalesce("stored", "default").alias("value"))
