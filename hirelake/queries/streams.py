"""The streaming duties over the whole tables: in their batch forms, and run as streams over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.session import scratch
from hirelake.sources import files
from hirelake.sources.domain import AS_OF, table, with_tables
from hirelake.sources.store import KeyedStore
from hirelake.streaming import jobs as S

from . import query


@query("window_digest", with_tables("SELECT date_trunc('day', message_date - INTERVAL 13 HOUR) + INTERVAL 13 HOUR AS day, channel_id, count(*) AS n FROM raw_messages WHERE message_date IS NOT NULL GROUP BY 1, 2", "raw_messages"))
def window_digest(spark, d):
    return S.digest_counts(table(spark, d, "raw_messages"))


@query("interval_bucket", "SELECT event_type, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def interval_bucket(spark, d):
    return table(spark, d, "events").groupBy("event_type", S.interval_bucket("ts", 240).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("backfill_messages", with_tables("""SELECT channel_id, message_id FROM (SELECT m.channel_id, m.message_id, row_number() OVER (PARTITION BY m.channel_id ORDER BY m.message_id DESC) AS n FROM raw_messages m JOIN channels c ON c.telegram_id = m.channel_id
 WHERE c.is_active AND m.message_id > coalesce(c.last_message_id, 0) AND m.message_date >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAY) t WHERE n <= 10""", "raw_messages", "channels"))
def backfill_messages(spark, d):
    return S.backfill(table(spark, d, "raw_messages"), table(spark, d, "channels"), "2024-01-10 00:00:00", 10).select("channel_id", "message_id")


@query("stream_dedupe", with_tables("SELECT DISTINCT channel_id, message_id FROM raw_messages WHERE message_date IS NOT NULL", "raw_messages"))
def stream_dedupe(spark, d):
    rows = table(spark, d, "raw_messages").where("message_date IS NOT NULL").select("channel_id", "message_id", F.lit("source").alias("source"))
    return rows.unionAll(rows).dropDuplicates(["channel_id", "message_id", "source"]).drop("source")


@query("stream_classify")
def stream_classify(spark, d):
    return S.classify(table(spark, d, "raw_messages")).select("channel_id", "message_id", "kind")


@query("stream_progress", with_tables("SELECT channel_id, max(message_id) AS last_message_id FROM raw_messages GROUP BY 1", "raw_messages"))
def stream_progress(spark, d):
    return S.progress(table(spark, d, "raw_messages").withColumn("source", F.lit("source")))


# ---- run as streams ----

_KEPT = ", ".join(x for x in S.MESSAGE.split(", ") if not x.startswith("source"))


def _messages(spark, d, **changed: str):
    """The stored messages in the columns of the stream, some of them by another expression."""
    m = table(spark, d, "raw_messages")
    kinds = dict(x.split(" ") for x in S.MESSAGE.split(", "))
    have = {c: f"`{c}`" for c in m.columns} | {"source": "'source'"} | changed
    return m.selectExpr(*[f"CAST({have.get(c, 'NULL')} AS {k}) AS {c}" for c, k in kinds.items()])


def _drained(stream, mark: str, run=None, out: str | None = None) -> None:
    """All that has come in so far goes through the stream, to a function or to a folder."""
    w = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True)
    q = w.foreachBatch(run).start() if run else w.format("parquet").option("path", out).start()
    q.awaitTermination()


@query("stream_messages", with_tables("SELECT channel_id, message_id, raw_text FROM raw_messages", "raw_messages"))
def stream_messages(spark, d):
    source, out, mark = (scratch(spark, n) for n in ("in", "out", "mark"))
    _messages(spark, d).write.json(source)
    _drained(S.read_messages(spark, source), mark, out=out)
    return spark.read.parquet(out).select("channel_id", "message_id", "raw_text")


@query("stream_dedupe_job", with_tables("SELECT channel_id, message_id, source FROM (SELECT DISTINCT channel_id, message_id FROM raw_messages WHERE message_date IS NOT NULL) m CROSS JOIN (VALUES ('source'), ('backfill')) s(source)", "raw_messages"))
def stream_dedupe_job(spark, d):
    source, out, mark = (scratch(spark, n) for n in ("in", "out", "mark"))
    rows = _messages(spark, d).where("message_date IS NOT NULL")
    rows.unionAll(rows).unionAll(_messages(spark, d, source="'backfill'").where("message_date IS NOT NULL")).write.parquet(source)
    _drained(S.dedupe(S.read_messages(spark, source, "parquet"), "1000 days"), mark, out=out)
    return spark.read.parquet(out).select("channel_id", "message_id", "source")


_EDITED = """SELECT channel_id, message_id, CASE WHEN message_id % 2 = 0 AND message_id % 3 <> 0 THEN 'edited{}' ELSE raw_text END AS raw_text, CASE WHEN message_id % 2 = 0 THEN message_date + INTERVAL {} DAY ELSE edited_at END AS edited_at, message_date,
 coalesce(has_attachment, FALSE) OR message_id % 2 = 0 AS has_attachment FROM raw_messages"""


def _edits(spark, d, days: int, text: str):
    even = {"raw_text": f"CASE WHEN message_id % 3 <> 0 THEN '{text}' END", "edited_at": f"message_date + INTERVAL {days} DAY", "has_attachment": "TRUE", "source": "'source_edit'"}
    return _messages(spark, d, **even).where("message_id % 2 = 0")


def _stored(spark, d, *later) -> KeyedStore:
    """The store after the messages and then each of the later batches went through one stream."""
    source, out, mark = (scratch(spark, n) for n in ("in", "store", "mark"))
    run = S.merge_into(out, _KEPT, 16)
    for rows in (_messages(spark, d), *later):
        rows.write.mode("append").parquet(source)
        _drained(S.read_messages(spark, source, "parquet"), mark, run)
    return KeyedStore(spark, out, _KEPT, ["channel_id", "message_id"])


@query("stream_raw_upsert", with_tables(_EDITED.format("", 1), "raw_messages"))
def stream_raw_upsert(spark, d):
    return _stored(spark, d, _edits(spark, d, 1, "edited")).read().select("channel_id", "message_id", "raw_text", "edited_at", "message_date", "has_attachment")


@query("late_edits", with_tables(_EDITED.format(" twice", 40), "raw_messages"))
def late_edits(spark, d):
    both = _edits(spark, d, 40, "edited twice").unionAll(_edits(spark, d, 1, "edited"))
    return _stored(spark, d, both).read().select("channel_id", "message_id", "raw_text", "edited_at", "message_date", "has_attachment")


@query("read_csv_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority || ', \"' || o_orderstatus || '\"' AS quoted, '' AS empty FROM orders")
def read_csv_rows(spark, d):
    folder = scratch(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("quoted"), F.lit(None).cast("string").alias("empty")).write.option("header", True).option("escape", '"').csv(folder)
    rows = files.read_sheet_rows(spark, folder, "csv").where("row_index > 0")
    return rows.select(*[F.col("cells")[n].alias(c) for n, c in enumerate(("key", "quoted", "empty"))])


@query("read_text_docs", "SELECT CAST(c_nationkey AS BIGINT) AS nation, string_agg(c_name, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY 1")
def read_text_docs(spark, d):
    folder = scratch(spark, "txt")
    c = table(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").option("maxRecordsPerFile", 0).text(folder)
    rows = files.read_text_docs(spark, folder)
    return rows.select(F.regexp_extract("file", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), F.regexp_replace("text", r"\s+$", "").alias("text"))


def _rebuilt_sql() -> str:
    from .retrieval import rebuild_sql

    return rebuild_sql


@query("incremental_match", _rebuilt_sql())
def incremental_match(spark, d):
    """Specialists come before and after the vacancies; the matches are those of a full rebuild."""
    v, s = table(spark, d, "vacancies"), table(spark, d, "specialists")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema if f.name in s.columns)
    both = [c for c in v.columns if c in s.columns]
    for name in ("rate_max", "rate_min", "is_internal"):
        if name not in both:
            both.append(name)
            schema += f", {name} {'boolean' if name == 'is_internal' else 'int'}"
    shape = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in both])
    m = S.Matching(spark, scratch(spark, "matching"), schema, table(spark, d, "registry"), AS_OF, 50, 20, buckets=16)
    m.specialists(shape(s).where("id % 3 <> 0"), 0)
    m.vacancies(shape(v), 1)
    m.specialists(shape(s).where("id % 3 = 0"), 2)
    return m.read().select("vacancy_id", "specialist_id", F.col("score").alias("similarity_score"), "rank")
