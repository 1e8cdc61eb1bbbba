"""Queries of entity building and provenance strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import entities as E
from hirelake.sources.domain import table, with_tables

from . import query


@query("repair_model_json", with_tables("SELECT id, role, CAST(rate_min AS INT) AS rate_min FROM specialists WHERE id % 3 <> 2", "specialists"))
def repair_model_json(spark, d):
    s = table(spark, d, "specialists")
    item = F.to_json(F.struct("role", "stack", "rate_min"))
    tail = F.when(F.col("id") % 3 == 0, "]}\n```").when(F.col("id") % 3 == 1, "")
    answer = F.when(F.col("id") % 3 == 2, "sorry").otherwise(F.concat(F.lit("```json\n{\"items\": ["), item, tail))
    return s.select("id", F.inline(E.model_items(answer))).select("id", "role", "rate_min")


@query("json_field_parse", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['a', CAST(event_id AS STRING)] ELSE [] END AS items FROM events")
def json_field_parse(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["a", "'), "event_id", F.lit('"]'))).otherwise("{bad")
    return table(spark, d, "events").select("event_id", E.json_list(text).alias("items"))


@query("parse_embedding", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [1.0::DOUBLE, CAST(user_id AS DOUBLE)] END AS vector FROM events")
def parse_embedding(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[1, "), "user_id", F.lit("]"))).otherwise("[1]")
    return table(spark, d, "events").select("event_id", E.embedding(text, 2).alias("vector"))


@query("sanitize_stack", with_tables("SELECT id, stack FROM specialists", "specialists"))
def sanitize_stack(spark, d):
    noisy = F.concat(F.array(F.concat(F.lit("Stack: "), F.array_join("stack", ", "))), F.transform("stack", lambda s: F.upper(s)), F.array(F.lit("https://x.example.com/cv"), F.lit(" ")))
    return table(spark, d, "specialists").select("id", E.sanitize_stack(noisy).alias("stack"))


@query("entity_status", with_tables("SELECT id, CASE WHEN status = 'hired' THEN 'hired' ELSE 'active' END AS status FROM specialists", "specialists"))
def entity_status(spark, d):
    return table(spark, d, "specialists").select("id", E.specialist_status(F.col("status") == "hired").alias("status"))


_PLACED = "SELECT *, CASE WHEN id % 5 < 2 THEN 'https://files.example.com/' || id END AS file, CASE id % 3 WHEN 0 THEN 'row:' || id WHEN 1 THEN 'title' END AS place, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 100 END AS nr, CASE WHEN id % 2 = 0 THEN 'archive_post' ELSE 'message' END AS kind, CASE WHEN id % 4 = 0 THEN 'Bench' END AS sheet, CAST(id % 6 AS INT) AS tab FROM sources"
_AT = "'; Индекс: ' || coalesce({} CAST(nr AS VARCHAR), '-')"


@query("source_display", with_tables(f"""SELECT id, 'Менеджер: ' || chat_title || CASE WHEN file IS NOT NULL THEN '; Ссылка на файл: ' || file || CASE WHEN sheet IS NULL THEN '' ELSE '; Лист: ' || sheet END || CASE WHEN tab = 0 THEN '' ELSE '; Таблица: ' || tab END || {_AT.format("CASE WHEN place LIKE 'row:%' THEN substr(place, 5) END,")}
 WHEN message_url IS NULL THEN '' WHEN kind = 'archive_post' THEN '; Ссылка на архив-пост: ' || message_url || {_AT.format("")} ELSE '; Ссылка на сообщение: ' || message_url END AS display FROM ({_PLACED}) s""", "sources"))
def source_display(spark, d):
    i = F.col("id")
    s = table(spark, d, "sources").select(
        "id", "chat_title", "message_url", F.when(i % 5 < 2, F.concat(F.lit("https://files.example.com/"), i)).alias("file"), F.when(i % 3 == 0, F.concat(F.lit("row:"), i)).when(i % 3 == 1, "title").alias("place"),
        F.when(i % 7 != 0, i % 100).alias("nr"), F.when(i % 2 == 0, "archive_post").otherwise("message").alias("kind"), F.when(i % 4 == 0, "Bench").alias("sheet"), (i % 6).alias("tab"),
    )
    return s.select("id", E.provenance("chat_title", "kind", "message_url", "file", "place", "nr", "sheet", "tab").alias("display"))


@query("parse_source_display", with_tables("SELECT id, chat_title AS chat, sender_name AS author, message_url AS url FROM sources", "sources"))
def parse_source_display(spark, d):
    s = table(spark, d, "sources")
    m = s.select("id", E.parse_source_display(E.source_display(chat=F.col("chat_title"), author=F.col("sender_name"), url=F.col("message_url"))).alias("m"))
    return m.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("chat", "author", "url")])
