"""Further queries: keyed merges, identity joins, summaries, set operations and rank views."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import matching as M
from hirelake.functions import text as T
from hirelake.operators import aggregates as A
from hirelake.operators import filters as L
from hirelake.operators import joins as J
from hirelake.operators import upserts as U
from hirelake.plans import matching as P
from hirelake.sources import files
from hirelake.sources.domain import AS_OF, table, with_tables

from . import query
from .matching import RANKED, features_sql

_NOW = f"TIMESTAMP '{AS_OF}'"


@query("upsert_specialists_touch", with_tables(f"SELECT synthetic_id, role, coalesce(is_internal, FALSE) OR id % 6 = 0 AS is_internal, CASE WHEN id % 3 = 0 THEN {_NOW} ELSE updated_at END AS updated_at FROM specialists", "specialists"))
def upsert_specialists_touch(spark, d):
    s = table(spark, d, "specialists").select("synthetic_id", "id", "role", "is_internal", "updated_at")
    batch = s.where("id % 3 = 0").select("synthetic_id", F.lit("X").alias("role"), F.expr("id % 6 = 0").alias("is_internal"))
    return U.touch_specialists(s, batch, AS_OF).select("synthetic_id", "role", "is_internal", "updated_at")


@query("upsert_internal", with_tables("SELECT synthetic_id, CASE WHEN id % 3 = 0 THEN 'X' ELSE role END AS role, is_internal OR id % 3 = 0 AS is_internal FROM specialists", "specialists"))
def upsert_internal(spark, d):
    s = table(spark, d, "specialists").select("synthetic_id", "id", "role", "is_internal", "created_at", "updated_at", "expires_at")
    batch = s.where("id % 3 = 0").select("synthetic_id", "id", F.lit("X").alias("role"), F.lit(None).cast("boolean").alias("is_internal"))
    return U.upsert_specialists(s, batch, AS_OF, internal=True).select("synthetic_id", "role", "is_internal")


@query("upsert_channels", with_tables("SELECT telegram_id, CASE WHEN telegram_id % 2 = 0 THEN title || '!' ELSE title END AS title, is_active OR telegram_id % 2 = 0 AS is_active, last_message_id FROM channels UNION ALL SELECT 1000 + telegram_id, title || '!', TRUE, 5 FROM channels WHERE telegram_id % 2 = 0", "channels"))
def upsert_channels(spark, d):
    c = table(spark, d, "channels").select("telegram_id", "title", "is_active", "last_message_id")
    even = c.where("telegram_id % 2 = 0").select("telegram_id", F.concat("title", F.lit("!")).alias("title"), F.lit(5).cast("long").alias("last_message_id"))
    return U.upsert_channels(c, even.unionByName(even.withColumn("telegram_id", F.col("telegram_id") + 1000)))


@query("upsert_archive_map", with_tables("SELECT channel_id AS original_chat_id, message_id AS original_message_id, CASE WHEN id % 4 = 1 THEN 'skipped' ELSE 'posted' END AS status, id AS archive_message_id, CASE WHEN id % 4 = 1 THEN NULL ELSE 'e' END AS last_error FROM sources", "sources"))
def upsert_archive_map(spark, d):
    s = table(spark, d, "sources")
    old = s.select(F.col("channel_id").alias("original_chat_id"), F.col("message_id").alias("original_message_id"), F.lit("posted").alias("status"), F.col("id").alias("archive_message_id"), F.lit("e").alias("last_error"))
    batch = s.where("id % 4 = 1").select(F.col("channel_id").alias("original_chat_id"), F.col("message_id").alias("original_message_id"), F.lit("skipped").alias("status"), F.lit(None).cast("long").alias("archive_message_id"), F.lit(None).cast("string").alias("last_error"))
    return U.upsert_archive_map(old, batch)


@query("upsert_registry_rows", with_tables("SELECT registry_key, specialist_id, CASE WHEN specialist_id % 2 = 0 THEN 'seen' ELSE raw_text END AS raw_text, is_active OR specialist_id % 2 = 0 AS is_active FROM registry", "registry"))
def upsert_registry_rows(spark, d):
    r = table(spark, d, "registry").select("registry_key", "specialist_id", "raw_text", "is_active")
    return U.upsert_registry(r, r.where("specialist_id % 2 = 0").select("registry_key", F.lit(None).cast("long").alias("specialist_id"), F.lit("seen").alias("raw_text")))


@query("upsert_settings", f"SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN c_custkey % 2 = 0 THEN {_NOW} END AS updated_at FROM customer")
def upsert_settings(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_name").alias("key"), F.lit("old").alias("value"), F.lit(None).cast("timestamp").alias("updated_at"))
    return U.upsert_settings(old, c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.lit("new").alias("value")), AS_OF)


@query("link_source_entity", with_tables("SELECT id, CASE WHEN id % 11 = 0 THEN 'linked' ELSE entity_type END AS entity_type, CASE WHEN id % 11 = 0 THEN id ELSE entity_id END AS entity_id FROM sources", "sources"))
def link_source_entity(spark, d):
    s = table(spark, d, "sources").select("id", "entity_type", "entity_id")
    return U.link_entities(s, s.where("id % 11 = 0").select(F.col("id").alias("source_id"), F.lit("linked").alias("entity_type"), F.col("id").alias("entity_id")))


@query("channel_identity", with_tables("SELECT o.n AS telegram_id, coalesce(c.source_kind, k.source_kind, 'chat') AS source_kind, coalesce(c.last_message_id, k.last_message_id, 0) AS last_message_id FROM (SELECT DISTINCT channel_id + 20 * (message_id % 2) AS n FROM raw_messages) o LEFT JOIN channels c ON c.telegram_id = o.n LEFT JOIN channels k ON k.telegram_id = o.n % 20", "raw_messages", "channels"))
def channel_identity(spark, d):
    seen = table(spark, d, "raw_messages").select((F.col("channel_id") + 20 * (F.col("message_id") % 2)).alias("telegram_id"), F.concat(F.lit("CHAN"), "channel_id").alias("username"))
    return J.channel_identity(seen, table(spark, d, "channels")).drop("username")


_ENRICHED = "SELECT c_custkey, string_agg('order ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS resume_text FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey AND n <= 8 GROUP BY c_custkey"


@query("resume_enrichment", _ENRICHED)
def resume_enrichment(spark, d):
    return resume_enrichment_whole(spark, d)


@query("resume_enrichment_whole", _ENRICHED)
def resume_enrichment_whole(spark, d):
    units = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("http://r/"), "c_custkey").alias("resume_url"))
    items = table(spark, d, "orders").select(F.concat(F.lit("http://r/"), "o_custkey").alias("resume_url"), F.col("o_orderkey").alias("position"), F.concat(F.lit("order "), "o_orderkey").alias("text"))
    return J.resume_enrichment(units, items).select("c_custkey", "resume_text")


@query("validated_links", "SELECT 'http://r/' || c_custkey AS url, n AS item_count FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def validated_links(spark, d):
    links = table(spark, d, "customer").select(F.concat(F.lit("http://r/"), "c_custkey").alias("url"))
    return J.validated_links(links, table(spark, d, "orders").select(F.concat(F.lit("http://r/"), "o_custkey").alias("url")))


@query("live_sheet_reference", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 7 WHEN c_custkey % 3 = 1 THEN 9 END AS row_index, CASE WHEN c_custkey % 3 = 0 THEN 100 WHEN c_custkey % 3 = 1 THEN 60 END AS score FROM customer")
def live_sheet_reference(spark, d):
    c = table(spark, d, "customer")
    name, url = F.concat(F.lit("Person "), "c_custkey"), F.concat(F.lit("http://cv/"), "c_custkey")
    none = F.lit(None).cast("string")
    people = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("sheet"), F.col("c_custkey") % 200).alias("source_url"), url.alias("resume_url"), name.alias("name"), F.lit("QA").alias("role"), F.lit("RF").alias("location"))
    rows = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("sheet"), F.col("c_custkey") % 200).alias("source_url"), F.lit(7).alias("row_index"), url.alias("resume_url"), none.alias("name"), none.alias("role"), none.alias("location"))
    rows = rows.unionByName(c.where("c_custkey % 3 = 1").select(F.concat(F.lit("sheet"), F.col("c_custkey") % 200).alias("source_url"), F.lit(9).alias("row_index"), none.alias("resume_url"), F.upper(name).alias("name"), F.lit("qa").alias("role"), none.alias("location")))
    return J.live_reference(people, rows)


@query("import_summary", "SELECT source AS run, count(*) FILTER (WHERE quality = 1) AS vacancies, CAST(0 AS BIGINT) AS specialists, count(*) FILTER (WHERE quality = 0) AS skipped, count(*) FILTER (WHERE quality IS NULL) AS unclassified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def import_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return A.import_summary(rows.select(F.col("source").alias("run"), F.when(F.col("quality") == 1, "VACANCY").when(F.col("quality") == 0, "OTHER").alias("kind")), "run")


@query("sync_stats", with_tables("SELECT count(*) AS rows, count(*) FILTER (WHERE specialist_id % 7 <> 0) AS saved, count(*) FILTER (WHERE specialist_id % 7 = 0) AS failed, count(*) FILTER (WHERE NOT is_active) AS deactivated, count(*) FILTER (WHERE is_active) AS active_rows FROM registry", "registry"))
def sync_stats(spark, d):
    return A.sync_stats(table(spark, d, "registry").withColumn("parse_status", F.when(F.col("specialist_id") % 7 == 0, "failed").otherwise("ok")))


@query("unprocessed_sources", with_tables("SELECT id FROM sources WHERE id % 5 = 0 AND length(raw_text) > 0", "sources"))
def unprocessed_sources(spark, d):
    s = table(spark, d, "sources").withColumn("entity_type", F.when(F.col("id") % 5 != 0, F.col("entity_type")))
    return L.unprocessed(s).select("id")


@query("settings_lookup", "SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'set' ELSE 'default' END AS value FROM customer")
def settings_lookup(spark, d):
    c = table(spark, d, "customer")
    return L.setting(c.select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "set").otherwise(" ").alias("value")), c.select(F.col("c_name").alias("key"), F.lit("default").alias("value")))


@query("threshold_filter", features_sql("SELECT vacancy_id, specialist_id, score FROM final WHERE score >= 0.5 AND rate_score > 0"))
def threshold_filter(spark, d):
    hits = P.every_match(table(spark, d, "vacancies"), table(spark, d, "specialists"), AS_OF, lambda scored: L.over_threshold(scored, rate_given=True))
    return hits.select("vacancy_id", "specialist_id", "score")


@query("topk_per_query_by_label", features_sql("SELECT vacancy_id, specialist_id, rank FROM (" + RANKED + ") t WHERE rank <= 10"))
def topk_per_query_by_label(spark, d):
    return P.rank_specialists(table(spark, d, "vacancies"), table(spark, d, "specialists"), AS_OF, k=10).select("vacancy_id", "specialist_id", "rank")


@query("has_internal", features_sql("SELECT vacancy_id, bool_or(inner_flag) AS has_internal FROM final GROUP BY 1"))
def has_internal(spark, d):
    return P.rank_summary(table(spark, d, "vacancies"), table(spark, d, "specialists"), AS_OF).select("vacancy_id", "has_internal")


@query("location_tokens", with_tables("SELECT id, list_filter(regexp_split_to_array(lower(location), '[\\s,;/|]+'), lambda x: x <> '') AS tokens FROM vacancies", "vacancies"))
def location_tokens(spark, d):
    return table(spark, d, "vacancies").select("id", M.location_tokens("location").alias("tokens"))


@query("work_formats", with_tables("SELECT id, list_concat(CASE WHEN location = 'Remote' THEN ['remote'] ELSE [] END, CASE WHEN location LIKE '%Hybrid' THEN ['hybrid'] ELSE [] END) AS formats FROM vacancies", "vacancies"))
def work_formats(spark, d):
    return table(spark, d, "vacancies").select("id", M.work_formats("location", "description", "original_text").alias("formats"))


@query("rate_anchor", with_tables("SELECT id, CAST(rate_min AS DOUBLE) AS anchor FROM specialists", "specialists"))
def rate_anchor(spark, d):
    return table(spark, d, "specialists").select("id", M.rate_anchor(None, "rate_min").alias("anchor"))


@query("labeled_value", with_tables("SELECT id, role AS role_value, location AS place FROM specialists", "specialists"))
def labeled_value(spark, d):
    text = F.concat(F.lit("Card\nRole :  "), "role", F.lit(" \nГород: "), "location")
    s = table(spark, d, "specialists").select("id", text.alias("t"))
    return s.select("id", T.labeled_value("t", "Роль", "Role").alias("role_value"), T.labeled_value("t", "Город", "Location").alias("place"))


@query("parse_kv_lines", with_tables("SELECT id, role AS role_value, 'b' AS last_value FROM specialists", "specialists"))
def parse_kv_lines(spark, d):
    s = table(spark, d, "specialists").select("id", T.parse_kv_lines(F.concat(F.lit("x: a\nRole: "), "role", F.lit("\nno pair\nX : b\n:\n"))).alias("m"))
    return s.select("id", F.col("m")["role"].alias("role_value"), F.col("m")["x"].alias("last_value"))


@query("export_all", with_tables("SELECT id, role, '[\"' || array_to_string(stack, '\",\"') || '\"]' AS stack, created_at FROM vacancies", "vacancies"))
def export_all(spark, d):
    return files.coerced(table(spark, d, "vacancies").select("id", "role", "stack", "created_at"))


@query("detect_file_kind", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'html' ELSE 'unsupported' END AS kind FROM pages")
def detect_file_kind(spark, d):
    p = F.col("page_id")
    return table(spark, d, "pages").select("page_id", files.file_kind(F.when(p % 3 == 0, "A.PDF").otherwise("b.bin"), F.when(p % 3 == 1, "text/html; charset=utf-8")).alias("kind"))


@query("union_hits", with_tables("SELECT id, max(sim) AS sim FROM (SELECT specialist_id AS id, similarity_score AS sim FROM matches UNION ALL SELECT specialist_id, 0.0 FROM registry WHERE is_active) t GROUP BY 1", "matches", "registry"))
def union_hits(spark, d):
    none = F.lit(None).cast("string")
    shape = lambda df, g: df.select("id", "sim", F.lit(g).cast("long").alias("group"), F.lit(False).alias("is_internal"), F.lit(g == 2).alias("is_own"), none.alias("source_url"), F.lit(1).alias("rate_min"), none.alias("location"))
    a = shape(table(spark, d, "matches").select(F.col("specialist_id").alias("id"), F.col("similarity_score").alias("sim")), 1)
    b = shape(table(spark, d, "registry").where("is_active").select(F.col("specialist_id").alias("id"), F.lit(0.0).alias("sim")), 2)
    return A.merge_hits(a.unionByName(b), ["id"]).select("id", "sim")
