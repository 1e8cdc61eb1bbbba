"""Queries of filters, joins, counts, windows and merges over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import aggregates as A
from hirelake.operators import filters as L
from hirelake.operators import joins as J
from hirelake.operators import retrieve as R
from hirelake.operators import upserts as U
from hirelake.sources.domain import AS_OF, table, with_tables

from . import query

_NOW = f"TIMESTAMP '{AS_OF}'"
_ACTIVE = f"status = 'active' AND (expires_at IS NULL OR expires_at > {_NOW})"


@query("read_entities", with_tables("SELECT id, role, grade, status, rate_max, location FROM vacancies", "vacancies"))
def read_entities(spark, d):
    return table(spark, d, "vacancies").select("id", "role", "grade", "status", "rate_max", "location")


@query("active_entities", with_tables(f"SELECT id, role, created_at FROM specialists WHERE {_ACTIVE}", "specialists"))
def active_entities(spark, d):
    return L.active(table(spark, d, "specialists"), AS_OF).select("id", "role", "created_at")


@query("embedded_active", with_tables(f"SELECT id FROM specialists WHERE {_ACTIVE} AND embedding IS NOT NULL", "specialists"))
def embedded_active(spark, d):
    return L.embedded_active(table(spark, d, "specialists"), AS_OF).select("id")


@query("list_vacancies", with_tables("SELECT id, role, updated_at FROM vacancies WHERE status <> 'hidden' ORDER BY updated_at DESC, id DESC LIMIT 50", "vacancies"))
def list_vacancies(spark, d):
    return L.visible(table(spark, d, "vacancies"), 50).select("id", "role", "updated_at")


@query("list_specialists", with_tables("SELECT id, role, updated_at FROM specialists WHERE status <> 'hidden' AND NOT is_internal ORDER BY updated_at DESC, id DESC LIMIT 100 OFFSET 20", "specialists"))
def list_specialists(spark, d):
    return L.visible(L.bench_scope(table(spark, d, "specialists"), "partner"), 100, 20).select("id", "role", "updated_at")


@query("bench_scope", with_tables("SELECT id FROM specialists WHERE is_internal", "specialists"))
def bench_scope(spark, d):
    return L.bench_scope(table(spark, d, "specialists"), "own").select("id")


@query("entity_detail", with_tables("""SELECT s.id AS source_id, s.message_url, v.id, v.role FROM vacancies v LEFT JOIN sources s ON s.entity_type = 'vacancy' AND s.entity_id = v.id WHERE v.id = 7""", "vacancies", "sources"))
def entity_detail(spark, d):
    s = table(spark, d, "sources").where("entity_type = 'vacancy'").select(F.col("id").alias("source_id"), "message_url", F.col("entity_id").alias("_e"))
    v = table(spark, d, "vacancies").where("id = 7").select("id", "role")
    return v.join(s, F.col("id") == F.col("_e"), "left").select("source_id", "message_url", "id", "role")


@query("lexical_search", with_tables(f"""SELECT query_id, id, 0.0::DOUBLE AS sim, CAST(rank AS INT) AS rank FROM (SELECT q.query_id, s.id, row_number() OVER (PARTITION BY q.query_id ORDER BY updated_at DESC, s.id DESC) AS rank
 FROM specialists s JOIN (SELECT n_nationkey AS query_id, lower(left(CASE WHEN n_nationkey % 2 = 0 THEN 'python' ELSE 'customer#00000' || n_nationkey END, 80)) AS q FROM nation) q
 ON (lower(role) LIKE '%' || q || '%' OR lower(coalesce(description, '')) LIKE '%' || q || '%' OR lower(original_text) LIKE '%' || q || '%') WHERE {_ACTIVE}) t WHERE rank <= 20""", "specialists"))
def lexical_search(spark, d):
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, "python").otherwise(F.concat(F.lit("customer#00000"), F.col("n_nationkey").cast("string"))).alias("query"))
    return L.lexical_search(table(spark, d, "specialists"), q, 20, AS_OF)


@query("filter_jobs", with_tables("SELECT id, kind, status, created_at FROM jobs WHERE status = 'failed' AND kind = 'error' ORDER BY created_at DESC, id DESC LIMIT 200", "jobs"))
def filter_jobs(spark, d):
    return L.optional(table(spark, d, "jobs"), 200, status="failed", kind="error").select("id", "kind", "status", "created_at")


@query("inbox_view", with_tables("""SELECT channel_id, message_id, coalesce(chat_title, chat_username, CAST(channel_id AS STRING), '-') AS source, coalesce(sender_name, '-') AS author, left(coalesce(raw_text, ''), 500) AS preview,
 CASE WHEN trim(coalesce(raw_text, '')) = '' THEN 'empty' ELSE 'received' END AS status, coalesce(message_date, created_at) AS received_at FROM raw_messages ORDER BY received_at DESC, message_id DESC LIMIT 300""", "raw_messages"))
def inbox_view(spark, d):
    return L.inbox(table(spark, d, "raw_messages"), 300)


@query("logs_view", with_tables("SELECT kind AS status, coalesce(CAST(user_id AS STRING), 'system') AS actor, id, '—' AS duration, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 500", "jobs"))
def logs_view(spark, d):
    return L.logs(table(spark, d, "jobs"), 500)


@query("active_channels", with_tables("SELECT telegram_id, title, ltrim(username, '@') AS username, coalesce(source_kind, 'chat') AS source_kind, added_at FROM channels WHERE is_active", "channels"))
def active_channels(spark, d):
    return L.active_channels(table(spark, d, "channels"))


@query("full_text_filter", with_tables("SELECT id FROM vacancies WHERE lower(role) LIKE '%developer%' AND lower(location) LIKE '%moscow%'", "vacancies"))
def full_text_filter(spark, d):
    return L.full_text(table(spark, d, "vacancies").select("id", "role", "location"), ["developer", "moscow"]).select("id")


_LAST = "(SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY created_at DESC, id DESC) AS n FROM sources) t WHERE n = 1"


@query("latest_source", with_tables(f"SELECT entity_type, entity_id, message_url, coalesce(source_meta->>'$.source_display', message_url, external_url) AS source_display, chat_title, sender_name FROM {_LAST}", "sources"))
def latest_source(spark, d):
    return J.latest_source(table(spark, d, "sources"))


@query("latest_source_url", with_tables(f"""SELECT a.entity_type, a.entity_id, a.source_url, b.message_url FROM (SELECT entity_type, entity_id, coalesce(external_url, message_url) AS source_url FROM {_LAST}) a LEFT JOIN
 (SELECT entity_type, entity_id, arg_max(message_url, created_at + CAST(id AS INT) * INTERVAL '1' MICROSECOND) AS message_url FROM sources WHERE message_url IS NOT NULL GROUP BY 1, 2) b USING (entity_type, entity_id)""", "sources"))
def latest_source_url(spark, d):
    return J.latest_source_url(table(spark, d, "sources"))


@query("own_bench_flag", with_tables("SELECT id, EXISTS (SELECT 1 FROM registry r WHERE r.specialist_id = s.id AND r.is_active AND r.source_url = 'https://docs.google.com/spreadsheets/d/own1') AS is_own_bench_source FROM specialists s", "specialists", "registry"))
def own_bench_flag(spark, d):
    return J.own_bench(table(spark, d, "specialists"), table(spark, d, "registry"), "https://docs.google.com/spreadsheets/d/own1").select("id", "is_own_bench_source")


@query("import_candidates", with_tables("""SELECT channel_id, message_id, message_date FROM raw_messages m WHERE EXISTS (SELECT 1 FROM channels c WHERE c.telegram_id = m.channel_id AND c.is_active AND c.source_kind = 'vacancy')
 AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.entity_type = 'vacancy' AND s.channel_id = m.channel_id AND s.message_id = m.message_id) ORDER BY message_date DESC NULLS LAST, created_at DESC, message_id DESC LIMIT 200""", "raw_messages", "channels", "sources"))
def import_candidates(spark, d):
    return J.import_candidates(*[table(spark, d, t) for t in ("raw_messages", "channels", "sources")], 200).select("channel_id", "message_id", "message_date")


@query("sources_with_owner", with_tables("SELECT s.id, s.entity_id, coalesce(p.is_internal, FALSE) AS is_internal FROM sources s LEFT JOIN specialists p ON p.id = s.entity_id WHERE s.entity_type = 'specialist'", "sources", "specialists"))
def sources_with_owner(spark, d):
    return J.sources_with_owner(table(spark, d, "sources"), table(spark, d, "specialists")).select("id", "entity_id", "is_internal")


@query("orphan_specialists", with_tables("""SELECT id FROM specialists s WHERE status <> 'hidden' AND NOT EXISTS (SELECT 1 FROM sources o WHERE o.entity_type = 'specialist' AND o.entity_id = s.id)
 AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.is_active AND r.specialist_id = s.id)""", "specialists", "sources", "registry"))
def orphan_specialists(spark, d):
    return J.orphans(*[table(spark, d, t) for t in ("specialists", "sources", "registry")]).select("id")


@query("unbound_internal", with_tables("SELECT id, FALSE AS is_internal, CASE WHEN status = 'active' THEN 'hidden' ELSE status END AS status FROM specialists s WHERE is_internal AND NOT EXISTS (SELECT 1 FROM registry r WHERE r.is_active AND r.specialist_id = s.id)", "specialists", "registry"))
def unbound_internal(spark, d):
    s = table(spark, d, "specialists")
    return J.unbound(s, table(spark, d, "registry"), s.where("is_internal").select("id")).select("id", "is_internal", "status")


@query("export_active_sources", with_tables("""SELECT s.id, s.entity_type, s.entity_id FROM sources s LEFT JOIN vacancies v ON s.entity_type = 'vacancy' AND v.id = s.entity_id LEFT JOIN specialists p ON s.entity_type = 'specialist' AND p.id = s.entity_id
 WHERE v.status = 'active' OR p.status = 'active'""", "sources", "vacancies", "specialists"))
def export_active_sources(spark, d):
    return J.active_sources(*[table(spark, d, t) for t in ("sources", "vacancies", "specialists")]).select("id", "entity_type", "entity_id")


@query("export_active_matches", with_tables("SELECT m.vacancy_id, m.specialist_id, m.similarity_score, m.rank FROM matches m JOIN vacancies v ON v.id = m.vacancy_id JOIN specialists s ON s.id = m.specialist_id WHERE v.status = 'active' AND s.status = 'active'", "matches", "vacancies", "specialists"))
def export_active_matches(spark, d):
    return J.active_matches(*[table(spark, d, t) for t in ("matches", "vacancies", "specialists")]).select("vacancy_id", "specialist_id", "similarity_score", "rank")


@query("partner_mention", "SELECT doc_id, CASE WHEN contains(lower(text), 'ing') THEN 'ing' WHEN contains(lower(text), 'ción') THEN 'ción' WHEN contains(lower(text), 'heit') THEN 'heit' WHEN contains(lower(text), 'eau') THEN 'eau' END AS partner FROM documents")
def partner_mention(spark, d):
    names = spark.createDataFrame([("ing", 9), ("ción", 8), ("heit", 7), ("eau", 6), ("never", 0)], "canonical_name string, mentions_count long")
    return J.partner_mention(table(spark, d, "documents"), names, "doc_id", "text")


@query("registry_binding", with_tables("""SELECT o.o_orderkey, coalesce(k.specialist_id, p.specialist_id) AS bound_id FROM orders o LEFT JOIN registry k ON k.registry_key = 'key' || o.o_custkey
 LEFT JOIN (SELECT identity_key, arg_min(specialist_id, registry_key) AS specialist_id FROM registry GROUP BY 1) p ON p.identity_key = 'person' || (o.o_custkey % 400)""", "registry"))
def registry_binding(spark, d):
    c = F.col("o_custkey")
    seen = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("key"), c).alias("registry_key"), F.concat(F.lit("person"), c % 400).alias("identity_key"))
    return J.registry_binding(seen, table(spark, d, "registry")).select("o_orderkey", "bound_id")


@query("result_links", with_tables("SELECT s.id, coalesce(s.external_url, 'https://t.me/c/x/' || s.id) AS source_url FROM sources s", "sources"))
def result_links(spark, d):
    s = table(spark, d, "sources")
    return J.result_links(s.select("id", F.col("external_url").alias("source_url")), s.select("id", F.concat(F.lit("https://t.me/c/x/"), F.col("id")).alias("url"))).select("id", "source_url")


@query("find_by_source_url", with_tables("SELECT id, external_url FROM sources WHERE external_url = 'https://docs.google.com/spreadsheets/d/s7' ORDER BY created_at DESC, id DESC LIMIT 100", "sources"))
def find_by_source_url(spark, d):
    return J.find_by_url(table(spark, d, "sources"), "https://docs.google.com/spreadsheets/d/s7").select("id", "external_url")


@query("job_status_counts", with_tables("SELECT status, count(*) AS n FROM jobs GROUP BY status", "jobs"))
def job_status_counts(spark, d):
    return A.job_status_counts(table(spark, d, "jobs"))


@query("overview_counts", with_tables("SELECT (SELECT count(*) FROM vacancies) AS n_vacancies, (SELECT count(*) FROM specialists) AS n_specialists, (SELECT count(*) FROM sources) AS n_sources, (SELECT count(*) FROM matches) AS n_matches", "vacancies", "specialists", "sources", "matches"))
def overview_counts(spark, d):
    return A.overview(**{t: table(spark, d, t) for t in ("vacancies", "specialists", "sources", "matches")})


@query("recent_imports", with_tables("""SELECT source_type, external_kind, external_url, count(*) AS n, max(created_at) AS last_at FROM sources WHERE external_url IS NOT NULL OR source_type IN ('external_url', 'file', 'google_sheet', 'manual')
 GROUP BY 1, 2, 3 ORDER BY last_at DESC, source_type NULLS FIRST, external_url NULLS FIRST LIMIT 50""", "sources"))
def recent_imports(spark, d):
    return A.recent_imports(table(spark, d, "sources"), 50)


@query("active_bindings", with_tables("SELECT source_url, count(*) AS n FROM registry WHERE is_active GROUP BY 1", "registry"))
def active_bindings(spark, d):
    return A.active_bindings(table(spark, d, "registry"), "source_url")


@query("match_scope_counts", with_tables("SELECT vacancy_id, count(*) AS total, count(*) FILTER (WHERE is_internal) AS own, count(*) FILTER (WHERE NOT is_internal) AS partner FROM matches JOIN specialists s ON s.id = specialist_id GROUP BY 1", "matches", "specialists"))
def match_scope_counts(spark, d):
    return A.scope_counts(table(spark, d, "matches"), table(spark, d, "specialists"))


@query("bucket_topk", with_tables("""SELECT vacancy_id, specialist_id, is_internal, CAST(position AS INT) AS position FROM (SELECT vacancy_id, specialist_id, is_internal, row_number() OVER (PARTITION BY vacancy_id, is_internal ORDER BY similarity_score DESC, specialist_id) AS position
 FROM matches JOIN specialists s ON s.id = specialist_id) t WHERE position <= 3""", "matches", "specialists"))
def bucket_topk(spark, d):
    rows = table(spark, d, "matches").join(table(spark, d, "specialists").select(F.col("id").alias("specialist_id"), "is_internal"), "specialist_id")
    return A.bucket_topk(rows, "vacancy_id", "is_internal", [F.desc("similarity_score"), F.asc("specialist_id")], 3).select("vacancy_id", "specialist_id", "is_internal", "position")


@query("dedupe_keep_first", with_tables("SELECT external_url, min(id) AS id FROM sources WHERE external_url IS NOT NULL GROUP BY 1", "sources"))
def dedupe_keep_first(spark, d):
    return A.keep_first(table(spark, d, "sources").where("external_url IS NOT NULL").select("external_url", "id"), ["external_url"], ["id"])


@query("paginate", with_tables("SELECT id, CAST(position AS INT) AS position, 3 AS page, CAST(pages AS INT) AS pages FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS position, ceil(count(*) OVER () / 10) AS pages FROM specialists) t WHERE position BETWEEN 21 AND 30", "specialists"))
def paginate(spark, d):
    return A.paginate(table(spark, d, "specialists").select("id", "updated_at"), [F.desc("updated_at"), F.asc("id")], 3, 10).select("id", "position", "page", "pages")


def _section(kind: str, rows: str) -> str:
    start = "TIMESTAMP '2024-02-02 13:00:00' - INTERVAL 24 HOUR"
    inside = lambda c: f"{c} >= {start} AND {c} < TIMESTAMP '2024-02-02 13:00:00'"
    new = f"SELECT 'new_{kind}' AS section, '{kind}' AS entity_type, id, role, created_at AS moment FROM {rows} WHERE status <> 'hidden' AND {inside('created_at')}"
    old = f"SELECT 'updated_{kind}', '{kind}', id, role, updated_at FROM {rows} WHERE status <> 'hidden' AND {inside('updated_at')} AND created_at < {start} AND updated_at > created_at"
    return f"{new} UNION ALL {old}"


@query("digest_sections", with_tables(f"""SELECT section, t.id, role, moment, l.message_url, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY moment DESC, id DESC) AS position FROM ({_section('vacancy', 'vacancies')} UNION ALL {_section('specialist', 'specialists')}) u) t
 LEFT JOIN (SELECT entity_type, entity_id, arg_max(message_url, created_at + CAST(id AS INT) * INTERVAL '1' MICROSECOND) AS message_url FROM sources WHERE message_url IS NOT NULL GROUP BY 1, 2) l ON l.entity_type = t.entity_type AND l.entity_id = t.id WHERE position <= 20""", "vacancies", "specialists", "sources"))
def digest_sections(spark, d):
    return A.digest_sections(*[table(spark, d, t) for t in ("vacancies", "specialists", "sources")], end="2024-02-02 13:00:00")


@query("vector_topk", """SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, greatest(0.0, least(1.0, round(sim, 6))) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM
 (SELECT q.vec_id AS query_id, t.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS sim FROM embeddings q CROSS JOIN embeddings t WHERE q.vec_id % 20 = 0) p) r WHERE rank <= 10""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_topk(e.where("vec_id % 20 = 0"), e, 10, id="vec_id").withColumn("sim", F.round("sim", 6))  # the stated query set against all rows


@query("vector_topk_whole", """SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, greatest(0.0, least(1.0, round(sim, 6))) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM
 (SELECT q.vec_id AS query_id, t.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS sim FROM embeddings q CROSS JOIN embeddings t WHERE q.vec_id % 20 = 0) p) r WHERE rank <= 20""")
def vector_topk_whole(spark, d):
    e = table(spark, d, "embeddings")
    return R.vector_topk(e.where("vec_id % 20 = 0"), e, 20, id="vec_id").withColumn("sim", F.round("sim", 6))


@query("neighbour_join", """SELECT query_id, id, sim, CAST(rank AS INT) AS rank FROM (SELECT query_id, id, greatest(0.0, least(1.0, round(sim, 6))) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM
 (SELECT q.vec_id AS query_id, t.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS sim FROM embeddings q CROSS JOIN embeddings t WHERE q.vec_id % 20 = 0) p) r WHERE rank <= 20""")
def neighbour_join(spark, d):
    e = table(spark, d, "embeddings")
    return R.neighbour_join(e.where("vec_id % 20 = 0"), e, 20, id="vec_id").withColumn("sim", F.round("sim", 6))


_HIT = "CAST(o_custkey % 300 AS BIGINT) AS id, CAST(o_orderkey % 97 AS DOUBLE) / 97 AS sim, o_orderkey AS nr"


@query("merge_hits", f"SELECT id, max(sim) AS sim, bool_or(nr % 3 = 0) AS is_internal, bool_or(nr % 11 = 0) AS is_own, arg_min(CASE WHEN nr % 5 = 0 THEN NULL ELSE 'u' || nr END, nr) FILTER (WHERE nr % 5 <> 0) AS source_url FROM (SELECT {_HIT} FROM orders) h GROUP BY id")
def merge_hits(spark, d):
    h = table(spark, d, "orders").selectExpr("CAST(o_custkey % 300 AS BIGINT) AS id", "CAST(o_orderkey % 97 AS DOUBLE) / 97 AS sim", "o_orderkey AS group", "o_orderkey % 3 = 0 AS is_internal", "o_orderkey % 11 = 0 AS is_own", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('u', o_orderkey) END AS source_url", "1 AS rate_min", "'x' AS location")
    return A.merge_hits(h, ["id"]).drop("rate_min", "location")


# ---- merges: the batch is a changed part of the table with some new keys ----

@query("upsert_vacancies", with_tables(f"""SELECT coalesce(o.synthetic_id, n.synthetic_id) AS synthetic_id, coalesce(o.role, n.role) AS role, CASE WHEN n.synthetic_id IS NOT NULL THEN {_NOW} ELSE o.updated_at END AS updated_at,
 CASE WHEN o.synthetic_id IS NULL THEN {_NOW} + INTERVAL 30 DAY ELSE o.expires_at END AS expires_at FROM vacancies o FULL JOIN (SELECT CASE WHEN id % 2 = 0 THEN synthetic_id ELSE 'n' || id END AS synthetic_id, role || ' X' AS role FROM vacancies WHERE id % 3 = 0) n ON o.synthetic_id = n.synthetic_id""", "vacancies"))
def upsert_vacancies(spark, d):
    v = table(spark, d, "vacancies").select("synthetic_id", "id", "role", "created_at", "updated_at", "expires_at")
    batch = v.where("id % 3 = 0").select(F.expr("CASE WHEN id % 2 = 0 THEN synthetic_id ELSE concat('n', id) END").alias("synthetic_id"), "id", F.concat("role", F.lit(" X")).alias("role"))
    return U.upsert_vacancies(v, batch, AS_OF).select("synthetic_id", "role", "updated_at", "expires_at")


@query("upsert_specialists", with_tables(f"""SELECT coalesce(o.synthetic_id, n.synthetic_id) AS synthetic_id, coalesce(n.role, o.role) AS role, coalesce(n.is_internal, o.is_internal) AS is_internal, CASE WHEN n.synthetic_id IS NOT NULL THEN {_NOW} ELSE o.updated_at END AS updated_at
 FROM specialists o FULL JOIN (SELECT CASE WHEN id % 2 = 0 THEN synthetic_id ELSE 'n' || id END AS synthetic_id, role || ' X' AS role, CASE WHEN id % 4 = 0 THEN TRUE END AS is_internal FROM specialists WHERE id % 3 = 0) n ON o.synthetic_id = n.synthetic_id""", "specialists"))
def upsert_specialists(spark, d):
    s = table(spark, d, "specialists").select("synthetic_id", "id", "role", "is_internal", "embedding", "created_at", "updated_at", "expires_at")
    batch = s.where("id % 3 = 0").select(F.expr("CASE WHEN id % 2 = 0 THEN synthetic_id ELSE concat('n', id) END").alias("synthetic_id"), "id", F.concat("role", F.lit(" X")).alias("role"), F.expr("CASE WHEN id % 4 = 0 THEN TRUE END").alias("is_internal"), F.lit(None).cast("array<float>").alias("embedding"))
    return U.upsert_specialists(s, batch, AS_OF).select("synthetic_id", "role", "is_internal", "updated_at")


@query("insert_sources_ignore", with_tables("SELECT channel_id, message_id, source_type FROM sources UNION ALL SELECT channel_id, -message_id, 'new' FROM sources WHERE id % 10 = 3", "sources"))
def insert_sources_ignore(spark, d):
    s = table(spark, d, "sources").select("channel_id", "message_id", "source_type")
    batch = table(spark, d, "sources").where("id % 10 IN (3, 4)").select("channel_id", F.expr("CASE WHEN id % 10 = 3 THEN -message_id ELSE message_id END").alias("message_id"), F.lit("new").alias("source_type"))
    return U.insert_ignore(s, batch.unionAll(batch), ["channel_id", "message_id"], ["source_type"])


@query("upsert_raw_messages", with_tables("""SELECT coalesce(o.channel_id, n.channel_id) AS channel_id, coalesce(o.message_id, n.message_id) AS message_id, coalesce(n.raw_text, o.raw_text) AS raw_text, coalesce(n.sender_name, o.sender_name) AS sender_name, coalesce(n.edited_at, o.edited_at) AS edited_at, coalesce(o.message_date, n.message_date) AS message_date,
 coalesce(o.has_attachment, FALSE) OR coalesce(n.has_attachment, FALSE) AS has_attachment, coalesce(o.attachment_type, n.attachment_type) AS attachment_type FROM raw_messages o FULL JOIN
 (SELECT channel_id, CASE WHEN message_id % 2 = 0 THEN message_id ELSE -message_id END AS message_id, CASE WHEN message_id % 3 = 0 THEN NULL ELSE 'edited' END AS raw_text, CAST(NULL AS STRING) AS sender_name, message_date + INTERVAL 1 DAY AS edited_at, message_date + INTERVAL 9 DAY AS message_date, TRUE AS has_attachment, 'doc' AS attachment_type FROM raw_messages) n
 ON o.channel_id = n.channel_id AND o.message_id = n.message_id""", "raw_messages"))
def upsert_raw_messages(spark, d):
    m = table(spark, d, "raw_messages")
    batch = m.selectExpr("channel_id", "CASE WHEN message_id % 2 = 0 THEN message_id ELSE -message_id END AS message_id", "chat_title", "chat_username", "CAST(NULL AS STRING) AS sender_name", "CASE WHEN message_id % 3 = 0 THEN NULL ELSE 'edited' END AS raw_text", "message_date + INTERVAL 9 DAY AS message_date", "message_date + INTERVAL 1 DAY AS edited_at", "TRUE AS has_attachment", "'doc' AS attachment_type", "created_at")
    return U.upsert_raw_messages(m, batch).select("channel_id", "message_id", "raw_text", "sender_name", "edited_at", "message_date", "has_attachment", "attachment_type")


@query("replace_matches", with_tables("SELECT vacancy_id, specialist_id, similarity_score, rank FROM matches WHERE vacancy_id % 3 <> 0 UNION ALL SELECT vacancy_id, specialist_id + 1000000, 0.5, 1 FROM matches WHERE vacancy_id % 3 = 0 AND rank <= 10", "matches"))
def replace_matches(spark, d):
    m = table(spark, d, "matches").select("vacancy_id", "specialist_id", "similarity_score", "rank")
    touched = m.where("vacancy_id % 3 = 0")
    new = touched.where("rank <= 10").select("vacancy_id", (F.col("specialist_id") + 1000000).alias("specialist_id"), F.lit(0.5).alias("similarity_score"), F.lit(1).alias("rank"))
    none = touched.selectExpr("vacancy_id", "CAST(NULL AS BIGINT) AS specialist_id", "CAST(NULL AS DOUBLE) AS similarity_score", "CAST(NULL AS INT) AS rank").distinct()
    return U.replace_matches(m, new.unionByName(none), "vacancy_id")


@query("upsert_matches_keep", with_tables("SELECT vacancy_id, specialist_id, CASE WHEN rank <= 5 THEN similarity_score / 2 ELSE similarity_score END AS similarity_score, created_at FROM matches", "matches"))
def upsert_matches_keep(spark, d):
    m = table(spark, d, "matches").select("vacancy_id", "specialist_id", "similarity_score", "created_at", "rank")
    return U.upsert_matches_keep(m, m.where("rank <= 5").withColumn("similarity_score", F.col("similarity_score") / 2)).drop("rank")


@query("add_partner_counts", with_tables("SELECT canonical_name, mentions_count + CASE WHEN mentions_count % 2 = 0 THEN 7 ELSE 0 END AS mentions_count FROM partners UNION ALL SELECT 'New ' || r_name, 3 FROM region", "partners"))
def add_partner_counts(spark, d):
    p = table(spark, d, "partners")
    batch = p.where("mentions_count % 2 = 0").selectExpr("canonical_name", "explode(array(3L, 4L)) AS mentions_count", "source_url")
    batch = batch.unionByName(table(spark, d, "region").selectExpr("concat('New ', r_name) AS canonical_name", "3L AS mentions_count", "CAST(NULL AS STRING) AS source_url")).unionByName(p.selectExpr("'' AS canonical_name", "5L AS mentions_count", "source_url"))
    return U.add_partner_counts(p, batch).select("canonical_name", "mentions_count")


@query("bump_progress", with_tables("SELECT c.telegram_id, greatest(c.last_message_id, coalesce(m.top, 0)) AS last_message_id FROM channels c LEFT JOIN (SELECT channel_id, max(message_id) AS top FROM raw_messages GROUP BY 1) m ON m.channel_id = c.telegram_id", "channels", "raw_messages"))
def bump_progress(spark, d):
    return U.bump_progress(table(spark, d, "channels"), table(spark, d, "raw_messages")).select("telegram_id", "last_message_id")


@query("soft_hide", with_tables("SELECT id, CASE WHEN EXISTS (SELECT 1 FROM sources o WHERE o.entity_type = 'specialist' AND o.entity_id = s.id AND o.external_url = 'https://docs.google.com/spreadsheets/d/s9') THEN 'hidden' ELSE status END AS status FROM specialists s", "specialists", "sources"))
def soft_hide(spark, d):
    return U.soft_hide(table(spark, d, "specialists"), table(spark, d, "sources"), "https://docs.google.com/spreadsheets/d/s9", "specialist", AS_OF).select("id", "status")


@query("deactivate_source", with_tables("SELECT registry_key, is_active AND source_url <> 'https://docs.google.com/spreadsheets/d/own2' AS is_active FROM registry", "registry"))
def deactivate_source(spark, d):
    return U.deactivate_source(table(spark, d, "registry"), "https://docs.google.com/spreadsheets/d/own2").select("registry_key", "is_active")


_OWN1 = "https://docs.google.com/spreadsheets/d/own1"


@query("stale_keys", with_tables(f"SELECT registry_key FROM registry WHERE is_active AND source_url = '{_OWN1}' AND specialist_id % 2 = 1", "registry"))
def stale_keys(spark, d):
    r = table(spark, d, "registry")
    return U.stale_keys(r, r.where("specialist_id % 2 = 0"), _OWN1)


@query("registry_sync", with_tables(f"""SELECT registry_key, specialist_id, CASE WHEN source_url = '{_OWN1}' THEN specialist_id % 2 = 0
 WHEN identity_key IN (SELECT identity_key FROM registry WHERE source_url = '{_OWN1}' AND specialist_id % 2 = 0) THEN FALSE ELSE is_active END AS is_active FROM registry""", "registry"))
def registry_sync(spark, d):
    r = table(spark, d, "registry")
    sheet = r.where((F.col("source_url") == _OWN1) & F.expr("specialist_id % 2 = 0")).withColumn("specialist_id", F.lit(None).cast("long")).drop("is_active", "source_url")
    return U.registry_sync(r, sheet, _OWN1).select("registry_key", "specialist_id", "is_active")


_SHEET = f"SELECT * FROM registry WHERE source_url = '{_OWN1}' AND specialist_id % 2 = 0"
_CHANGED = f"""SELECT registry_key, specialist_id, CASE WHEN registry_key IN (SELECT registry_key FROM ({_SHEET}) s) THEN 'update' WHEN is_active AND identity_key IN (SELECT identity_key FROM ({_SHEET}) s) THEN 'move' WHEN is_active AND source_url = '{_OWN1}' THEN 'off' ELSE 'keep' END AS op,
 CASE WHEN registry_key IN (SELECT registry_key FROM ({_SHEET}) s) THEN TRUE WHEN identity_key IN (SELECT identity_key FROM ({_SHEET}) s) OR source_url = '{_OWN1}' THEN FALSE ELSE is_active END AS is_active FROM registry
 UNION ALL SELECT 'new' || specialist_id, specialist_id, 'insert', TRUE FROM ({_SHEET}) s WHERE specialist_id % 4 = 0"""


def _changes(spark, d):
    r = table(spark, d, "registry")
    kept = r.where((F.col("source_url") == _OWN1) & F.expr("specialist_id % 2 = 0"))
    new = kept.where("specialist_id % 4 = 0").withColumn("registry_key", F.concat(F.lit("new"), "specialist_id"))
    return U.registry_changes(r, kept.withColumn("specialist_id", F.lit(None).cast("long")).unionByName(new).drop("is_active", "source_url"), _OWN1)


@query("registry_changes", with_tables(_CHANGED, "registry"))
def registry_changes(spark, d):
    return _changes(spark, d).select("registry_key", "specialist_id", "op", "is_active")


@query("registry_change_stats", with_tables(f"SELECT count(*) FILTER (WHERE op IN ('insert', 'update')) AS saved, count(*) FILTER (WHERE op = 'insert') AS inserted, count(*) FILTER (WHERE op = 'move') AS moved, count(*) FILTER (WHERE op = 'off') AS deactivated, count(*) FILTER (WHERE is_active) AS active_rows FROM ({_CHANGED}) c", "registry"))
def registry_change_stats(spark, d):
    return U.change_stats(_changes(spark, d))


_AFTER = "SELECT id, is_internal AND NOT gone AS is_internal, CASE WHEN gone AND status = 'active' THEN 'hidden' ELSE status END AS status FROM (SELECT *, id IN (SELECT specialist_id FROM c WHERE op IN ('move', 'off')) AND id NOT IN (SELECT specialist_id FROM c WHERE is_active) AS gone FROM specialists) s"


@query("registry_sync_specialists", with_tables(f"WITH c AS ({_CHANGED}) {_AFTER}", "registry", "specialists").replace("\nWITH c AS", ",\nc AS", 1))
def registry_sync_specialists(spark, d):
    return U.bound_specialists(table(spark, d, "specialists"), _changes(spark, d)).select("id", "is_internal", "status")


@query("deactivate_source_specialists", with_tables(f"WITH c AS (SELECT specialist_id, CASE WHEN is_active AND source_url = '{_OWN1}' THEN 'off' ELSE 'keep' END AS op, is_active AND source_url <> '{_OWN1}' AS is_active FROM registry) {_AFTER}", "registry", "specialists").replace("\nWITH c AS", ",\nc AS", 1))
def deactivate_source_specialists(spark, d):
    return U.bound_specialists(table(spark, d, "specialists"), U.deactivations(table(spark, d, "registry"), _OWN1)).select("id", "is_internal", "status")


def _exported(spark, d, only_active):
    from hirelake.sources.sinks import export_tables

    s, v, p, m = (table(spark, d, t) for t in ("specialists", "vacancies", "sources", "matches"))
    out = None
    for name, df in export_tables(s, v, p, m, only_active).items():
        key = F.concat_ws("-", *[F.col(c) for c in (["vacancy_id", "specialist_id"] if name == "matches" else ["id"])])
        rows = df.select(F.lit(name).alias("sheet"), key.alias("key"), F.col("stack" if name in ("specialists", "vacancies") else "source_type" if name == "sources" else "rank").cast("string").alias("value"), "created_at")
        out = rows if out is None else out.unionByName(rows)
    return out


def _export_sql(active: bool) -> str:
    keep = lambda where: f" WHERE {where}" if active else ""
    ids = lambda t: f"(SELECT id FROM {t} WHERE status = 'active')"
    stack = "'[\"' || array_to_string(stack, '\",\"') || '\"]'"
    sides = [f"SELECT '{t}' AS sheet, CAST(id AS VARCHAR) AS key, {stack} AS value, created_at FROM {t}" + keep("status = 'active'") for t in ("specialists", "vacancies")]
    where = f"(entity_type = 'vacancy' AND entity_id IN {ids('vacancies')}) OR (entity_type = 'specialist' AND entity_id IN {ids('specialists')})"
    rest = ["SELECT 'sources', CAST(id AS VARCHAR), source_type, created_at FROM sources" + keep(where), "SELECT 'matches', vacancy_id || '-' || specialist_id, CAST(rank AS VARCHAR), created_at FROM matches" + keep(f"vacancy_id IN {ids('vacancies')} AND specialist_id IN {ids('specialists')}")]
    return with_tables(" UNION ALL ".join(sides + rest), "specialists", "vacancies", "sources", "matches")


@query("export_all_tables", _export_sql(False))
def export_all_tables(spark, d):
    return _exported(spark, d, False)


@query("export_active_tables", _export_sql(True))
def export_active_tables(spark, d):
    return _exported(spark, d, True)


@query("partner_mention_suppliers", """SELECT o_orderkey AS id, (SELECT arg_min(s_name, (-(s_suppkey % 5), s_name)) FROM supplier WHERE s_suppkey % 5 > 0 AND contains(t, lower(s_name))) AS partner FROM
 (SELECT o_orderkey, lower('for supplier#' || lpad(CAST(o_custkey % 200 AS VARCHAR), 9, '0') || ' and Supplier#' || lpad(CAST(o_orderkey % 150 AS VARCHAR), 9, '0')) AS t FROM orders) o""")
def partner_mention_suppliers(spark, d):
    name = lambda n: F.concat(F.lit("supplier#"), F.lpad(n.cast("string"), 9, "0"))
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("for "), name(F.col("o_custkey") % 200), F.lit(" and "), F.initcap(name(F.col("o_orderkey") % 150))).alias("text"))
    names = table(spark, d, "supplier").select(F.col("s_name").alias("canonical_name"), (F.col("s_suppkey") % 5).alias("mentions_count"))
    return J.partner_mention(texts, names, "id", "text")


@query("relink_sources", with_tables("SELECT id, CASE WHEN id % 13 = 0 THEN entity_id + 5 ELSE entity_id END AS entity_id FROM sources", "sources"))
def relink_sources(spark, d):
    s = table(spark, d, "sources")
    return U.relink(s, s.where("id % 13 = 0").select(F.col("id").alias("source_id"), (F.col("entity_id") + 5).alias("new_id"))).select("id", "entity_id")
