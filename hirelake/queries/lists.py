"""Queries of summaries, sinks, cards, keyword ranking and manual previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import cards as C
from hirelake.functions import text as T
from hirelake.operators import aggregates as A
from hirelake.operators import filters as L
from hirelake.operators import joins as J
from hirelake.operators import upserts as U
from hirelake.plans import retrieval as V
from hirelake.sources import sinks
from hirelake.sources.domain import AS_OF, table, with_tables

from . import ORACLES, query
from .matching import features_sql
from .messages import _holds

_NOW = f"TIMESTAMP '{AS_OF}'"


@query("backfill_stats", with_tables("""SELECT count(*) AS sources_total, count(*) FILTER (WHERE id % 3 = 0) AS rebuilt, count(*) FILTER (WHERE id % 3 = 0 AND (id % 6 = 0 OR entity_id IS NULL)) AS relinked, count(*) FILTER (WHERE id % 3 <> 0) AS skipped,
 (SELECT count(*) FROM specialists WHERE status <> 'hidden' AND id NOT IN (SELECT entity_id FROM sources WHERE entity_type = 'specialist') AND id NOT IN (SELECT specialist_id FROM registry WHERE is_active)) AS orphans_hidden, (SELECT count(*) FROM matches) AS matches_rebuilt FROM sources""", "sources", "specialists", "registry", "matches"))
def backfill_stats(spark, d):
    s, p, r = (table(spark, d, t) for t in ("sources", "specialists", "registry"))
    rebuilt = s.where("id % 3 < 2").select(F.col("id").alias("source_id"), F.expr("CASE WHEN id % 6 = 0 THEN entity_id + 1 WHEN id % 3 = 0 THEN entity_id END").alias("new_id"))
    return A.backfill_stats(s, rebuilt, J.orphans(p, s, r), table(spark, d, "matches"))


@query("digest_counts", "WITH s AS (" + ORACLES["digest_sections"] + ") SELECT " + ", ".join(f"count(*) FILTER (WHERE section = '{n}') AS {n}" for n in ("new_vacancy", "updated_vacancy", "new_specialist", "updated_specialist")) + " FROM s")
def digest_counts(spark, d):
    return A.digest_counts(A.digest_sections(*[table(spark, d, t) for t in ("vacancies", "specialists", "sources")], end="2024-02-02 13:00:00"))


@query("url_union", "SELECT url, CAST(min(list) AS INT) AS list, arg_min(position, (list, position)) AS position FROM (SELECT 'http://u/' || o_custkey AS url, 0 AS list, o_orderkey AS position FROM orders UNION ALL SELECT 'http://u/' || c_custkey, 1, c_custkey FROM customer) t GROUP BY 1")
def url_union(spark, d):
    found = table(spark, d, "orders").select(F.concat(F.lit(" http://u/"), "o_custkey").alias("url"), F.col("o_orderkey").alias("position"))
    given = table(spark, d, "customer").select(F.concat(F.lit("http://u/"), "c_custkey", F.lit(" ")).alias("url"), F.col("c_custkey").alias("position"))
    blank = given.select(F.lit("  ").alias("url"), "position")
    return A.url_union(found, given.unionByName(blank))


@query("ui_sort", with_tables("SELECT vacancy_id, specialist_id, similarity_score FROM matches JOIN specialists ON id = specialist_id WHERE is_internal ORDER BY similarity_score, vacancy_id, specialist_id LIMIT 200", "matches", "specialists"))
def ui_sort(spark, d):
    return A.scope_sorted(table(spark, d, "matches"), table(spark, d, "specialists"), "own", True, 200).select("vacancy_id", "specialist_id", "similarity_score")


@query("partner_order", with_tables("SELECT canonical_name, mentions_count FROM partners WHERE mentions_count > 0 ORDER BY mentions_count DESC, canonical_name", "partners"))
def partner_order(spark, d):
    return table(spark, d, "partners").where("mentions_count > 0").orderBy(F.desc("mentions_count"), "canonical_name").select("canonical_name", "mentions_count")


@query("filter_audit", with_tables("SELECT id, kind, created_at FROM jobs WHERE kind = (SELECT min(kind) FROM jobs) AND user_id % 2 = 0 ORDER BY created_at DESC, id DESC LIMIT 100", "jobs"))
def filter_audit(spark, d):
    j = table(spark, d, "jobs").withColumn("even", F.col("user_id") % 2 == 0)
    first = j.agg(F.min("kind")).first()[0]
    return L.optional(j, 100, kind=first, even=True, status=None).select("id", "kind", "created_at")


@query("append_audit", with_tables(f"SELECT 'match_saved' AS event_type, 'system' AS actor, 'vacancy' AS entity_type, vacancy_id AS entity_id, '{{\"vacancy_id\":' || vacancy_id || ',\"specialist_id\":' || specialist_id || ',\"rank\":' || rank || '}}' AS payload, {_NOW} AS created_at FROM matches", "matches"))
def append_audit(spark, d):
    return sinks.audit_events(table(spark, d, "matches").select("vacancy_id", "specialist_id", "rank"), "match_saved", AS_OF, entity_type="vacancy", entity_id="vacancy_id")




@query("archive_pending", with_tables("""SELECT channel_id, message_id, kind, CASE WHEN kind = 'irrelevant' THEN 'skipped' ELSE 'pending' END AS status FROM (SELECT channel_id, message_id, CASE WHEN message_id % 3 = 0 THEN 'vacancy' WHEN message_id % 3 = 1 THEN 'bench' ELSE 'irrelevant' END AS kind FROM raw_messages) m
 WHERE channel_id IN (SELECT telegram_id FROM channels WHERE coalesce(source_kind, 'chat') = 'chat') AND message_id % 7 <> 0""", "raw_messages", "channels"))
def archive_pending(spark, d):
    k = F.col("message_id") % 3
    m = table(spark, d, "raw_messages").withColumn("raw_text", F.when(k == 0, F.concat(F.lit("ищем на проект "), F.col("message_id"))).when(k == 1, F.concat(F.lit("Bench: "), F.col("message_id"))).otherwise("x"))
    done = m.select(F.col("channel_id").alias("original_chat_id"), F.col("message_id").alias("original_message_id"), F.when(F.col("message_id") % 7 == 0, "posted").otherwise("skipped").alias("status"))
    return J.archive_pending(m, table(spark, d, "channels"), done)


@query("upsert_registry_sources", with_tables("""SELECT -(CAST('0x' || left(sha256(source_url), 15) AS BIGINT)) AS channel_id, CAST('0x' || left(sha256(source_url || '|' || locator), 15) AS BIGINT) AS message_id, source_url AS external_url, locator AS external_locator,
 CASE WHEN specialist_id % 2 = 0 THEN 'new' ELSE raw_text END AS raw_text, specialist_id AS entity_id FROM registry""", "registry"))
def upsert_registry_sources(spark, d):
    r = table(spark, d, "registry").select("source_url", "locator", "raw_text", F.col("specialist_id").alias("entity_id"))
    empty = spark.createDataFrame([], "channel_id long, message_id long, external_url string, external_locator string, raw_text string, entity_id long")
    first = U.upsert_registry_sources(empty, r)
    return U.upsert_registry_sources(first, r.where("entity_id % 2 = 0").withColumn("raw_text", F.lit("new")))


@query("write_matches", with_tables("SELECT vacancy_id, specialist_id, similarity_score, rank FROM matches WHERE vacancy_id % 2 = 1 UNION ALL SELECT vacancy_id, specialist_id, 1.0, rank + 1 FROM matches WHERE vacancy_id % 2 = 0 AND specialist_id % 2 = 0", "matches"))
def write_matches(spark, d):
    m = table(spark, d, "matches").select("vacancy_id", "specialist_id", "similarity_score", "rank")
    even = m.where("vacancy_id % 2 = 0")
    new = even.where("specialist_id % 2 = 0").select("vacancy_id", "specialist_id", F.lit(1.0).alias("similarity_score"), (F.col("rank") + 1).alias("rank"))
    lost = even.select("vacancy_id").distinct().join(new.select("vacancy_id").distinct(), "vacancy_id", "left_anti").select("vacancy_id", F.lit(None).cast("long").alias("specialist_id"), F.lit(None).cast("double").alias("similarity_score"), F.lit(None).cast("int").alias("rank"))
    return U.replace_matches(m, new.unionByName(lost), "vacancy_id")


@query("specialist_card", with_tables("""SELECT id, CASE WHEN id % 3 = 0 THEN 'Person ' || id WHEN id % 3 = 1 THEN 'Other ' || id END AS display_name, concat_ws(' · ', CASE WHEN id % 3 = 0 THEN 'Person ' || id WHEN id % 3 = 1 THEN 'Other ' || id END, CASE WHEN id % 2 = 0 THEN 'Omsk' ELSE location END) AS identity_hint,
 concat_ws(' · ', 'Лист: Bench', CASE WHEN id % 4 = 0 THEN 'Строка: ' || id WHEN id % 4 = 1 THEN 'Строка: 7' ELSE 'Позиция: 9' END) AS reference FROM specialists""", "specialists"))
def specialist_card(spark, d):
    i = F.col("id")
    text = F.concat_ws("\n", F.lit("card"), F.when(i % 3 == 0, F.concat(F.lit("Name - Person "), i)), F.when(i % 2 == 0, "город: Omsk  "), F.when(i % 4 == 0, F.concat(F.lit("Row: "), i)))
    source = F.concat(F.lit("Менеджер: -; Лист: Bench; Индекс: 9"), F.when(i % 3 == 1, F.concat(F.lit("; Кандидат: Other "), i)).otherwise(""), F.when(i % 4 == 1, "; Строка: 7").otherwise(""))
    return table(spark, d, "specialists").select("id", C.specialist_card(text, source, "location").alias("c")).select("id", "c.*")




@query("match_explanation", with_tables("""SELECT m.vacancy_id, m.specialist_id, array_to_string(list_filter([CASE WHEN len(common) > 0 THEN 'Стек=совпали ' || array_to_string(common[1:5], ', ') ELSE 'Стек=точного пересечения по тегам не найдено' END,
 CASE WHEN g IS NULL AND h IS NULL THEN NULL WHEN g = h THEN 'Грейд=оба ' || h WHEN g IS NULL OR h IS NULL THEN 'Грейд=указан ' || coalesce(g, h) ELSE 'Грейд=вакансия ' || g || ', специалист ' || h END,
 'Ставка=' || nullif(concat_ws('; ', 'вакансия ' || a, 'специалист ' || b), ''), 'Формат/локация=вакансия ' || x || '; специалист ' || y, 'Приоритет=' || CASE WHEN own THEN 'сначала проверен наш бенч' ELSE 'показан партнерский бенч после проверки нашего' END], lambda t: t IS NOT NULL), '|') AS text FROM
 (SELECT m.vacancy_id, m.specialist_id, list_filter(v.stack, lambda w: list_contains(s.stack, w)) AS common, v.grade AS g, s.grade AS h, v.rate_max AS a, s.rate_min AS b, v.location AS x, s.location AS y, s.is_internal AS own FROM matches m JOIN vacancies v ON v.id = m.vacancy_id JOIN specialists s ON s.id = m.specialist_id) m""", "matches", "vacancies", "specialists"))
def match_explanation(spark, d):
    side = lambda t, rate, name: table(spark, d, t).select(F.col("id").alias(f"{name}_id"), F.struct("stack", "grade", F.col(rate).cast("string").alias("rate"), "location").alias(name), *([F.col("is_internal").alias("own")] if name == "s" else []))
    s = side("specialists", "rate_min", "s").withColumn("s", F.col("s").withField("stack", F.transform("s.stack", lambda x: F.concat(F.lit(" "), x))))
    rows = table(spark, d, "matches").join(side("vacancies", "rate_max", "v"), F.col("vacancy_id") == F.col("v_id")).join(s, F.col("specialist_id") == F.col("s_id"))
    rows = rows.select("vacancy_id", "specialist_id", C.match_explanation("v", "s", "own").alias("e"))
    return rows.select("vacancy_id", "specialist_id", F.array_join(F.transform("e", lambda r: F.concat(r["label"], F.lit("="), F.regexp_replace(r["value"], "(совпали|,)  ?", "$1 "))), "|").alias("text"))


_Q = "(SELECT id, lower(role || ' ' || array_to_string(stack, ' ') || ' with ' || coalesce(grade, 'any')) AS t FROM vacancies)"
_T = "(SELECT id, lower(role || ' ' || array_to_string(stack, ' ') || ' from ' || location || ' ' || coalesce(description, '')) AS t FROM specialists)"
_WORDS = f"list_distinct(list_filter(string_split(regexp_replace(t, '[^a-z0-9+#.]', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT list_contains({C.STOPWORDS!r}, w)))".replace("(\'это\'", "[\'это\'").replace("\'года\')", "\'года\']")
_PROFILES = "list_filter([" + ", ".join(f"CASE WHEN {_holds(chr(39) + ' ' + chr(39) + ' || t || ' + chr(39) + ' ' + chr(39), [f' {x} ' for x in terms])} THEN '{name}' END" for name, terms in C.PROFILES) + "], lambda p: p IS NOT NULL)"
_KEYED = f"""SELECT query_id, id, score, overlap, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, t.id, CAST(len(list_intersect(q.k, t.k)) AS BIGINT) AS overlap,
 CAST(floor(len(list_intersect(q.k, t.k)) / len(q.k) * 55 + len(list_intersect(q.k, t.k)) / len(t.k) * 20 + 25 + 0.5) AS INT) AS score FROM (SELECT id, {_WORDS} AS k, {_PROFILES} AS p FROM {_Q} x) q JOIN (SELECT id, {_WORDS} AS k, {_PROFILES} AS p FROM {_T} x) t
 ON len(list_intersect(q.p, t.p)) > 0 AND len(list_intersect(q.k, t.k)) > 0) s WHERE score >= 35) r WHERE rank <= 10"""


@query("keyword_match", with_tables(_KEYED, "vacancies", "specialists"))
def keyword_match(spark, d):
    q = table(spark, d, "vacancies").select(F.col("id").alias("query_id"), F.concat_ws(" ", "role", F.array_join("stack", " "), F.lit("with"), F.coalesce("grade", F.lit("any"))).alias("text"))
    t = table(spark, d, "specialists").select("id", F.concat_ws("  ", "role", F.array_join("stack", " "), F.lit("from"), "location", "description").alias("text"))
    return C.keyword_match(q, t)


@query("keyword_topk", with_tables(_KEYED.replace("rank <= 10", "rank <= 3").replace("SELECT query_id, id, score, overlap,", "SELECT query_id, id,", 1), "vacancies", "specialists"))
def keyword_topk(spark, d):
    return keyword_match(spark, d).where("rank <= 3").select("query_id", "id", "rank")


@query("manual_preview", features_sql("""SELECT query_id, bucket, specialist_id, score, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY rank) AS position FROM (SELECT query_id, specialist_id, score, r.own AS bucket, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rate ASC NULLS LAST, g DESC, rs DESC, sec DESC, inner_flag DESC, specialist_id) AS rank FROM
 (SELECT *, round(0.50 + 0.15 * sec + 0.15 * g + 0.10 * rs, 4) AS score FROM (SELECT q.id AS query_id, s.id AS specialist_id, s.rate, s.inner_flag, CAST(CASE WHEN q.lvl IS NULL THEN 0.5 WHEN s.lvl IS NULL THEN 0 ELSE coalesce([1.0, 0.6, 0.25][abs(q.lvl - s.lvl) + 1], 0) END AS DOUBLE) AS g, q.rate IS NOT NULL AS rated,
 CAST(CASE WHEN q.rate IS NULL OR s.rate IS NULL THEN 0 WHEN s.rate <= q.rate THEN 1 WHEN 10 * (s.rate - q.rate) <= q.rate THEN 0.6 WHEN 4 * (s.rate - q.rate) <= q.rate THEN 0.25 ELSE 0 END AS DOUBLE) AS rs, CAST(0 AS DOUBLE) AS sec
 FROM (SELECT id, lower(role_word) AS label, CASE grade WHEN 'Junior' THEN 1 WHEN 'Middle' THEN 3 WHEN 'Senior' THEN 5 WHEN 'Lead' THEN 6 WHEN 'Middle+' THEN 3 END AS lvl, CASE WHEN id % 2 = 0 THEN 2000 END AS rate FROM (SELECT id, grade, ['Python', 'Java', 'React', 'QA', 'DevOps', NULL, 'Go', NULL][id % 8 + 1] AS role_word FROM vacancies) v) q
 JOIN f_s s ON list_contains(s.prim, q.label)) a WHERE g > 0) b JOIN (SELECT id, CASE WHEN id IN (SELECT specialist_id FROM registry WHERE is_active) THEN 'own' ELSE 'partner' END AS own FROM specialists) r ON r.id = specialist_id WHERE score >= 0.5 AND (NOT rated OR rs > 0)) c) d WHERE position <= 10""", extra=("registry",)))
def manual_preview(spark, d):
    v = table(spark, d, "vacancies")
    word = F.get(F.array(*[F.lit(x) for x in ("Python", "Java", "React", "QA", "DevOps", None, "Go", None)]), (F.col("id") % 8).cast("int"))
    queries = v.select("id", F.concat_ws(" ", word, "grade").alias("text"), F.when(F.col("id") % 2 == 0, 2000).alias("rate"))
    return V.manual_preview(queries, table(spark, d, "specialists"), table(spark, d, "registry"), AS_OF)


# ---- further forms ----

@query("registry_index", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'r' || o_custkey WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE '-' END AS idx FROM orders")
def registry_index(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    place = F.when(k == 0, F.concat(F.lit("Bench:x: "), c)).when(k == 1, F.concat(F.lit("sheet#r"), c)).when(k == 2, F.concat(F.lit(" "), c)).otherwise(" ")
    return table(spark, d, "orders").select("o_orderkey", T.registry_index(place).alias("idx"))


@query("rate_range", with_tables("SELECT id, CASE WHEN rate_min IS NULL AND id % 3 = 0 THEN '—' WHEN rate_min IS NULL THEN 'до 9000 RUB' WHEN id % 3 = 0 THEN 'от ' || rate_min || ' RUB' ELSE 'от ' || rate_min || ' до 9000 RUB' END AS rate FROM specialists", "specialists"))
def rate_range(spark, d):
    return table(spark, d, "specialists").select("id", T.rate_range("rate_min", F.when(F.col("id") % 3 == 0, 0).otherwise(9000), F.lit("RUB ")).alias("rate"))


@query("registry_candidates", """SELECT arg_min(company, (position, n)) AS company, url, arg_min(col, (position, n)) AS column, min(position) AS position FROM (SELECT o_orderkey AS position, 'Firm ' || o_custkey AS company, 0 AS n, 'bench' AS col, 'https://d.example.com/b/' || (o_custkey % 100) AS url FROM orders
 UNION ALL SELECT o_orderkey, 'Firm ' || o_custkey, 1, 'vacancies', 'https://d.example.com/' || CASE WHEN o_orderkey % 2 = 0 THEN 'b/' ELSE 'v/' END || (o_custkey % 100) FROM orders WHERE o_orderkey % 3 = 0) t GROUP BY url""")
def registry_candidates(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    link = lambda path: F.concat(F.lit("https://d.example.com/"), path, c % 100)
    text = F.concat_ws("\n", F.concat(F.lit("Company: Firm "), c), F.concat(F.lit("Bench: see "), link(F.lit("b/")), F.lit(", t.me/x")), F.when(k % 3 == 0, F.concat(F.lit("Vacancies: "), link(F.when(k % 2 == 0, "b/").otherwise("v/")))))
    return T.registry_candidates(table(spark, d, "orders").select(k.alias("k"), k.alias("position"), text.alias("t")), "k", "t", "position", "company", ("bench", "vacancies"))


@query("settings_forms", """SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN '["a", " ", "b' || c_custkey || ' "]' WHEN 1 THEN 'env' WHEN 2 THEN 'default' WHEN 3 THEN '{"y":"2","x":"","w":" 1 "}' ELSE 'plain' END AS value,
 CASE WHEN c_custkey % 5 = 0 THEN ['a', 'b' || c_custkey] ELSE CAST([] AS VARCHAR[]) END AS items, CASE WHEN c_custkey % 5 = 3 THEN ['w=1', 'y=2'] ELSE CAST([] AS VARCHAR[]) END AS entries FROM customer""")
def settings_forms(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    stored = F.when(k % 5 == 0, F.concat(F.lit('["a", " ", "b'), k, F.lit(' "]'))).when(k % 5 == 3, '{"y":"2","x":"","w":" 1 "}').when(k % 5 == 4, " plain ").otherwise(" ")
    return L.setting_forms(c.select(k.alias("key"), stored.alias("value")), c.select(k.alias("key"), F.when(k % 5 == 1, " env").otherwise(" ").alias("env"), F.lit("default").alias("value")))


@query("source_meta", """SELECT c_custkey, '{"index":"' || c_custkey || '",' || CASE WHEN c_custkey % 2 = 0 THEN '"kind":"file",' ELSE '"kind":"old",' END || '"manager":"-"}' AS meta FROM customer""")
def source_meta(spark, d):
    from hirelake.functions.entities import source_meta as meta

    k = F.col("c_custkey")
    base = F.create_map(F.lit("kind"), F.lit("old"), F.lit("manager"), F.lit("-"))
    return table(spark, d, "customer").select("c_custkey", meta(base, kind=F.when(k % 2 == 0, " file"), index=k.cast("string"), sender=F.lit("  ")).alias("meta"))


@query("company_candidates", with_tables("SELECT c_custkey, list_sort(list_distinct(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'Сбер' END, CASE WHEN c_custkey % 3 = 0 THEN n_name END, CASE WHEN c_custkey % 5 = 0 THEN 'Лемана Про' END], lambda x: x IS NOT NULL))) AS companies FROM customer JOIN nation ON n_nationkey = c_nationkey", "partners"))
def company_candidates(spark, d):
    from hirelake.functions.companies import company_candidates as named

    k = F.col("c_custkey")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    text = F.concat_ws("\n", F.when(k % 4 == 0, "команда СберТеха"), F.when(k % 3 == 0, F.concat(F.lit("Клиент: "), "n_name", F.lit(" , rate 5"))), F.when(k % 5 == 0, "lemana pro"), F.lit("заказчик - банки"))
    return rows.select("c_custkey", named(text).alias("companies"))


@query("partner_source_url", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'https://cv/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://first/' || c_custkey END AS url FROM customer")
def partner_source_url(spark, d):
    from hirelake.functions.companies import partner_source_url as url

    k = F.col("c_custkey")
    text = F.concat_ws("\n", F.when(k % 3 < 2, F.concat(F.lit("site: https://first/"), k)), F.when(k % 3 == 0, F.concat(F.lit("Ссылка на резюме: тут https://cv/"), k)), F.lit("end"))
    return table(spark, d, "customer").select("c_custkey", url(text).alias("url"))


@query("urlish", with_tables("SELECT id, contains(text, 'https://') OR contains(text, 't.me/') AS urlish FROM posts", "posts"))
def urlish(spark, d):
    from hirelake.functions.matching import urlish as f

    return table(spark, d, "posts").select("id", f("text").alias("urlish"))


@query("stack_profile", features_sql("SELECT id, prim AS primary_labels, list_sort(sec) AS secondary_tokens, tool AS tooling_labels, list_sort(list_distinct(list_concat(prim, sec, tool))) AS meaningful_tokens FROM f_s"))
def stack_profile(spark, d):
    from hirelake.plans import matching as P

    rows = P.features(L.active(table(spark, d, "specialists"), AS_OF), "BENCH")
    return rows.select("id", "primary_labels", F.array_sort("secondary_tokens").alias("secondary_tokens"), "tooling_labels", F.array_sort("meaningful_tokens").alias("meaningful_tokens"))


@query("catalog_profile", with_tables("SELECT id, CASE role WHEN 'Python Developer' THEN 'profile_1' WHEN 'Java Developer' THEN 'profile_2' ELSE 'profile_3' END AS catalog_profile FROM specialists WHERE role IN ('Python Developer', 'Java Developer', 'QA Engineer')", "specialists"))
def catalog_profile(spark, d):
    from hirelake.operators import catalog

    from .sheets import CATALOG

    profiles = spark.createDataFrame(CATALOG, "profile string, kind string, terms string")
    return catalog.primary_profile(catalog.profile_scores(table(spark, d, "specialists"), profiles, "id", "role"), "id")

