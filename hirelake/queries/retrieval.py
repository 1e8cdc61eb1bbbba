"""Queries of retrieval with ranks, and of the features, gates and scores one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import matching as M
from hirelake.operators import aggregates as A
from hirelake.operators import retrieve as R
from hirelake.operators.filters import embedded_active
from hirelake.plans import matching as P
from hirelake.plans import retrieval as V
from hirelake.sources.domain import AS_OF, table, with_tables

from . import query
from .matching import _KINDS, _LEVEL, _ROLE, _map, features_sql

_ACTIVE = f"status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"
_SIM = "greatest(0.0, least(1.0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))))"
_PAIRS = f"SELECT v.id AS vacancy_id, s.id AS specialist_id, {_SIM} AS sim FROM vacancies v CROSS JOIN specialists s WHERE v.embedding IS NOT NULL AND s.embedding IS NOT NULL AND v.{_ACTIVE.replace('(expires_at', '(v.expires_at').replace('OR expires_at', 'OR v.expires_at')} AND s.{_ACTIVE.replace('(expires_at', '(s.expires_at').replace('OR expires_at', 'OR s.expires_at')}"


def _nearest(by: str, other: str, k: int) -> str:
    return f"SELECT vacancy_id, specialist_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sim DESC, {other}) AS n FROM ({_PAIRS}) p) q WHERE n <= {k}"


_OWN = f"SELECT id AS specialist_id FROM specialists WHERE {_ACTIVE} AND id IN (SELECT specialist_id FROM registry WHERE is_active) ORDER BY updated_at DESC, id DESC LIMIT 100"
_HITS = f"""hits AS (SELECT vacancy_id, specialist_id, max(sim) AS sim, bool_or(own) AS is_own FROM (SELECT *, FALSE AS own FROM ({_nearest('vacancy_id', 'specialist_id', 50)}) n
 UNION ALL SELECT v.id, o.specialist_id, 0.0, TRUE FROM vacancies v CROSS JOIN ({_OWN}) o WHERE v.{_ACTIVE.replace('(expires_at', '(v.expires_at').replace('OR expires_at', 'OR v.expires_at')}) u GROUP BY 1, 2)"""
_AGAIN = "round(0.50 + 0.15 * secondary_score + 0.15 * grade_score + 0.10 * rate_score + 0.05 * location_score + 0.05 * sim, 4)"


def _with(cte: str, body: str, **options) -> str:
    """features_sql with one more table expression before its body."""
    return features_sql("@@" + body, **options).replace("\n@@", ",\n" + cte + "\n")


_BEST = f"""SELECT vacancy_id, specialist_id, s, CAST(rank AS INT) AS rank FROM (SELECT vacancy_id, specialist_id, s, row_number() OVER (PARTITION BY vacancy_id ORDER BY s DESC, s_rate ASC NULLS LAST, grade_score DESC,
 rate_score DESC, location_score DESC, secondary_score DESC, sim DESC, inner_flag DESC, specialist_id) AS rank FROM (SELECT f.*, h.sim, {_AGAIN} AS s FROM final f JOIN hits h USING (vacancy_id, specialist_id)) t) r WHERE rank <= """


def _three(spark, d):
    return table(spark, d, "vacancies"), table(spark, d, "specialists"), table(spark, d, "registry")


@query("topk_per_query", with_tables(f"SELECT vacancy_id AS query_id, specialist_id AS id, round(sim, 6) AS sim, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY sim DESC, specialist_id) AS n FROM ({_PAIRS}) p) q WHERE n <= 20", "vacancies", "specialists"))
def topk_per_query(spark, d):
    v, s, _ = _three(spark, d)
    return R.neighbour_join(embedded_active(v, AS_OF), embedded_active(s, AS_OF), 20).withColumn("sim", F.round("sim", 6))


@query("retrieved_hits", with_tables("", "vacancies", "specialists", "registry").rstrip() + ",\n" + _HITS + "\nSELECT vacancy_id, specialist_id, round(sim, 6) AS sim, is_own FROM hits")
def retrieved_hits(spark, d):
    return V.specialist_hits(*_three(spark, d), AS_OF, 50).withColumn("sim", F.round("sim", 6))


rebuild_sql = _with(_HITS, _BEST.replace("SELECT vacancy_id, specialist_id, s,", "SELECT vacancy_id, specialist_id, s AS similarity_score,", 1) + "20", extra=("registry",))


@query("rebuild_matches_all", rebuild_sql)
def rebuild_matches_all(spark, d):
    best = V.match_specialists(*_three(spark, d), AS_OF, 50, 20)
    return best.select("vacancy_id", "specialist_id", F.col("score").alias("similarity_score"), "rank")


@query("entity_matches", _with(f"hits AS ({_nearest('specialist_id', 'vacancy_id', 20)})", f"""SELECT specialist_id, vacancy_id, s AS score, CAST(rank AS INT) AS rank FROM (SELECT specialist_id, vacancy_id, s,
 row_number() OVER (PARTITION BY specialist_id ORDER BY s DESC, grade_score DESC, rate_score DESC, location_score DESC, secondary_score DESC, sim DESC, vacancy_id) AS rank FROM (SELECT f.*, h.sim, {_AGAIN} AS s FROM final f JOIN hits h USING (vacancy_id, specialist_id)) t) r""", r="s", c="v"))
def entity_matches(spark, d):
    v, s, _ = _three(spark, d)
    return V.match_vacancies(s, v, AS_OF).select("specialist_id", "vacancy_id", "score", "rank")


@query("own_hits", with_tables(f"SELECT id FROM specialists WHERE {_ACTIVE} AND id IN (SELECT specialist_id FROM registry WHERE is_active AND source_url LIKE '%own1')", "specialists", "registry"))
def own_hits(spark, d):
    _, s, r = _three(spark, d)
    return V.own_hits(s, r, AS_OF, "https://docs.google.com/spreadsheets/d/own1").select("id")


@query("recent_matches", features_sql(f"""SELECT r.vacancy_id, r.specialist_id, r.rank, r.score, x.display AS vacancy_source, y.display AS specialist_source, r.specialist_id IN (SELECT specialist_id FROM registry WHERE is_active) AS is_own_bench_source, r.created_at FROM
 (SELECT m.vacancy_id, m.specialist_id, m.rank, m.created_at, {_AGAIN.replace('sim', 'm.similarity_score')} AS score FROM (SELECT * FROM matches ORDER BY created_at DESC, rank, vacancy_id, specialist_id LIMIT 500) m JOIN final f ON f.vacancy_id = m.vacancy_id AND f.specialist_id = m.specialist_id
  ORDER BY m.created_at DESC, m.rank, m.vacancy_id, m.specialist_id LIMIT 50) r
 LEFT JOIN (SELECT entity_id, coalesce(source_meta ->> '$.source_display', message_url, external_url) AS display FROM sources WHERE entity_type = 'vacancy' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) = 1) x ON x.entity_id = r.vacancy_id
 LEFT JOIN (SELECT entity_id, coalesce(source_meta ->> '$.source_display', message_url, external_url) AS display FROM sources WHERE entity_type = 'specialist' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) = 1) y ON y.entity_id = r.specialist_id""", extra=("matches", "sources", "registry")))
def recent_matches(spark, d):
    v, s, r = _three(spark, d)
    return V.recent_matches(table(spark, d, "matches"), v, s, table(spark, d, "sources"), r, AS_OF)


# ---- features, gates and scores by themselves ----

_WORDS = lambda kind: f"list_filter(list_transform(stack, lambda w: {_map((w, w.lower()) for w in _KINDS[kind])}[w]), lambda x: x IS NOT NULL)"


@query("primary_labels", with_tables(f"SELECT id, list_filter([{_map(_ROLE.items())}[role]], lambda x: x IS NOT NULL) AS by_role, {_WORDS('p')} AS by_stack FROM vacancies", "vacancies"))
def primary_labels(spark, d):
    v = table(spark, d, "vacancies")
    return v.select("id", M.primary_labels("role").alias("by_role"), F.flatten(F.transform("stack", M.primary_labels)).alias("by_stack"))


@query("tooling_labels", with_tables(f"SELECT id, {_WORDS('t')} AS tooling FROM specialists", "specialists"))
def tooling_labels(spark, d):
    return table(spark, d, "specialists").select("id", F.flatten(F.transform("stack", M.tooling_labels)).alias("tooling"))


@query("secondary_tokens", with_tables("SELECT id, list_filter(list_transform(list_filter(list_concat(stack, [role, grade, CAST(id AS VARCHAR), 'Developer', 'x', 'http://t.me/abc']), lambda w: w IS NOT NULL AND NOT contains(w, 't.me/')), lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND x <> 'developer') AS tokens FROM specialists", "specialists"))
def secondary_tokens(spark, d):
    words = F.array_compact(F.concat("stack", F.array("role", "grade", F.col("id").cast("string"), F.lit("Developer"), F.lit("x"), F.lit("http://t.me/abc"))))
    return table(spark, d, "specialists").select("id", F.flatten(F.transform(words, M.secondary_tokens)).alias("tokens"))


@query("match_texts", "SELECT o_orderkey, list_sort(list_distinct(list_filter(list_transform(list_concat([o_clerk || ', b/c|d'], regexp_split_to_array(o_clerk || ', b/c|d', '[\n,;/|]'), ['see t.me', o_orderpriority], regexp_split_to_array(o_orderpriority, '[\n,;/|]|\\s{2,}')), lambda x: trim(x)), lambda x: x <> ''))) AS texts FROM (SELECT o_orderkey, 'Clerk ' || o_custkey AS o_clerk, o_orderpriority FROM orders) o")
def match_texts(spark, d):
    clerk = F.concat(F.lit("Clerk "), "o_custkey", F.lit(", b/c|d"))
    return table(spark, d, "orders").select("o_orderkey", F.array_sort(M.match_texts(F.array(clerk, F.lit("see t.me/"), F.col("o_orderpriority"), F.lit("B")))).alias("texts"))


_SIDES = "SELECT m.vacancy_id, m.specialist_id, {} FROM matches m JOIN f_v v ON v.id = m.vacancy_id JOIN f_s s ON s.id = m.specialist_id"


def _pairs(spark, d):
    """The stored matches with the features of both sides."""
    v, s, _ = _three(spark, d)
    m = table(spark, d, "matches").select("vacancy_id", "specialist_id")
    f = lambda t, kind, name, key: P.carried(t, kind, AS_OF).select(F.struct("*").alias(name), F.col("id").alias(key))
    return m.join(f(v, "VACANCY", "v", "vacancy_id"), "vacancy_id").join(f(s, "BENCH", "s", "specialist_id"), "specialist_id")


def _pair(name: str, sql: str):
    return query(name, features_sql(_SIDES.format(sql + " AS value"), extra=("matches",)))


@_pair("stack_gate", "len(list_intersect(v.prim, s.prim)) > 0 AND len(list_intersect(list_concat(v.prim, v.sec, v.tool), list_concat(s.prim, s.sec, s.tool))) > 0")
def stack_gate(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", P.stack_gate().alias("value"))


@_pair("format_gate", "len(v.fmt) = 0 OR len(s.fmt) = 0 OR len(list_intersect(v.fmt, s.fmt)) > 0")
def format_gate(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", M.format_gate("v.work_formats", "s.work_formats").alias("value"))


@_pair("grade_score", "CAST(CASE WHEN v.lvl IS NULL THEN 0.5 WHEN s.lvl IS NULL THEN 0 ELSE coalesce([1.0, 0.6, 0.25][abs(v.lvl - s.lvl) + 1], 0) END AS DOUBLE)")
def grade_score(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", M.grade_score("v.grade_level", "s.grade_level").alias("value"))


@_pair("grade_gate", "CASE WHEN v.lvl IS NULL THEN TRUE WHEN s.lvl IS NULL THEN FALSE ELSE abs(v.lvl - s.lvl) <= 2 END")
def grade_gate(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", (M.grade_score("v.grade_level", "s.grade_level") > 0).alias("value"))


@_pair("secondary_score", "least(1.0, len(list_intersect(v.sec, s.sec)) / CAST(greatest(1, least(len(list_distinct(v.sec)), 3)) AS DOUBLE))")
def secondary_score(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", M.secondary_score("v.secondary_tokens", "s.secondary_tokens").alias("value"))


@_pair("rate_score", "CAST(CASE WHEN v.rate IS NULL OR s.rate IS NULL THEN 0 WHEN s.rate <= v.rate THEN 1 WHEN 10 * (s.rate - v.rate) <= v.rate THEN 0.6 WHEN 4 * (s.rate - v.rate) <= v.rate THEN 0.25 ELSE 0 END AS DOUBLE)")
def rate_score(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", M.rate_score("v.rate_anchor", "s.rate_anchor").alias("value"))


@_pair("token_intersection", "list_sort(list_intersect(list_concat(v.prim, v.sec, v.tool), list_concat(s.prim, s.sec, s.tool)))")
def token_intersection(spark, d):
    return _pairs(spark, d).select("vacancy_id", "specialist_id", F.array_sort(F.array_intersect("v.meaningful_tokens", "s.meaningful_tokens")).alias("value"))


@query("location_score", """SELECT o_orderkey, CAST(CASE WHEN len(list_intersect(a, b)) > 0 THEN 1 WHEN len(list_intersect(a, ['remote', 'remotely'])) > 0 AND len(list_intersect(b, ['remote', 'remotely'])) > 0 THEN 1
 WHEN len(list_intersect(a, ['rf', 'russia', 'ru'])) > 0 AND len(list_intersect(b, ['rf', 'russia', 'ru'])) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM (SELECT o_orderkey, [['remote', 'kazan'], ['moscow', 'rf'], ['russia'], ['berlin'], []][o_orderkey % 5 + 1] AS a,
 [['remotely'], ['ru'], ['moscow'], ['remote', 'rf']][o_custkey % 4 + 1] AS b FROM orders) o""")
def location_score(spark, d):
    pick = lambda words, by, n: M.location_tokens(F.get(F.split(F.lit(words), "#"), (F.col(by) % n).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", M.location_score(pick("Remote, Kazan#Moscow / RF#Russia#Berlin#", "o_orderkey", 5), pick("remotely#RU#Moscow#remote; rf", "o_custkey", 4)).alias("score"))


@query("semantic_score", with_tables("SELECT vacancy_id, specialist_id, greatest(0.0, least(1.0, 3 * similarity_score - 1)) AS score FROM matches", "matches"))
def semantic_score(spark, d):
    return table(spark, d, "matches").select("vacancy_id", "specialist_id", M.semantic_score(F.lit(None), 3 * F.col("similarity_score") - 1).alias("score"))


@query("final_score", with_tables("SELECT vacancy_id, specialist_id, round(0.5 + 0.15 * (rank % 4) / 3 + 0.15 * (rank % 5) / 4 + 0.1 * (rank % 2) + 0.05 * (rank % 3) / 2 + 0.05 * similarity_score, 4) AS score FROM matches", "matches"))
def final_score(spark, d):
    r = F.col("rank")
    return table(spark, d, "matches").select("vacancy_id", "specialist_id", M.final_score(r % 4 / 3, r % 5 / 4, r % 2, r % 3 / 2, F.col("similarity_score")).alias("score"))


@query("legacy_rank", features_sql("""SELECT vacancy_id, specialist_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY score DESC, rate ASC NULLS LAST, g DESC, r DESC, l DESC, sec DESC, inner_flag DESC, specialist_id) AS rank FROM
 (SELECT *, round(0.50 + 0.15 * sec + 0.15 * g + 0.10 * r + 0.05 * l, 4) AS score FROM (SELECT v.id AS vacancy_id, s.id AS specialist_id, s.rate, s.inner_flag, CAST(CASE WHEN v.lvl IS NULL OR s.lvl IS NULL THEN 0 ELSE coalesce([1.0, 0.6, 0.25][abs(v.lvl - s.lvl) + 1], 0) END AS DOUBLE) AS g,
 CAST(CASE WHEN v.rate IS NULL OR s.rate IS NULL THEN 0 WHEN s.rate <= v.rate THEN 1 WHEN 10 * (s.rate - v.rate) <= v.rate THEN 0.6 WHEN 4 * (s.rate - v.rate) <= v.rate THEN 0.25 ELSE 0 END AS DOUBLE) AS r, CAST(CASE WHEN len(list_intersect(v.loc, s.loc)) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS l,
 least(1.0, len(list_intersect(w.sec, u.sec)) / CAST(greatest(1, least(len(w.sec), 3)) AS DOUBLE)) AS sec FROM f_v v JOIN (SELECT id, list_filter(sec, lambda x: NOT starts_with(x, 'workof') AND NOT starts_with(x, 'vacancy')) AS sec FROM f_v) w ON w.id = v.id
 JOIN f_s s ON len(list_intersect(v.prim, s.prim)) > 0 JOIN (SELECT id, list_filter(sec, lambda x: NOT starts_with(x, 'profileof') AND NOT starts_with(x, 'bench')) AS sec FROM f_s) u ON u.id = s.id
 WHERE len(list_intersect(list_concat(v.prim, v.tool, w.sec), list_concat(s.prim, s.tool, u.sec))) > 0) a) b) c WHERE rank <= 10"""))
def legacy_rank(spark, d):
    v, s, _ = _three(spark, d)
    return P.rank_specialists(v, s, AS_OF, 10, legacy=True).select("vacancy_id", "specialist_id", "score", "rank")
