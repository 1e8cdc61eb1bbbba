"""Queries of labels, gates, scores and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import matching as M
from hirelake.plans import matching as P
from hirelake.sources.domain import AS_OF, table, with_tables

from . import query

#: The SQL side knows the words of the derived tables only: the role's label, and the stack's words by kind (primary, tooling, secondary).
_ROLE = {"Python Developer": "python", "Java Developer": "java", "React Developer": "react", "QA Engineer": "qa", "DevOps Engineer": "devops", "Go Developer": "go", "System Analyst": "systemanalyst"}
_KINDS = {
    "p": ("Python", "Java", "React", "TypeScript", "QA", "DevOps", "Go"),
    "t": ("Postman",),
    "s": ("FastAPI", "PostgreSQL", "Spring", "Kafka", "Redux", "Selenium", "Kubernetes", "Terraform", "Spark", "Airflow", "gRPC", "SQL", "BPMN", "UML", "Redis", "Hibernate", "Next", "Ansible", "dbt", "REST"),
}


def _map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


_ACTIVE = f"status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"
_LEVEL = "CASE grade WHEN 'Junior' THEN 1 WHEN 'Middle' THEN 3 WHEN 'Middle+' THEN 4 WHEN 'Senior' THEN 5 WHEN 'Lead' THEN 6 END"
_WORD = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def _side(name: str, of: str, one: bool) -> str:
    """Features of one table as SQL."""
    extra = f"list_filter([{_WORD.format('description')}, {_WORD.format('original_text')}], lambda x: x IS NOT NULL)"
    words = lambda kind: f"list_filter(list_transform(stack, lambda w: {_map((w, w.lower()) for w in _KINDS[kind])}[w]), lambda x: x IS NOT NULL)"
    role = f"list_filter([{_map(_ROLE.items())}[role]], lambda x: x IS NOT NULL)"
    primary = f"CASE WHEN len({role}) > 0 THEN {role} ELSE {words('p')}[1:1] END" if one else f"list_distinct(list_concat({role}, {words('p')}))"
    rate = "rate_max" if one else "rate_min"
    inner = "FALSE" if one else "is_internal"
    return f"""{name} AS (SELECT id, {primary} AS prim, list_concat({words('s')}, {extra}) AS sec, {words('t')} AS tool, {_LEVEL} AS lvl,
 CAST({rate} AS DOUBLE) AS rate, list_filter(regexp_split_to_array(lower(location), '[\\s,;/|]+'), lambda x: x <> '') AS loc,
 list_concat(CASE WHEN location = 'Remote' THEN ['remote'] ELSE [] END, CASE WHEN location LIKE '%Hybrid' THEN ['hybrid'] ELSE [] END) AS fmt,
 {inner} AS inner_flag FROM {of} WHERE {_ACTIVE})"""


def _grade(r: str, c: str) -> str:
    return f"CASE WHEN {r}.lvl IS NULL THEN 0.5 WHEN {c}.lvl IS NULL THEN 0.0 WHEN abs({r}.lvl - {c}.lvl) = 0 THEN 1.0 WHEN abs({r}.lvl - {c}.lvl) = 1 THEN 0.6 WHEN abs({r}.lvl - {c}.lvl) = 2 THEN 0.25 ELSE 0.0 END"


def _scored(r: str, c: str) -> str:
    """Pairs of the features f_v (vacancy) and f_s with their scores; r the required side."""
    return f"""scored AS (SELECT v.id AS vacancy_id, s.id AS specialist_id, s.rate AS s_rate, s.inner_flag,
 least(1.0, len(list_intersect({r}.sec, {c}.sec)) / CAST(greatest(1, least(len(list_distinct({r}.sec)), 3)) AS DOUBLE)) AS secondary_score,
 CAST({_grade(r, c)} AS DOUBLE) AS grade_score,
 CAST(CASE WHEN v.rate IS NULL OR s.rate IS NULL THEN 0 WHEN s.rate <= v.rate THEN 1 WHEN (s.rate - v.rate) / v.rate <= 0.10 THEN 0.6 WHEN (s.rate - v.rate) / v.rate <= 0.25 THEN 0.25 ELSE 0 END AS DOUBLE) AS rate_score,
 CAST(CASE WHEN len(list_intersect(v.loc, s.loc)) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS location_score
 FROM f_v v JOIN f_s s ON len(list_intersect(v.prim, s.prim)) > 0 AND len(list_intersect(list_concat(v.prim, v.sec, v.tool), list_concat(s.prim, s.sec, s.tool))) > 0
 AND (len(v.fmt) = 0 OR len(s.fmt) = 0 OR len(list_intersect(v.fmt, s.fmt)) > 0)),
final AS (SELECT *, round(0.50 + 0.15 * secondary_score + 0.15 * grade_score + 0.10 * rate_score + 0.05 * location_score, 4) AS score FROM scored WHERE grade_score > 0)"""


_FEATURES = ",\n".join([_side("f_v", "vacancies", True), _side("f_s", "specialists", False)])


def features_sql(body: str, r: str = "v", c: str = "s", extra: tuple[str, ...] = ()) -> str:
    return with_tables("", *extra, "vacancies", "specialists").rstrip() + ",\n" + _FEATURES + ",\n" + _scored(r, c) + "\n" + body


RANKED = """SELECT vacancy_id, specialist_id, secondary_score, grade_score, rate_score, location_score, score, CAST(rank AS INT) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY score DESC, s_rate ASC NULLS LAST, grade_score DESC, rate_score DESC, location_score DESC, secondary_score DESC, inner_flag DESC, specialist_id) AS rank FROM final) t"""


@query("rank_specialists", features_sql(RANKED + " WHERE rank <= 20"))
def rank_specialists(spark, sf_dir):
    return P.rank_specialists(table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "specialists"), AS_OF)


@query("rank_vacancies", features_sql("""SELECT specialist_id, vacancy_id, grade_score, rate_score, score, CAST(rank AS INT) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY specialist_id ORDER BY score DESC, grade_score DESC, rate_score DESC, location_score DESC, secondary_score DESC, vacancy_id) AS rank FROM final) t WHERE rank <= 20""", "s", "v"))
def rank_vacancies(spark, sf_dir):
    return P.rank_vacancies(table(spark, sf_dir, "specialists"), table(spark, sf_dir, "vacancies"), AS_OF)


@query("candidate_pairs", features_sql("SELECT v.id AS vacancy_id, s.id AS specialist_id FROM f_v v JOIN f_s s ON len(list_intersect(v.prim, s.prim)) > 0"))
def candidate_pairs(spark, sf_dir):
    v, s = (P.carried(table(spark, sf_dir, t), k, AS_OF, columns=("id", *P.GATED)) for t, k in (("vacancies", "VACANCY"), ("specialists", "BENCH")))
    return P.gated_ids(v, s).select(F.col("v_id").alias("vacancy_id"), F.col("s_id").alias("specialist_id"))


@query("revalidate_matches", features_sql("""SELECT vacancy_id, specialist_id, round(0.50 + 0.15 * secondary_score + 0.15 * grade_score + 0.10 * rate_score + 0.05 * location_score + 0.05 * similarity_score, 4) AS score
 FROM final JOIN matches USING (vacancy_id, specialist_id)""", extra=("matches",)))
def revalidate_matches(spark, sf_dir):
    return P.revalidate(table(spark, sf_dir, "matches"), table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "specialists"), AS_OF)


@query("match_rank", features_sql("SELECT vacancy_id, count(*) AS n, max(score) AS best FROM final GROUP BY vacancy_id"))
def match_rank(spark, sf_dir):
    return P.rank_summary(table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "specialists"), AS_OF).select("vacancy_id", "n", "best")


@query("rebuild_matches_all_by_label", features_sql("SELECT vacancy_id, specialist_id, score AS similarity_score, rank FROM (" + RANKED + ") t WHERE rank <= 20"))
def rebuild_matches_all_by_label(spark, sf_dir):
    best = P.rank_specialists(table(spark, sf_dir, "vacancies"), table(spark, sf_dir, "specialists"), AS_OF, k=20)
    return best.select("vacancy_id", "specialist_id", F.col("score").alias("similarity_score"), "rank")


@query("normalize_grade", with_tables("SELECT id, lower(grade) AS grade, " + _LEVEL + " AS level FROM specialists", "specialists"))
def normalize_grade(spark, sf_dir):
    return table(spark, sf_dir, "specialists").select("id", M.normalize_grade("grade").alias("grade"), M.grade_level("grade").cast("int").alias("level"))


@query("match_token", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '', 'g') AS token FROM part")
def match_token(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.match_token(F.concat_ws(" ", "p_name", "p_type")).alias("token"))
