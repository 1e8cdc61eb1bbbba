"""Retrieve, then rank: nearest counterparts by vectors, united with the own bench, then gates, scores and ranks on these few only.

No step makes the pairs of a label: a query carries at most ``k`` hits and the own bench of ``cap`` rows to the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions import matching as M
from hirelake.operators import retrieve as R
from hirelake.operators.filters import active, embedded_active
from hirelake.operators.joins import own_bench, with_latest_source
from hirelake.session import cut

from . import matching as P


def own_hits(specialists: DataFrame, registry: DataFrame, as_of: str, url: str | None = None) -> DataFrame:
    """The active specialists that an active registry row binds (see own_bench)."""
    return own_bench(active(specialists, as_of), registry, url).where("is_own_bench_source")


def newest_bench(specialists: DataFrame, registry: DataFrame, as_of: str, most: int, url: str | None = None) -> DataFrame:
    """The ``most`` newest of the own bench."""
    return own_hits(specialists, registry, as_of, url).orderBy(F.desc("updated_at"), F.desc("id")).limit(most)


def near_specialists(vacancies: DataFrame, specialists: DataFrame, as_of: str, k: int) -> DataFrame:
    """vacancy_id, specialist_id, sim: the k nearest specialists of each active vacancy with a vector."""
    near = R.neighbour_join(embedded_active(vacancies, as_of), embedded_active(specialists, as_of), k)
    return near.select(F.col("query_id").alias("vacancy_id"), F.col("id").alias("specialist_id"), "sim")


def with_own_bench(near: DataFrame, vacancies: DataFrame, specialists: DataFrame, registry: DataFrame, as_of: str, most: int, url: str | None = None) -> DataFrame:
    """vacancy_id, specialist_id, sim, is_own: near united with the newest ``most`` of the own bench, a specialist once with the greater similarity."""
    bench = newest_bench(specialists, registry, as_of, most, url).select(F.col("id").alias("specialist_id"))
    ids = active(vacancies, as_of).select(F.col("id").alias("vacancy_id"))
    own = ids.crossJoin(F.broadcast(bench)).withColumns({"sim": F.lit(0.0), "is_own": F.lit(True)})  # at most ``most`` rows on the right
    return near.withColumn("is_own", F.lit(False)).unionByName(own).groupBy("vacancy_id", "specialist_id").agg(F.max("sim").alias("sim"), F.bool_or("is_own").alias("is_own"))


def specialist_hits(vacancies: DataFrame, specialists: DataFrame, registry: DataFrame, as_of: str, k: int = 20, cap: int = 100, url: str | None = None) -> DataFrame:
    """vacancy_id, specialist_id, sim, is_own: the k nearest specialists of each active vacancy with a vector, united with the newest max(k, cap) of the own bench."""
    return with_own_bench(near_specialists(vacancies, specialists, as_of, k), vacancies, specialists, registry, as_of, max(k, cap), url)


def reverse_near(vacancies: DataFrame, specialists: DataFrame, near: DataFrame, as_of: str, k: int) -> DataFrame:
    """vacancy_id of the active vacancies that would have one of the given (few) specialists among their k nearest: those that have fewer than k so far, and
    those to which one is at least as near as the k-th of ``near``. One pass over the vacancies with the specialists' vectors."""
    last = near.groupBy(F.col("vacancy_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
    asked = embedded_active(vacancies, as_of).select("id", "embedding").join(last, "id", "left")
    bound = asked.select("id", "embedding", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.0)).alias("least"))
    return R.reached(bound, embedded_active(specialists, as_of)).withColumnRenamed("id", "vacancy_id")


def vacancy_hits(specialists: DataFrame, vacancies: DataFrame, as_of: str, k: int = 20) -> DataFrame:
    """vacancy_id, specialist_id, sim: the k nearest vacancies of each active specialist with a vector."""
    near = R.neighbour_join(embedded_active(specialists, as_of), embedded_active(vacancies, as_of), k)
    return near.select(F.col("id").alias("vacancy_id"), F.col("query_id").alias("specialist_id"), "sim")


def scored_hits(hits: DataFrame, vacancies: DataFrame, specialists: DataFrame, as_of: str, required: str = "vacancy") -> DataFrame:
    """The hits that pass the gates, as structs v (the required side) and s with their scores; the hit's similarity is the semantic score. Features are
    worked out of the rows that are hit, which may be few of a side."""
    hit = lambda rows, by: rows.join(hits.select(F.col(by).alias("id")).distinct(), "id", "left_semi")
    v = P.carried(hit(vacancies, "vacancy_id"), "VACANCY", as_of).select(F.struct("*").alias("a"))
    s = P.carried(hit(specialists, "specialist_id"), "BENCH", as_of).select(F.struct("*").alias("b"))
    pairs = hits.join(v, F.col("vacancy_id") == F.col("a.id")).join(s, F.col("specialist_id") == F.col("b.id"))
    first, second, budget = ("a", "b", "v") if required == "vacancy" else ("b", "a", "s")
    pairs = pairs.select(F.struct(F.col(f"{first}.*"), F.col("sim").alias("hit")).alias("v"), F.col(second).alias("s")).where(P.stack_gate())
    return P.score_pairs(pairs, budget, sim=F.col("v.hit"))


PARTS = ("secondary_score", "grade_score", "rate_score", "location_score", "semantic_score", "score", "rank")


def match_specialists(vacancies: DataFrame, specialists: DataFrame, registry: DataFrame, as_of: str, k: int = 50, best: int = 20, cap: int = 100, url: str | None = None) -> DataFrame:
    """vacancy_id, specialist_id, the scores, rank: the ``best`` of what is retrieved for each vacancy."""
    return match_hits(cut(specialist_hits(vacancies, specialists, registry, as_of, k, cap, url)), vacancies, specialists, as_of, best)


def match_hits(hits: DataFrame, vacancies: DataFrame, specialists: DataFrame, as_of: str, best: int) -> DataFrame:
    """The ``best`` of the hits of each vacancy, scored and ranked."""
    out = P.ranked(scored_hits(hits, vacancies, specialists, as_of), P.specialist_order(), best)
    return out.select(F.col("v.id").alias("vacancy_id"), F.col("s.id").alias("specialist_id"), *PARTS)


def match_vacancies(specialists: DataFrame, vacancies: DataFrame, as_of: str, k: int = 20, best: int = 20) -> DataFrame:
    """specialist_id, vacancy_id, the scores, rank: the same for each specialist."""
    hits = cut(vacancy_hits(specialists, vacancies, as_of, k))
    out = P.ranked(scored_hits(hits, vacancies, specialists, as_of, "specialist"), P.vacancy_order(), best)
    return out.select(F.col("v.id").alias("specialist_id"), F.col("s.id").alias("vacancy_id"), *PARTS)


def recent_matches(matches: DataFrame, vacancies: DataFrame, specialists: DataFrame, sources: DataFrame, registry: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """The newest 10 * limit stored matches scored again with the stored score as similarity; of those that still pass the first ``limit``, with links and the
    own-bench flag (of any sheet)."""
    order: list[Column] = [F.desc("created_at"), F.asc("rank"), F.asc("vacancy_id"), F.asc("specialist_id")]
    newest = cut(matches.orderBy(*order).limit(10 * limit))
    again = P.revalidate(newest, vacancies, specialists, as_of)
    rows = newest.join(again, ["vacancy_id", "specialist_id"]).orderBy(*order).limit(limit)
    v = with_latest_source(vacancies.join(rows.select(F.col("vacancy_id").alias("id")).distinct(), "id", "left_semi"), sources, "vacancy")
    s = with_latest_source(specialists.join(rows.select(F.col("specialist_id").alias("id")).distinct(), "id", "left_semi"), sources, "specialist")
    s = own_bench(s, registry)
    rows = rows.join(v.select(F.col("id").alias("vacancy_id"), F.col("source_display").alias("vacancy_source")), "vacancy_id", "left")
    rows = rows.join(s.select(F.col("id").alias("specialist_id"), F.col("source_display").alias("specialist_source"), "is_own_bench_source"), "specialist_id", "left")
    return rows.select("vacancy_id", "specialist_id", "rank", "score", "vacancy_source", "specialist_source", "is_own_bench_source", "created_at")


# ---- fixed values ----
MANUAL_GRADES = ("junior", "middle", "senior", "lead")
# ---- end of fixed values ----


def manual_entities(queries: DataFrame, kind: str, profiles: DataFrame | None = None) -> DataFrame:
    """Queries (id, text, rate) as entities to be matched: the role is that of the catalog profile (profiles: id, catalog_profile, matched) or of the first
    primary label that the text holds; queries with neither are left out. kind: VACANCY or BENCH."""
    rows = queries.join(profiles, "id", "left") if profiles is not None else queries.withColumns({"catalog_profile": F.lit(None).cast("string"), "matched": F.lit(None).cast("array<string>")})
    label = F.get(M.primary_labels("text"), F.lit(0))
    rows = rows.withColumn("_label", label).where(F.col("catalog_profile").isNotNull() | F.col("_label").isNotNull())
    grade = F.coalesce(*[F.when(F.regexp_like("text", F.lit(rf"(?i)\b{g}\b")), F.lit(g.title())) for g in MANUAL_GRADES])
    rate = F.col("rate").cast("int")
    return rows.select(
        "id", F.coalesce("_label", F.trim("text")).alias("role"), F.coalesce("matched", F.array("_label")).alias("stack"), grade.alias("grade"), F.lit(None).cast("string").alias("location"), rate.alias("rate_min"), rate.alias("rate_max"),
        F.trim("text").alias("description"), F.lit(None).cast("string").alias("original_text"), "catalog_profile", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(False).alias("is_internal"),
    )


def manual_preview(queries: DataFrame, specialists: DataFrame, registry: DataFrame, as_of: str, profiles: DataFrame | None = None, limit: int = 10, url: str | None = None) -> DataFrame:
    """query_id, bucket (own or partner), specialist_id, score, position: what a text typed in would match: of all active specialists that pass the gates with a
    score over the threshold (and a rate score, if a rate is given) the first ``limit`` of each bench."""
    own = own_bench(specialists.select("id"), registry, url).where("is_own_bench_source").select("id")
    asked = manual_entities(queries.where(F.col("rate").isNull() | (F.col("rate") > 0)), "VACANCY", profiles)
    keep = (F.col("score") >= M.MATCH_THRESHOLD) & (F.col("v.rate_anchor").isNull() | (F.col("rate_score") > 0))
    out = None
    for bucket, how in (("own", "left_semi"), ("partner", "left_anti")):
        best = P.rank_specialists(asked, specialists.join(own, "id", how), as_of, limit, keep=keep)
        rows = best.select(F.col("vacancy_id").alias("query_id"), F.lit(bucket).alias("bucket"), "specialist_id", "score", F.col("rank").alias("position"))
        out = rows if out is None else out.unionByName(rows)
    return out
