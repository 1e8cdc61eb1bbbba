"""Counts and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "processing", "completed", "failed")


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """One row for each of the four statuses, zero included."""
    counts = jobs.where(F.col("status").isin(*STATUSES)).groupBy("status").count()
    names = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return names.join(counts, "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("n"))


def overview(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias(f"n_{name}")) for name, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # one row each


def recent_imports(sources: DataFrame, limit: int) -> DataFrame:
    rows = sources.where(F.col("external_url").isNotNull() | F.col("source_type").isin("external_url", "file", "google_sheet", "manual"))
    by = rows.groupBy("source_type", "external_kind", "external_url").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    return by.orderBy(F.desc("last_at"), F.asc_nulls_first("source_type"), F.asc_nulls_first("external_url")).limit(limit)


def merge_hits(hits: DataFrame, key: list[str]) -> DataFrame:
    """Hits of several lists (group: their order) as one per key: the row of the best similarity, flags or-ed, the first non-blank link."""
    best = F.max_by(F.struct("rate_min", "location"), F.struct(F.col("sim"), -F.col("group"))).alias("b")
    link = F.min_by("source_url", F.when(F.trim("source_url") != "", F.col("group")))
    return hits.groupBy(*key).agg(best, F.max("sim").alias("sim"), F.bool_or(F.coalesce("is_internal", F.lit(False))).alias("is_internal"), F.bool_or(F.coalesce("is_own", F.lit(False))).alias("is_own"), link.alias("source_url")).select(*key, "b.*", "sim", "is_internal", "is_own", "source_url")


def active_bindings(registry: DataFrame, by: str) -> DataFrame:
    return registry.where("is_active").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def scope_counts(matches: DataFrame, specialists: DataFrame) -> DataFrame:
    """total, own and partner matches by vacancy."""
    s = specialists.select(F.col("id").alias("specialist_id"), F.coalesce("is_internal", F.lit(False)).alias("own"))
    return matches.join(s, "specialist_id").groupBy("vacancy_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("partner"))


def sync_stats(rows: DataFrame) -> DataFrame:
    """From registry rows with parse_status and is_active."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("parse_status") == "ok").alias("saved"), F.count_if(F.col("parse_status") == "failed").alias("failed"), F.count_if(~F.col("is_active")).alias("deactivated"), F.count_if("is_active").alias("active_rows"))


def import_summary(decisions: DataFrame, by: str) -> DataFrame:
    """Decided units by run: kinds counted, labels that are none of them apart."""
    kind = F.col("kind")
    return decisions.groupBy(by).agg(
        F.count_if(kind == "VACANCY").alias("vacancies"), F.count_if(kind == "BENCH").alias("specialists"), F.count_if(kind == "OTHER").alias("skipped"),
        F.count_if(kind.isNull() | ~kind.isin("VACANCY", "BENCH", "OTHER")).alias("unclassified"),
    )


def backfill_stats(sources: DataFrame, rebuilt: DataFrame, hidden: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: sources in all, rebuilt (with a new entity), relinked (to another entity than before), skipped, specialists hidden, matches rebuilt.

    rebuilt: (source_id, new_id), a null new_id where nothing could be made of the source."""
    new = rebuilt.groupBy(F.col("source_id").alias("id")).agg(F.max("new_id").alias("_new"))
    rows = sources.select("id", "entity_id").join(new, "id", "left")
    made = F.col("_new").isNotNull()
    counts = rows.agg(F.count(F.lit(1)).alias("sources_total"), F.count_if(made).alias("rebuilt"), F.count_if(made & ~F.col("_new").eqNullSafe(F.col("entity_id"))).alias("relinked"), F.count_if(~made).alias("skipped"))
    return counts.crossJoin(hidden.agg(F.count(F.lit(1)).alias("orphans_hidden"))).crossJoin(matches.agg(F.count(F.lit(1)).alias("matches_rebuilt")))  # one row each


def digest_counts(sections: DataFrame) -> DataFrame:
    """One row: the four sections of a digest counted."""
    names = ("new_vacancy", "updated_vacancy", "new_specialist", "updated_specialist")
    return sections.agg(*[F.count_if(F.col("section") == n).alias(n) for n in names])


def url_union(discovered: DataFrame, configured: DataFrame) -> DataFrame:
    """(url, position): links of both lists (url, position), trimmed, without blanks, each at its first place; configured ones come after."""
    both = discovered.select("url", F.lit(0).alias("list"), "position").unionByName(configured.select("url", F.lit(1).alias("list"), "position"))
    clean = both.select(F.trim("url").alias("url"), F.struct("list", "position").alias("at")).where("url <> ''")
    return clean.groupBy("url").agg(F.min("at").alias("at")).select("url", "at.list", "at.position")


def scope_sorted(matches: DataFrame, specialists: DataFrame, scope: str, ascending: bool, limit: int) -> DataFrame:
    """The first ``limit`` matches of a scope (own, partner or all) by score."""
    s = specialists.select(F.col("id").alias("specialist_id"), F.coalesce("is_internal", F.lit(False)).alias("own"))
    rows = matches.join(s, "specialist_id")
    rows = {"own": rows.where("own"), "partner": rows.where(~F.col("own"))}.get(scope, rows)
    by = F.asc("similarity_score") if ascending else F.desc("similarity_score")
    return rows.orderBy(by, "vacancy_id", "specialist_id").limit(limit)


def term_frequency(terms: DataFrame) -> DataFrame:
    """In how many profiles each term occurs."""
    return terms.select("kind", "profile", "term").distinct().groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


def bucket_topk(hits: DataFrame, query: str, bucket: str, order: list, k: int) -> DataFrame:
    return hits.withColumn("position", F.row_number().over(Window.partitionBy(query, bucket).orderBy(*order))).where(F.col("position") <= k)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. min_by combines before the shuffle."""
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r"))
    return first.select("r.*")


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """The page (clamped to 1..pages) with position, pages and page. The position of a row is known without a global sort: rows are ordered in
    ranges, and only the page asked for is kept by offset and limit."""
    total = rows.count()
    pages = max(1, -(-total // size))
    page = max(1, min(pages, page))
    out = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # of one page
    return out.withColumn("position", F.row_number().over(w) + (page - 1) * size).withColumn("page", F.lit(page)).withColumn("pages", F.lit(pages))


def digest_sections(vacancies: DataFrame, specialists: DataFrame, sources: DataFrame, end: str, hours: int = 24, most: int = 20) -> DataFrame:
    """section, id, role, moment, message_url, position: the newest ``most`` new and updated entities of the window that ends at ``end``."""
    stop = F.lit(end).cast("timestamp")
    start = stop - F.expr(f"INTERVAL {hours} HOURS")
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < stop)
    parts = []
    for kind, rows in (("vacancy", vacancies), ("specialist", specialists)):
        rows = rows.where(F.col("status") != "hidden")
        parts.append(rows.where(inside("created_at")).select(F.lit(f"new_{kind}").alias("section"), F.lit(kind).alias("entity_type"), "id", "role", F.col("created_at").alias("moment")))
        late = inside("updated_at") & (F.col("created_at") < start) & (F.col("updated_at") > F.col("created_at"))
        parts.append(rows.where(late).select(F.lit(f"updated_{kind}").alias("section"), F.lit(kind).alias("entity_type"), "id", "role", F.col("updated_at").alias("moment")))
    w = Window.partitionBy("section").orderBy(F.desc("moment"), F.desc("id"))
    top = reduce(lambda a, b: a.unionByName(b), parts).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    # links of the survivors only
    mine = sources.where(F.col("message_url").isNotNull()).join(F.broadcast(top.select("entity_type", F.col("id").alias("entity_id")).distinct()), ["entity_type", "entity_id"], "left_semi")
    links = mine.groupBy("entity_type", F.col("entity_id").alias("id")).agg(F.max_by("message_url", F.struct("created_at", "id")).alias("message_url"))
    return top.join(links, ["entity_type", "id"], "left").select("section", "id", "role", "moment", "message_url", "position")
