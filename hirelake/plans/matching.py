"""Matching: features once per entity, candidates by an equi-join on labels, gates, scores and ranks as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions import matching as M
from hirelake.operators.filters import active
from hirelake.session import cut, spread

#: What pairs carry of an entity; texts and vectors stay behind.
CARRIED = ("id", "is_internal", "primary_labels", "secondary_tokens", "tooling_labels", "meaningful_tokens", "catalog", "grade_level", "rate_anchor", "location_tokens", "work_formats")


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def features(entities: DataFrame, kind: str, legacy: bool = False) -> DataFrame:
    """id with its primary, secondary and tooling labels, catalog, grade level, rate, location tokens and work formats.

    kind: VACANCY keeps one primary label, BENCH all. With a column ``catalog_profile`` (see operators.catalog) that profile is the primary
    label from the role. legacy: the older rules, which look at the stack only and know no catalog."""
    none = F.array().cast("array<string>")
    texts = F.coalesce(F.col("stack"), none)
    if not legacy:
        texts = F.concat(texts, F.array_compact(F.array(_column(entities, "description"), _column(entities, "original_text"))))
    df = entities.select(
        "*",
        M.distinct_keyed(M.match_texts(texts), M.match_token).alias("_texts"),
        M.match_texts(F.array_compact(F.array("role"))).alias("_role"),
    )
    df = df.select("*", M.labels_of("_texts").alias("_labels"), F.flatten(F.transform("_role", M.primary_labels)).alias("_by_role"))
    own = F.flatten(F.transform("_labels", lambda s: s["primary"]))
    role = F.array_distinct("_by_role")
    if not legacy and "catalog_profile" in entities.columns:
        role = F.when(F.col("catalog_profile").isNotNull(), F.array("catalog_profile")).otherwise(role)
    primary = F.when(F.size(role) > 0, F.slice(role, 1, 1)).otherwise(F.slice(F.array_distinct(own), 1, 1)) if kind == "VACANCY" else F.array_distinct(F.concat(role, own))
    distinct = lambda field: F.array_distinct(F.flatten(F.transform("_labels", lambda s: s[field])))
    df = df.select(
        "*", primary.alias("primary_labels"), distinct("secondary").alias("secondary_tokens"), distinct("tooling").alias("tooling_labels"),
        M.grade_level("grade").alias("grade_level"), M.rate_anchor(_column(entities, "rate_max", "int"), _column(entities, "rate_min", "int")).alias("rate_anchor"),
        M.location_tokens("location").alias("location_tokens"),
        M.work_formats("location", _column(entities, "description"), _column(entities, "original_text"), _column(entities, "source_display")).alias("work_formats"),
    )
    catalog = F.filter("primary_labels", lambda x: F.startswith(x, F.lit("profile_")))
    plain = F.filter("primary_labels", lambda x: ~F.startswith(x, F.lit("profile_")))
    return df.select(
        "*", F.get(catalog, F.lit(0)).alias("catalog"), F.array_distinct(F.concat(plain, "secondary_tokens", "tooling_labels")).alias("meaningful_tokens")
    ).drop("_texts", "_role", "_labels", "_by_role")


def carried(entities: DataFrame, kind: str, as_of: str, legacy: bool = False, columns: tuple[str, ...] = CARRIED) -> DataFrame:
    """The features of the active entities (those of ``columns``), computed once and stored: many pairs read them."""
    df = features(spread(active(entities, as_of)), kind, legacy)
    if "is_internal" not in df.columns:
        df = df.withColumn("is_internal", F.lit(False))
    return cut(df.select(*columns))


def stack_gate(required: str = "v", candidate: str = "s") -> Column:
    r, c = (lambda n: F.col(f"{required}.{n}")), (lambda n: F.col(f"{candidate}.{n}"))
    catalogs = r("catalog").isNotNull() & c("catalog").isNotNull()
    same = F.when(catalogs, r("catalog") == c("catalog")).otherwise(F.arrays_overlap(r("primary_labels"), c("primary_labels")))
    silent = (F.size(r("meaningful_tokens")) == 0) | (F.size(c("meaningful_tokens")) == 0)
    return F.coalesce(same, F.lit(False)) & (silent | F.arrays_overlap(r("meaningful_tokens"), c("meaningful_tokens")))


def candidate_pairs(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """(v: struct, s: struct) of every pair that passes the stack gate, once each.

    The join is on one label; a pair that shares several is kept at the first of them only, so nothing has to be made distinct. A required entity
    has one label or few, so it is the smaller side, and adaptive execution splits the labels that most candidates have."""
    r = required.select(F.struct("*").alias("v"), F.explode("primary_labels").alias("label"))
    c = candidates.select(F.struct("*").alias("s"), F.explode("primary_labels").alias("label"))
    shared = F.array_intersect("v.primary_labels", "s.primary_labels")
    return r.join(c, "label").where((F.get(shared, F.lit(0)) == F.col("label")) & stack_gate()).drop("label")


def score_pairs(pairs: DataFrame, budget: str = "v", legacy: bool = False, sim: Column | None = None) -> DataFrame:
    """Gates on grade and work format and the scores. v is the required side; ``budget`` names the vacancy, whose rate is the budget."""
    ask = "s" if budget == "v" else "v"
    grade = M.grade_score("v.grade_level", "s.grade_level")
    if legacy:
        grade = F.when(F.col("v.grade_level").isNull(), 0.0).otherwise(grade)
    parts = pairs.select(
        "v", "s", M.secondary_score("v.secondary_tokens", "s.secondary_tokens").alias("secondary_score"), grade.alias("grade_score"),
        M.rate_score(f"{budget}.rate_anchor", f"{ask}.rate_anchor").alias("rate_score"), M.location_score("v.location_tokens", "s.location_tokens").alias("location_score"),
        M.semantic_score(sim if sim is not None else F.lit(None)).alias("semantic_score"),
    )
    if not legacy:
        parts = parts.where((F.col("grade_score") > 0) & M.format_gate("v.work_formats", "s.work_formats"))
    names = ("secondary_score", "grade_score", "rate_score", "location_score", "semantic_score")
    return parts.withColumn("score", M.final_score(*map(F.col, names)))


def specialist_order() -> list[Column]:
    """Best first; of equals the cheaper, a missing rate last."""
    down = [F.desc(c) for c in ("grade_score", "rate_score", "location_score", "secondary_score", "semantic_score")]
    return [F.desc("score"), F.col("s.rate_anchor").asc_nulls_last(), *down, F.desc(F.coalesce(F.col("s.is_internal"), F.lit(False))), F.col("s.id").asc()]


def vacancy_order() -> list[Column]:
    return [*[F.desc(c) for c in ("score", "grade_score", "rate_score", "location_score", "secondary_score", "semantic_score")], F.col("s.id").asc()]


def ranked(scored: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("v.id").orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


#: Tokens that stand for those which the other side never has; and tokens of both sides up to which they are broadcast, and up to which they stand in the plan.
OWN, FEW_TOKENS, NAMED_TOKENS = "\x00", 200_000, 256
COMPARED = ("primary_labels", "secondary_tokens", "meaningful_tokens", "catalog", "grade_level", "location_tokens", "work_formats")
#: What the stack gate alone compares.
GATED = ("primary_labels", "meaningful_tokens", "catalog")
#: Members of a key that are unfolded as one row where all pairs are wanted (what a row unfolds to is held at once), such rows that are moved as one, and pairs
#: that a task makes.
MEMBERS, MOVED, PAIRS = 256, 8, 50_000_000


def _words(parts: tuple[str, ...]) -> Column:
    kinds = (("s", "secondary_tokens"), ("m", "meaningful_tokens"), ("l", "location_tokens"))
    of = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"))
    return F.concat(*[F.transform(c, of(k)) for k, c in kinds if c in parts])


def _common(a: DataFrame, b: DataFrame, compared: tuple[str, ...]) -> DataFrame:
    """(kind, token) that both sides have, and the fixed ones: a token is looked for once, however many rows have it."""
    of = lambda side: side.select(F.explode(_words(compared)).alias("x")).select("x.*").distinct()
    fixed = a.sparkSession.createDataFrame([("l", t) for t in (*M.REMOTE_TOKENS, *M.RUSSIA_TOKENS)], "kind string, token string")
    return cut(of(b).join(of(a), ["kind", "token"], "left_semi").unionByName(fixed).distinct())


def _known_words(rows: DataFrame, known: DataFrame, compared: tuple[str, ...]) -> DataFrame:
    """rows with _s, _m, _l: their distinct known tokens in order (null or empty if there is none)."""
    kinds = {"s": "secondary_tokens", "m": "meaningful_tokens", "l": "location_tokens"}
    if known.limit(NAMED_TOKENS + 1).count() <= NAMED_TOKENS:
        few = known.collect()
        of = lambda kind: F.array(*[F.lit(x.token) for x in few if x.kind == kind]).cast("array<string>")
        return rows.select("*", *[F.array_sort(F.array_intersect(c, of(k)) if c in compared else of("")).alias(f"_{k}") for k, c in kinds.items()])
    known = F.broadcast(known) if known.limit(FEW_TOKENS + 1).count() <= FEW_TOKENS else known
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    kept = rows.select("_row", F.explode(_words(compared)).alias("x")).select("_row", "x.*").join(known, ["kind", "token"], "left_semi")
    kept = kept.groupBy("_row").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("token")))).alias(f"_{k}") for k in kinds])
    return rows.join(kept, "_row", "left").drop("_row")


def signed(side: DataFrame, known: DataFrame, required: bool, rate: bool, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """The features with a ``key`` that is equal for rows which no entity of the other side can tell apart.

    Tokens that the other side never has (names, running text; what is not ``known``) are taken out first; what their number decides is kept by placeholders: a
    required side counts up to three secondary tokens, and a side with some meaningful token is not silent. rate: whether the rate is part of the key. compared:
    the features by which rows are told apart."""
    rows = _known_words(side, known, compared)
    none = F.array().cast("array<string>")
    s, m, l = (F.coalesce(f"_{k}", none) for k in "sml")
    if required and "secondary_tokens" in compared:
        most = F.least(F.size(F.array_distinct("secondary_tokens")), F.lit(3))
        s = F.concat(s, F.slice(F.array(*[F.lit(OWN + n) for n in "123"]), F.lit(1), F.greatest(most - F.size(s), F.lit(0))))
    m = F.when((F.size("meaningful_tokens") > 0) & (F.size(m) == 0), F.array(F.lit(OWN + ("r" if required else "c")))).otherwise(m)
    told = {"secondary_tokens": s, "meaningful_tokens": m, "location_tokens": l, "primary_labels": F.array_sort("primary_labels"), "work_formats": F.array_sort("work_formats")}
    out = rows.withColumns({n: c for n, c in told.items() if n in compared})
    parts = [*compared, *(["rate_anchor"] if rate else [])]
    return cut(out.select("id", *[c for c in ("is_internal", "rate_anchor") if c in side.columns], *compared, F.md5(F.to_json(F.struct(*parts))).alias("key")))


def both_signed(required: DataFrame, candidates: DataFrame, r_rate: bool, c_rate: bool, compared: tuple[str, ...] = COMPARED) -> tuple[DataFrame, DataFrame]:
    """Both sides signed, each by the tokens of the other."""
    known = _common(required, candidates, compared)
    return signed(required, known, True, r_rate, compared), signed(candidates, known, False, c_rate, compared)


def _one_of_each(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.first(F.struct(*[c for c in rows.columns if c not in ("id", "key")])).alias("f")).select(F.col("key").alias("id"), "f.*")


def best_pairs(required: DataFrame, candidates: DataFrame, order: list[Column], within: list[Column], budget: str, k: int | None, rate: bool, legacy: bool = False, keep: Column | None = None) -> DataFrame:
    """(v: struct, s: struct, scores, rank): the k best candidates of each required entity, without scoring the pairs of a label.

    Entities that the other side cannot tell apart (see signed) have one key. The candidates of a key follow each other in the order ``within`` for every
    required entity, so only the first k of a key can be among any k best, and required entities of a key have the same ones. So pairs of keys are
    scored, each with the first candidate of its key; the k best keys of a required key hold its k best candidates, at most k each, which are scored and
    ranked; and the result is joined with the required entities. rate: whether candidates that differ in rate may change order. keep: what scored pairs must
    fulfil; it must hold for a candidate that comes before, within a key, one for which it holds. k None: all pairs that pass the gates."""
    r, c = both_signed(required, candidates, True, rate or k is None)
    n = F.row_number().over(Window.partitionBy("key").orderBy(*within))
    c = c.withColumn("_n", n) if k is None else cut(c.withColumn("_n", n).where(F.col("_n") <= k))
    heads = c.where(F.col("_n") == 1).drop("_n")
    scored = score_pairs(candidate_pairs(_one_of_each(r), heads), budget, legacy)
    scored = scored if keep is None else scored.where(keep)
    if k is not None:
        scored = ranked(scored, order, k)
    near = scored.select("v", F.col("s.key").alias("key"))
    members = c.select("key", F.struct(*[x for x in c.columns if x != "_n"]).alias("s"))
    every = score_pairs(near.join(members, "key").drop("key"), budget, legacy)
    every = every if keep is None else every.where(keep)
    if k is not None:
        every = ranked(every, order, k).drop("rank")
    own = r.select(F.col("key").alias("_key"), F.col("id").alias("_id"))
    out = every.join(own, F.col("v.id") == F.col("_key")).withColumn("v", F.struct(F.col("_id").alias("id"))).drop("_key", "_id")
    return ranked(out, order, k)


def taken_apart(pairs: DataFrame, required: DataFrame, candidates: DataFrame) -> DataFrame:
    """pairs (r, c: keys that meet, once each; and more) as (v_id, s_id, and more): one row for each pair of their members.

    Members are gathered into rows of about MEMBERS * MOVED ids, pairs of these are dealt to as many tasks as there are pairs to make, about PAIRS each, there cut
    into lists of MEMBERS ids, and both lists are unfolded last. So nothing but ids and the few columns of pairs is moved, no task grows with the tables, and a key
    that most rows have is no hot one."""
    spark = pairs.sparkSession
    pairs = cut(pairs)

    def sizes(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(F.col("key").alias(side)).agg(F.count(F.lit(1)).alias(f"{side}_n"))

    def gathered(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.select(F.col("key").alias(side), "id").join(sizes(rows, side), side)
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col(f"{side}_n") / (MEMBERS * MOVED))).alias("part")
        return rows.groupBy(side, part).agg(F.collect_list("id").alias(f"{side}_ids")).drop("part")

    def lists(ids: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(MEMBERS)), lambda at: F.slice(ids, at, MEMBERS))

    made = pairs.join(sizes(required, "r"), "r").join(sizes(candidates, "c"), "c").agg(F.sum(F.col("r_n") * F.col("c_n"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), made // PAIRS)
    rows = pairs.join(gathered(required, "r"), "r").join(gathered(candidates, "c"), "c").repartition(tasks)
    more = [x for x in pairs.columns if x not in ("r", "c")]
    cells = F.flatten(F.transform(lists("r_ids"), lambda r: F.transform(lists("c_ids"), lambda c: F.struct(r.alias("r_ids"), c.alias("c_ids")))))
    # coalesce moves nothing: it keeps Spark from making one loop of both steps, which would hold all that a moved row unfolds to
    rows = rows.select(F.inline(cells), *more).coalesce(tasks)
    return rows.select(F.explode("r_ids").alias("v_id"), "c_ids", *more).select("v_id", F.explode("c_ids").alias("s_id"), *more)


def gated_ids(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """(v_id, s_id) of every pair that passes the stack gate, once each: pairs of keys pass or fail it, and those that pass are taken apart."""
    r, c = both_signed(required, candidates, False, False, GATED)
    pairs = candidate_pairs(_one_of_each(r), _one_of_each(c)).select(F.col("v.id").alias("r"), F.col("s.id").alias("c"))
    return taken_apart(pairs, r, c)


def every_match(vacancies: DataFrame, specialists: DataFrame, as_of: str, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """vacancy_id, specialist_id, score parts, score of all pairs that pass the gates, and ``only`` (a filter by scores), without ranks. Pairs of keys are
    scored and filtered, and what is left is taken apart."""
    v, s = carried(vacancies, "VACANCY", as_of), carried(specialists, "BENCH", as_of)
    r, c = both_signed(v, s, True, True)
    scored = score_pairs(candidate_pairs(_one_of_each(r), _one_of_each(c)))
    scored = only(scored) if only else scored
    parts = ("secondary_score", "grade_score", "rate_score", "location_score", "score")
    out = taken_apart(scored.select(F.col("v.id").alias("r"), F.col("s.id").alias("c"), *parts), r, c)
    return out.select(F.col("v_id").alias("vacancy_id"), F.col("s_id").alias("specialist_id"), *parts)


def by_rate() -> list[Column]:
    """How the specialists of a key follow each other for every vacancy."""
    return [F.asc_nulls_last("rate_anchor"), F.desc(F.coalesce("is_internal", F.lit(False))), F.asc("id")]


def rank_specialists(vacancies: DataFrame, specialists: DataFrame, as_of: str, k: int | None = 20, legacy: bool = False, keep: Column | None = None) -> DataFrame:
    """vacancy_id, specialist_id, score parts, score, rank: the best specialists of each active vacancy."""
    v, s = carried(vacancies, "VACANCY", as_of, legacy), carried(specialists, "BENCH", as_of, legacy)
    out = best_pairs(v, s, specialist_order(), by_rate(), "v", k, False, legacy, keep)
    return out.select(F.col("v.id").alias("vacancy_id"), F.col("s.id").alias("specialist_id"), "secondary_score", "grade_score", "rate_score", "location_score", "score", "rank")


def rank_vacancies(specialists: DataFrame, vacancies: DataFrame, as_of: str, k: int | None = 20) -> DataFrame:
    """specialist_id, vacancy_id, score, rank: the best vacancies of each active specialist, who is the required side."""
    s, v = carried(specialists, "BENCH", as_of), carried(vacancies, "VACANCY", as_of)
    out = best_pairs(s, v, vacancy_order(), [F.asc("id")], "s", k, True)
    return out.select(F.col("v.id").alias("specialist_id"), F.col("s.id").alias("vacancy_id"), "grade_score", "rate_score", "score", "rank")


def rank_summary(vacancies: DataFrame, specialists: DataFrame, as_of: str) -> DataFrame:
    """vacancy_id, n, best, has_internal: how many specialists pass the gates of a vacancy, the best score, and whether one of them is internal. Pairs of keys
    are scored, and no pair of entities is made."""
    v, s = carried(vacancies, "VACANCY", as_of), carried(specialists, "BENCH", as_of)
    r, c = both_signed(v, s, True, True)
    counted = c.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce("is_internal", F.lit(False))).alias("_inner"))
    scored = score_pairs(candidate_pairs(_one_of_each(r), _one_of_each(c)), "v").select(F.col("v.id").alias("key"), F.col("s.id").alias("_s"), "score")
    by_key = scored.join(counted.withColumnRenamed("key", "_s"), "_s").groupBy("key").agg(F.sum("_n").alias("n"), F.max("score").alias("best"), F.bool_or("_inner").alias("has_internal"))
    return r.select(F.col("id").alias("vacancy_id"), "key").join(by_key, "key").drop("key")


def revalidate(stored: DataFrame, vacancies: DataFrame, specialists: DataFrame, as_of: str) -> DataFrame:
    """Stored matches scored again with the stored score as similarity; those that fail a gate now are gone."""
    v = carried(vacancies, "VACANCY", as_of).select(F.struct("*").alias("v"))
    s = carried(specialists, "BENCH", as_of).select(F.struct("*").alias("s"))
    pairs = stored.join(v, F.col("vacancy_id") == F.col("v.id")).join(s, F.col("specialist_id") == F.col("s.id")).where(stack_gate())
    keyed = pairs.withColumn("v", F.struct("v.*", F.col("similarity_score").alias("stored")))
    out = score_pairs(keyed, "v", sim=F.col("v.stored"))
    return out.select(F.col("v.id").alias("vacancy_id"), F.col("s.id").alias("specialist_id"), "score")
