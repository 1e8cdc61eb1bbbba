"""Joins over provenance, registry and matches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import cut

KEY = ["entity_type", "entity_id"]
#: Names of partners in an automaton.
NAMES = 100_000


def latest_source(sources: DataFrame) -> DataFrame:
    """entity_type, entity_id and the newest source's links and names.

    An aggregate on the newest row, which is combined before the shuffle, so entities with many sources are no hot groups."""
    last = F.max_by(F.struct("message_url", "external_url", "source_meta", "chat_title", "sender_name"), F.struct("created_at", "id")).alias("s")
    display = F.coalesce(F.get_json_object("s.source_meta", "$.source_display"), "s.message_url", "s.external_url")
    rows = sources.where(F.col("entity_id").isNotNull()).groupBy(*KEY).agg(last)
    return rows.select(*KEY, "s.message_url", display.alias("source_display"), "s.chat_title", "s.sender_name")


def latest_source_url(sources: DataFrame) -> DataFrame:
    """The newest row's external or message link, and the newest message link that is not null."""
    order = F.struct("created_at", "id")
    return sources.where(F.col("entity_id").isNotNull()).groupBy(*KEY).agg(
        F.max_by(F.coalesce("external_url", "message_url"), order).alias("source_url"),
        F.max_by("message_url", F.when(F.col("message_url").isNotNull(), order)).alias("message_url"),
    )


def with_latest_source(entities: DataFrame, sources: DataFrame, entity_type: str) -> DataFrame:
    last = latest_source(sources.where(F.col("entity_type") == entity_type)).drop("entity_type")
    return entities.join(last.withColumnRenamed("entity_id", "_eid"), F.col("id") == F.col("_eid"), "left").drop("_eid")


def own_bench(specialists: DataFrame, registry: DataFrame, own_url: str | None = None) -> DataFrame:
    """specialists with is_own_bench_source: an active registry row (of the given sheet; a blank one gives none, None any) is theirs."""
    rows = registry.where("is_active")
    if own_url is not None:
        rows = rows.where((F.coalesce("source_url", F.lit("")) == own_url) & F.lit(bool(own_url)))
    ids = rows.select(F.col("specialist_id").alias("_sid")).where(F.col("_sid").isNotNull()).distinct()
    return specialists.join(ids, F.col("id") == F.col("_sid"), "left").withColumn("is_own_bench_source", F.col("_sid").isNotNull()).drop("_sid")


def import_candidates(messages: DataFrame, channels: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """Messages of active vacancy channels that are no vacancy's source yet, newest first."""
    ch = channels.where(F.col("is_active") & (F.col("source_kind") == "vacancy")).select(F.col("telegram_id").alias("channel_id"), "title")
    done = sources.where(F.col("entity_type") == "vacancy").select("channel_id", "message_id")
    rows = messages.join(ch, "channel_id").join(done, ["channel_id", "message_id"], "left_anti")
    return rows.orderBy(F.desc_nulls_last("message_date"), F.desc("created_at"), F.desc("message_id")).limit(max(1, min(1000, limit)))


def sources_with_owner(sources: DataFrame, specialists: DataFrame, skip_registry: bool = True) -> DataFrame:
    rows = sources.where(F.col("entity_type") == "specialist")
    if skip_registry:
        rows = rows.where(F.coalesce("source_type", F.lit("")) != "own_registry_sync")
    owner = specialists.select(F.col("id").alias("entity_id"), F.col("is_internal").alias("was_internal"), "status")
    inner = (F.col("source_type") == "own_registry_sync") | (F.col("external_kind") == "own_registry") | F.coalesce("was_internal", F.lit(False))
    return rows.join(owner, "entity_id", "left").withColumn("is_internal", F.coalesce(inner, F.lit(False)))


def orphans(specialists: DataFrame, sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Visible specialists without any source and without an active registry row."""
    traced = sources.where((F.col("entity_type") == "specialist") & F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("id"))
    bound = registry.where("is_active").select(F.col("specialist_id").alias("id"))
    return specialists.where(F.col("status") != "hidden").join(traced, "id", "left_anti").join(bound, "id", "left_anti")


def unbound(specialists: DataFrame, registry: DataFrame, touched: DataFrame) -> DataFrame:
    """The touched specialists without an active binding: not internal any more, and hidden if they were active."""
    bound = registry.where("is_active").select(F.col("specialist_id").alias("id"))
    rows = specialists.join(touched.select("id").distinct(), "id", "left_semi").join(bound, "id", "left_anti")
    return rows.withColumn("is_internal", F.lit(False)).withColumn("status", F.when(F.col("status") == "active", "hidden").otherwise(F.col("status")))


def active_sources(sources: DataFrame, vacancies: DataFrame, specialists: DataFrame) -> DataFrame:
    kinds = [(k, d.where("status = 'active'").select(F.col("id").alias("entity_id"))) for k, d in (("vacancy", vacancies), ("specialist", specialists))]
    v, s = (sources.where(F.col("entity_type") == k).join(ids, "entity_id", "left_semi") for k, ids in kinds)
    return v.unionByName(s)


def active_matches(matches: DataFrame, vacancies: DataFrame, specialists: DataFrame) -> DataFrame:
    rows = matches
    for name, d in (("vacancy_id", vacancies), ("specialist_id", specialists)):
        rows = rows.join(d.where("status = 'active'").select(F.col("id").alias(name)), name, "left_semi")
    return rows


def partner_mention(texts: DataFrame, partners: DataFrame, id: str, text: str) -> DataFrame:
    """id, partner: of the partners with mentions the first (most mentions, then name) whose normalized name is in the text; names that normalize to nothing
    (blanks, sectors, rates) match none. Rows may share an id.

    The names make an automaton that finds all of them in one pass over a text. Up to NAMES names are broadcast; more are dealt to automata of so many by a hash,
    each a pass of its own over the texts, which are stored once with a number for that."""
    from hirelake.functions.companies import company_name

    low = F.lower(company_name("canonical_name"))
    rows = partners.where(F.col("mentions_count") > 0).select(low.alias("needle"), (-F.col("mentions_count")).alias("m"), F.col("canonical_name").alias("name")).where(F.coalesce("needle", F.lit("")) != "")
    rows = cut(rows.groupBy("needle").agg(F.min(F.struct("m", "name")).alias("p")).select("needle", "p.*"))
    shards = max(1, -(-rows.count() // NAMES))
    hay = F.lower(F.col(text))
    kind = texts.schema[id].dataType.simpleString()
    if shards == 1:
        return texts.select(F.col(id).alias("id"), hay.alias("hay")).mapInArrow(_named(rows), f"id {kind}, m long, partner string").select(F.col("id").alias(id), "partner")
    numbered = cut(texts.select(F.col(id).alias("_id"), hay.alias("hay"), F.monotonically_increasing_id().alias("id")))
    found = None
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == k)
        hits = numbered.select("id", "hay").mapInArrow(_named(part), "id long, m long, partner string").where("partner IS NOT NULL")
        found = hits if found is None else found.unionByName(hits)
    first = found.groupBy("id").agg(F.min(F.struct("m", "partner")).alias("p"))
    return numbered.drop("hay").join(first, "id", "left").select(F.col("_id").alias(id), F.col("p.partner").alias("partner"))


def _named(names: DataFrame):
    """A task's pass over (id, hay): (id, m, partner) with the least of the names (needle, m, name) that stand in the text, or nulls."""
    shared = names.sparkSession.sparkContext.broadcast([tuple(r) for r in names.select("needle", "m", "name").collect()])  # about NAMES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle, m, name in shared.value:
            automaton.add_word(needle, (m, name))
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            best = [min((v for _, v in automaton.iter(t)), default=(None, None)) if t and len(automaton) else (None, None) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.string())], ["id", "m", "partner"])

    return run


def trigrams(x: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3))))


#: What a person and a row of their sheet have in common, and its points; pairs with fewer than 60 points are none.
POINTS = {"resume_url": 100, "name": 40, "role": 20, "location": 10}


def _combinations(least: int) -> list[tuple[int, tuple[str, ...]]]:
    names = list(POINTS)
    every = [tuple(n for k, n in enumerate(names) if bits >> k & 1) for bits in range(1, 1 << len(names))]
    return sorted(((sum(POINTS[n] for n in c), c) for c in every if sum(POINTS[n] for n in c) >= least), reverse=True)


def live_reference(people: DataFrame, rows: DataFrame) -> DataFrame:
    """person id and the best row of their sheet: 100 for one resume, 40 name, 20 role, 10 location; at least 60, the first row of equals.

    No person is compared with the rows of a sheet: each combination of parts that is worth 60 points is a key, under which the first row with these parts is kept
    (an aggregate, so a sheet or name that most rows have is no hot key), and a person looks up their keys. The best that is found is the best row, since a row
    with more in common would be found under a key with more points."""
    norm = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    given = lambda df: df.select(*[c for c in ("id", "row_index") if c in df.columns], "source_url", *[norm(F.col(c)).alias(c) for c in POINTS])
    every = _combinations(60)

    def key(score: int, names: tuple[str, ...]) -> Column:
        whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        return F.when(whole, F.struct(F.lit(score).alias("score"), F.sha2(F.to_json(F.struct("source_url", *names)), 256).alias("digest")))

    keys = F.explode(F.array_compact(F.array(*[key(score, names) for score, names in every]))).alias("k")
    first = given(rows).where(F.col("source_url").isNotNull()).select("row_index", keys).groupBy("k").agg(F.min("row_index").alias("row_index"))
    # people alike in all parts are looked up once
    alike = F.sha2(F.to_json(F.struct("source_url", *POINTS)), 256)
    asked = given(people).where(F.col("source_url").isNotNull()).withColumn("alike", alike)
    found = asked.groupBy("alike").agg(*[F.first(c).alias(c) for c in ("source_url", *POINTS)]).select("alike", keys).join(first, "k")
    best = found.groupBy("alike").agg(F.max_by(F.struct("row_index", "k.score"), F.col("k.score")).alias("b"))
    mine = asked.select("id", "alike").join(best, "alike").select("id", "b.*")
    return people.select("id").join(mine, "id", "left")


def registry_binding(seen: DataFrame, registry: DataFrame) -> DataFrame:
    """seen rows with the specialist bound so far: by registry_key, else by identity_key (the first key of it)."""
    by_key = registry.groupBy("registry_key").agg(F.min("specialist_id").alias("_k"))
    by_person = registry.groupBy("identity_key").agg(F.min_by("specialist_id", "registry_key").alias("_p"))
    return seen.join(by_key, "registry_key", "left").join(by_person, "identity_key", "left").withColumn("bound_id", F.coalesce("_k", "_p")).drop("_k", "_p")


def result_links(hits: DataFrame, links: DataFrame) -> DataFrame:
    known = links.groupBy("id").agg(F.max("url").alias("_url"))
    return hits.join(known, "id", "left").withColumn("source_url", F.coalesce(F.nullif(F.trim("source_url"), F.lit("")), "_url")).drop("_url")


def channel_identity(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """Observed channels with the stored kind and progress, by id, else by name."""
    norm = lambda c: F.lower(F.ltrim(F.col(c), F.lit("@")))
    by_id = stored.select("telegram_id", F.col("source_kind").alias("_k1"), F.col("last_message_id").alias("_m1"))
    by_name = stored.groupBy(norm("username").alias("_u")).agg(F.min_by(F.struct("source_kind", "last_message_id"), "telegram_id").alias("_s"))
    rows = observed.dropDuplicates(["telegram_id"]).join(by_id, "telegram_id", "left").join(by_name, norm("username") == F.col("_u"), "left")
    return rows.select("telegram_id", "username", F.coalesce("_k1", "_s.source_kind", F.lit("chat")).alias("source_kind"), F.coalesce("_m1", "_s.last_message_id", F.lit(0)).alias("last_message_id"))


def resume_enrichment(units: DataFrame, items: DataFrame, most: int = 8) -> DataFrame:
    """units with resume_text: the first ``most`` non-blank item texts of their resume, by position."""
    w = Window.partitionBy("resume_url").orderBy("position")
    rows = items.where(F.trim("text") != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    texts = rows.groupBy("resume_url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda s: s["text"]), "\n\n").alias("resume_text"))
    return units.join(texts, "resume_url", "left")


def validated_links(candidates: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    counts = items.groupBy("url").agg(F.count(F.lit(1)).alias("item_count"))
    rows = candidates.join(counts, "url")
    return rows.orderBy("position").limit(limit) if limit else rows


def archive_pending(messages: DataFrame, channels: DataFrame, mapping: DataFrame) -> DataFrame:
    """channel_id, message_id, kind, status: messages of chats that are to be posted to the archive (pending) or recorded as skipped (irrelevant ones), as far
    as they are not posted yet. mapping: (original_chat_id, original_message_id, status)."""
    from hirelake.streaming.jobs import classify

    chats = channels.where(F.coalesce("source_kind", F.lit("chat")) == "chat").select(F.col("telegram_id").alias("channel_id"))
    posted = mapping.where(F.col("status") == "posted").select(F.col("original_chat_id").alias("channel_id"), F.col("original_message_id").alias("message_id"))
    rows = classify(messages.join(chats, "channel_id", "left_semi").join(posted, ["channel_id", "message_id"], "left_anti"))
    return rows.select("channel_id", "message_id", "kind", F.when(F.col("kind") == "irrelevant", "skipped").otherwise("pending").alias("status"))


def find_by_url(sources: DataFrame, url: str) -> DataFrame:
    """Rows with the message link (at most 50), or if there is none with the external link (at most 100), newest first."""
    order = [F.desc("created_at"), F.desc("id")]
    exact = sources.where(F.col("message_url") == url).orderBy(*order).limit(50)
    other = sources.where(F.col("external_url") == url).orderBy(*order).limit(100)
    return exact.unionByName(other.join(exact.select(F.lit(1).alias("_x")).limit(1), F.lit(True), "left_anti"))
