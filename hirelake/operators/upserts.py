"""MERGE without a table format: a full outer join of the old snapshot and the batch gives the new snapshot.

A rule per column says what a row that is in both keeps. ``merge`` reduces a batch to its last row per key first, so a key never occurs twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {
    "new": lambda o, n: n,
    "old": lambda o, n: o,
    "fill_new": lambda o, n: F.coalesce(n, o),
    "fill_old": lambda o, n: F.coalesce(o, n),
    "or": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
    "sum": lambda o, n: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
    "greatest": lambda o, n: F.greatest(o, n),
}


def last_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return batch.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


#: Columns that tell which of a batch's rows of one key is the last, as far as the batch has them.
LAST = ("edited_at", "updated_at", "message_date", "created_at", "position", "id")


def last_of_each(batch: DataFrame, key: list[str], order: list[str] | None = None, own: bool = False) -> DataFrame:
    """The batch with its last row of each key. A key with a null in it equals no other, so such rows all stay. own: with the column ``_own`` of _numbered."""
    values = [c for c in batch.columns if c not in key]
    newest = F.struct(*[F.col(c) for c in (order or [c for c in LAST if c in values])], F.xxhash64(F.to_json(F.struct(*values)) if values else F.lit(0)))
    rows = _numbered(batch, key).groupBy(*[F.col(k).alias(f"j_{k}") for k in key], "_own").agg(F.max_by(F.struct(*values) if values else F.struct(F.lit(0).alias("_none")), newest).alias("n"))
    return rows.select(*[F.col(f"j_{k}").alias(k) for k in key], *[F.col("n")[c].alias(c) for c in values], *(["_own"] if own else []))


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """With ``_own``: 0, but a number of its own for each row that lacks a part of the key, so that such rows meet no others and are dealt evenly."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return rows.withColumn("_own", F.when(whole, F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id()))


def merge(old: DataFrame, batch: DataFrame, key: list[str], rules: dict[str, str], default: str = "new", insert: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """The new snapshot, with the columns of old. insert: values that only new rows get; columns the batch lacks stay as they are. order: what makes a row
    of the batch the last of its key (by default LAST); of rows alike in it the one with the greatest hash is taken, so that a rerun takes the same. Rows
    with a null in the key match nothing and are all inserted."""
    columns = [c for c in old.columns if c not in key]
    o = _numbered(old, key).select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("_own").alias("k_own"), F.struct(*columns).alias("o"), F.lit(True).alias("in_o"))
    values = [c for c in batch.columns if c not in key]
    n = last_of_each(batch, key, order, own=True).select(*[F.col(k).alias(f"j_{k}") for k in key], F.col("_own").alias("j_own"), F.struct(*values).alias("n"), F.lit(True).alias("in_n"))
    both = o.join(n, [F.col(f"k_{k}") == F.col(f"j_{k}") for k in [*key, "own"]], "full_outer")
    out = [F.coalesce(f"k_{k}", f"j_{k}").alias(k) for k in key]
    kinds = dict(old.dtypes)
    for c in columns:
        before = F.col(f"o.{c}")
        after = F.col(f"n.{c}") if c in batch.columns else None
        first = (insert or {}).get(c, after if after is not None else F.lit(None))
        matched = RULES[rules.get(c, default)](before, after) if after is not None else before
        out.append(F.when(F.col("in_o").isNull(), first).when(F.col("in_n").isNull(), before).otherwise(matched).cast(kinds[c]).alias(c))
    return both.select(*out)


def upsert_vacancies(old: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """A known vacancy only gets updated_at; a new one expires after 30 days and is closed at once if its status says so."""
    now = F.lit(as_of).cast("timestamp")
    fresh = batch.withColumns({"created_at": now, "updated_at": now, "expires_at": now + F.expr("INTERVAL 30 DAYS")})
    return merge(old, fresh, ["synthetic_id"], {"updated_at": "new"}, default="old")


def upsert_specialists(old: DataFrame, batch: DataFrame, as_of: str, internal: bool = False) -> DataFrame:
    """Everything is overwritten, but embedding and is_internal keep the old value where the new is null. internal: always internal."""
    now = F.lit(as_of).cast("timestamp")
    fresh = batch.withColumns({"updated_at": now, "expires_at": now + F.expr("INTERVAL 30 DAYS"), "created_at": now})
    if internal:
        fresh = fresh.withColumn("is_internal", F.lit(True))
    return merge(old, fresh, ["synthetic_id"], {"embedding": "fill_new", "is_internal": "fill_new", "created_at": "old", "id": "old"})


def touch_specialists(old: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """The older rule: updated_at, and is_internal if either says so."""
    return merge(old, batch.withColumn("updated_at", F.lit(as_of).cast("timestamp")), ["synthetic_id"], {"updated_at": "new", "is_internal": "or"}, default="old")


def insert_ignore(old: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New keys only, the first of the batch each."""
    from .aggregates import keep_first

    fresh = keep_first(batch.join(old.select(*key), key, "left_anti"), key, order)
    return old.unionByName(fresh.select(old.columns))


def upsert_raw_messages(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Titles new; sender, edit time and text new unless null; attachments stay; the message date never changes."""
    rules = {
        "chat_title": "new", "chat_username": "new", "sender_name": "fill_new", "edited_at": "fill_new", "raw_text": "fill_new",
        "has_attachment": "or", "attachment_type": "fill_old", "message_date": "old", "created_at": "old",
    }
    return merge(old, batch, ["channel_id", "message_id"], rules)


def upsert_channels(old: DataFrame, batch: DataFrame, activate: bool = True) -> DataFrame:
    fresh = batch.withColumn("is_active", F.lit(True)) if activate else batch
    return merge(old, fresh, ["telegram_id"], {"last_message_id": "old", "added_at": "old"})


def upsert_archive_map(old: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(old, batch, ["original_chat_id", "original_message_id"], {"origin": "new", "status": "new", "last_error": "new"}, default="fill_new")


def replace_matches(old: DataFrame, ranked: DataFrame, side: str) -> DataFrame:
    """All rows of the affected side are replaced. Affected ids without any hit are given as rows with a null counterpart."""
    other = "specialist_id" if side == "vacancy_id" else "vacancy_id"
    rest = old.join(ranked.select(side).distinct(), side, "left_anti")
    return rest.unionByName(ranked.where(F.col(other).isNotNull()).select(old.columns))


def upsert_matches_keep(old: DataFrame, ranked: DataFrame) -> DataFrame:
    return merge(old, ranked, ["vacancy_id", "specialist_id"], {"created_at": "old"})


def add_partner_counts(old: DataFrame, batch: DataFrame) -> DataFrame:
    good = batch.where((F.trim("canonical_name") != "") & (F.col("mentions_count") > 0))
    one = good.groupBy("canonical_name").agg(F.sum("mentions_count").alias("mentions_count"), F.max("source_url").alias("source_url"))
    return merge(old, one, ["canonical_name"], {"mentions_count": "sum", "source_url": "fill_new"})


def upsert_registry(old: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(old, batch.withColumn("is_active", F.lit(True)), ["registry_key"], {"specialist_id": "fill_new"})


def upsert_registry_sources(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Provenance of registry rows (source_url, locator and more): keyed by the numbers of the link and of link and place, overwritten by the batch."""
    from hirelake.functions.identity import source_ids

    ids = source_ids("source_url", "locator")
    rows = batch.withColumns({"channel_id": ids["channel_id"], "message_id": ids["message_id"], "external_url": F.col("source_url"), "external_locator": F.col("locator")})
    return merge(old, rows.drop("source_url", "locator"), ["channel_id", "message_id"], {}, order=["external_locator"])


def upsert_settings(old: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    return merge(old, batch.withColumn("updated_at", F.lit(as_of).cast("timestamp")), ["key"], {})


def bump_progress(channels: DataFrame, messages: DataFrame) -> DataFrame:
    """last_message_id is the greatest of what was stored and what came."""
    top = messages.groupBy(F.col("channel_id").alias("telegram_id")).agg(F.max("message_id").alias("_top"))
    return channels.join(top, "telegram_id", "left").withColumn("last_message_id", F.greatest(F.coalesce("last_message_id", F.lit(0)), F.coalesce("_top", F.lit(0)))).drop("_top")


def soft_hide(entities: DataFrame, sources: DataFrame, url: str, entity_type: str, as_of: str) -> DataFrame:
    """Entities with a source of that link become hidden."""
    ids = sources.where((F.col("entity_type") == entity_type) & ((F.col("message_url") == url) | (F.col("external_url") == url))).select(F.col("entity_id").alias("_hid")).distinct()
    rows = entities.join(ids, F.col("id") == F.col("_hid"), "left")
    hit = F.col("_hid").isNotNull()
    return rows.withColumn("status", F.when(hit, "hidden").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))).drop("_hid")


def deactivate_source(registry: DataFrame, url: str) -> DataFrame:
    return registry.withColumn("is_active", F.col("is_active") & (F.coalesce("source_url", F.lit("")) != url))


def stale_keys(registry: DataFrame, seen: DataFrame, url: str) -> DataFrame:
    return registry.where(F.col("is_active") & (F.col("source_url") == url)).select("registry_key").join(seen.select("registry_key"), "registry_key", "left_anti")


def registry_changes(registry: DataFrame, sheet: DataFrame, url: str) -> DataFrame:
    """A sheet as change data: the registry's new rows with ``op``. insert and update: rows seen, stored as active; move: the row of a person who is seen under
    another key; off: a key that the sheet no longer has; both go inactive; keep: all else. A row without a specialist keeps the one bound by its key or person."""
    from .joins import registry_binding

    seen = registry_binding(last_per_key(sheet, ["registry_key"], ["locator"]), registry)
    seen = seen.withColumn("specialist_id", F.coalesce("specialist_id", "bound_id")).drop("bound_id").withColumn("source_url", F.lit(url))
    out = upsert_registry(registry, seen)
    keys = seen.select("registry_key", F.lit(True).alias("_seen"))
    people = seen.select("identity_key").where(F.col("identity_key").isNotNull()).distinct().withColumn("_moved", F.lit(True))
    known = registry.groupBy("registry_key").agg(F.bool_or("is_active").alias("_was"))
    rows = out.join(keys, "registry_key", "left").join(people, "identity_key", "left").join(known, "registry_key", "left")
    was = F.coalesce("_was", F.lit(False))
    op = F.when(F.col("_seen"), F.when(F.col("_was").isNull(), "insert").otherwise("update")).when(was & F.coalesce("_moved", F.lit(False)), "move").when(was & (F.col("source_url") == url), "off").otherwise("keep")
    rows = rows.withColumn("op", op)
    return rows.withColumn("is_active", F.col("is_active") & ~F.col("op").isin("move", "off")).select(*registry.columns, "op")


def registry_sync(registry: DataFrame, sheet: DataFrame, url: str) -> DataFrame:
    """The registry after a sheet was read (see registry_changes)."""
    return registry_changes(registry, sheet, url).drop("op")


def deactivations(registry: DataFrame, url: str) -> DataFrame:
    """Change data of a source that goes: its active rows are off."""
    off = F.coalesce(F.col("is_active") & (F.col("source_url") == url), F.lit(False))
    return registry.withColumn("op", F.when(off, "off").otherwise("keep")).withColumn("is_active", F.col("is_active") & ~off)


def bound_specialists(specialists: DataFrame, changes: DataFrame) -> DataFrame:
    """The specialists after changes of the registry: of those whose rows moved or went off the ones that no active row binds any more are not internal, and
    hidden if they were active; all others stay. One semi-join with the few ids that changed."""
    left = changes.where(F.col("op").isin("move", "off") & F.col("specialist_id").isNotNull()).select(F.col("specialist_id").alias("id")).distinct()
    bound = changes.where("is_active").select(F.col("specialist_id").alias("id"))
    gone = left.join(bound, "id", "left_anti").withColumn("_gone", F.lit(True))
    rows = specialists.join(gone, "id", "left")
    out = F.col("_gone").isNotNull()
    inner = F.when(out, F.lit(False)).otherwise(F.col("is_internal"))
    return rows.withColumns({"is_internal": inner, "status": F.when(out & (F.col("status") == "active"), "hidden").otherwise(F.col("status"))}).select(specialists.columns)


def change_stats(changes: DataFrame) -> DataFrame:
    """One row: rows seen, inserted, moved and gone off, and active rows in all."""
    n = lambda *ops: F.count_if(F.col("op").isin(*ops))
    return changes.agg(n("insert", "update").alias("saved"), n("insert").alias("inserted"), n("move").alias("moved"), n("off").alias("deactivated"), F.count_if("is_active").alias("active_rows"))


def relink(sources: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """sources with entity_id of the rebuilt (source_id, new_id) where it differs."""
    new = rebuilt.groupBy(F.col("source_id").alias("id")).agg(F.max("new_id").alias("_new"))
    return sources.join(new, "id", "left").withColumn("entity_id", F.coalesce("_new", "entity_id")).drop("_new").select(sources.columns)


def link_entities(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_type, entity_id) of the links (source_id, entity_type, entity_id) put on their source rows; of several links of a source the one with the
    greatest entity id, then type."""
    last = F.max(F.struct(F.col("entity_id").alias("_e"), F.col("entity_type").alias("_t"))).alias("l")
    new = links.groupBy(F.col("source_id").alias("id")).agg(last).select("id", "l.*")
    return sources.join(new, "id", "left").withColumns({"entity_type": F.coalesce("_t", "entity_type"), "entity_id": F.coalesce("_e", "entity_id")}).select(sources.columns)
