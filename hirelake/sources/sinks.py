"""Sinks: matches with one side replaced, whole exports, and the append-only audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.joins import active_matches, active_sources
from hirelake.operators.upserts import replace_matches
from hirelake.session import cut
from hirelake.sources.files import coerced
from hirelake.sources.store import KeyedStore

AUDIT = "event_type string, actor string, entity_type string, entity_id long, payload string, created_at timestamp"


def write_matches(path: str, old: DataFrame | None, ranked: DataFrame, side: str) -> str:
    """Writes a new snapshot below ``path`` in which the rows of every affected ``side`` id are those of ranked; gives its folder. A snapshot that is read
    is never overwritten."""
    new = ranked if old is None else replace_matches(old, ranked, side)
    folder = f"{path.rstrip('/')}/matches-{uuid.uuid4().hex}"
    new.write.parquet(folder)
    return folder


def store_matches(spark: SparkSession, path: str, ranked: DataFrame, side: str, buckets: int = 256) -> list[int]:
    """Puts ranked in place of all rows of its ``side`` ids in the store below ``path`` and gives the buckets that were rewritten: those of these ids, while
    all others keep their files. Affected ids without any hit are given as rows with a null counterpart."""
    other = "specialist_id" if side == "vacancy_id" else "vacancy_id"
    rows = cut(ranked)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return KeyedStore(spark, path, schema, [side], buckets).replace(rows.select(side).distinct(), rows.where(F.col(other).isNotNull()))


def export_tables(specialists: DataFrame, vacancies: DataFrame, sources: DataFrame, matches: DataFrame, only_active: bool = False) -> dict[str, DataFrame]:
    """The four tables as an export shows them. only_active: active entities, and the sources and matches of these."""
    if only_active:
        sources, matches = active_sources(sources, vacancies, specialists), active_matches(matches, vacancies, specialists)
        specialists, vacancies = specialists.where("status = 'active'"), vacancies.where("status = 'active'")
    return {name: coerced(df) for name, df in (("specialists", specialists), ("vacancies", vacancies), ("sources", sources), ("matches", matches))}


def write_export(path: str, tables: dict[str, DataFrame], kind: str = "csv") -> None:
    """A folder for each table, newest rows first: the files in the order of their names are sorted, each by a task of its own."""
    for name, df in tables.items():
        df.orderBy(F.desc("created_at")).write.mode("overwrite").option("header", "true").format(kind).save(f"{path.rstrip('/')}/{name}")


def audit_events(rows: DataFrame, event_type: str, as_of: str, actor: str = "system", entity_type: str | None = None, entity_id: str | None = None) -> DataFrame:
    """rows as audit events: the whole row as JSON payload, the entity's id from a column."""
    return rows.select(
        F.lit(event_type).alias("event_type"), F.lit(actor).alias("actor"), F.lit(entity_type).cast("string").alias("entity_type"), (F.col(entity_id).cast("long") if entity_id else F.lit(None).cast("long")).alias("entity_id"),
        F.to_json(F.struct("*")).alias("payload"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def append_audit(path: str, events: DataFrame) -> None:
    events.write.mode("append").parquet(path)
