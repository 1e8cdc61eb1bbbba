"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without ASCII blanks at its ends and with A-Z lower-cased; keys of at least ``least`` code points count. Documents
come in batches. ``Runs`` keeps every key seen as sorted, bucketed tables ("runs", each key in one of them), arranged in levels: a batch is
merge-anti-joined with the runs, what is new becomes a run of level 0, and ``fanout`` runs of a level are compacted into one of the next.
A key that a run holds loses its lines in the whole batch; a key new in the batch keeps those of the smallest id that has it. With batches in
ascending order of ids, as ``dedup`` makes them, the smallest id of all keeps its lines. Keys are 128-bit hashes. Runs with a ``root`` of the caller's are
kept there: documents that come later, given to ``dedup`` with ``Runs(spark, root=...)``, lose the lines of all that came before.

Defined cases: ids are integers; a null or empty text is one empty line; rows with a null id pass unchanged and count for nobody; rows sharing an id are the
same document, so they lose no line to each other; a key repeated in one document only is kept; extra columns pass unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, remove, scratch

LEAST = 10


def line_key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know exactly the six ASCII blanks and A-Z."""
    return line.strip().lower()


def _eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">i8").astype(np.int64).reshape(-1, 2)


def line_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, h1, h2): the distinct keys of each document that count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0), b.column(1)):
                own = {k for k in map(line_key, t.as_py().encode().split(b"\n")) if _eligible(k, least)}
                keys += own
                ids += [i.as_py()] * len(own)
            h = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["id", "h1", "h2"])

    rows = docs.where(F.col(id).isNotNull() & (F.length(text) >= least)).select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(of, "id long, h1 long, h2 long")


class Runs:
    """The runs below ``root`` (kept, and opened if there are some) or in a folder of the shared one (gone with close()); add() takes the next batch of (id, h1, h2)."""

    def __init__(self, spark, fanout: int = 3, buckets: int | None = None, root: str | None = None):
        self.spark, self.fanout, self.kept = spark, fanout, root is not None
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = root.rstrip("/") if root else scratch(spark, "runs")
        self.levels: list[list[str]] = []
        if self.kept:
            self._open()

    def _states(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in (fs.listStatus(folder) if fs.exists(folder) else [])]
        return sorted(int(n[6:]) for n in names if n.startswith("state-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def _open(self) -> None:
        """The runs that the newest whole state names; a catalog that does not know them is told."""
        if states := self._states():
            for r in sorted(self.spark.read.parquet(f"{self.root}/state-{states[-1]}").collect()):  # a row for each run
                while len(self.levels) <= r.level:
                    self.levels.append([])
                self.levels[r.level].append(r.name)
                if not self.spark.catalog.tableExists(r.name):
                    self.spark.sql(f"CREATE TABLE {r.name} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {r.buckets} BUCKETS LOCATION '{self.root}/{r.name}'")
                self.buckets = r.buckets

    def _save(self) -> None:
        """A new state; runs that it does not name, left over by a job that failed, are not looked at any more."""
        if self.kept:
            rows = [(level, name, self.buckets) for level, names in enumerate(self.levels) for name in names]
            self.spark.createDataFrame(rows, "level int, name string, buckets int").coalesce(1).write.parquet(f"{self.root}/state-{max(self._states(), default=-1) + 1}")

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "h1", "h2").write.option("path", f"{self.root}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.root}/{name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, keep): the batch's keys that lose lines, and the id that keeps them, null if an earlier batch does."""
        keys = batch.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        seen = F.lit(False)
        for n, run in enumerate(x for level in self.levels for x in level):
            keys = keys.join(self.spark.table(run).withColumn(f"r{n}", F.lit(True)), ["h1", "h2"], "left")
            seen = seen | F.coalesce(F.col(f"r{n}"), F.lit(False))
        keys = cut(keys.select("h1", "h2", "first", "last", seen.alias("seen")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(keys.where(~F.col("seen")).select("h1", "h2")))
        old = self._compact()
        self._save()
        for name in old:
            self._drop(name)
        return keys.where(F.col("seen") | (F.col("first") < F.col("last"))).select("h1", "h2", F.when(~F.col("seen"), F.col("first")).alias("keep"))

    def _compact(self) -> list[str]:
        """Compacts full levels; gives the runs that are not needed any more."""
        gone: list[str] = []
        for depth in range(64):
            if depth >= len(self.levels) or len(self.levels[depth]) < self.fanout:
                break
            old, self.levels[depth] = self.levels[depth], []
            rows = self.spark.table(old[0])
            for name in old[1:]:
                rows = rows.unionAll(self.spark.table(name))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(rows))
            gone += old
        return gone

    def close(self) -> None:
        if self.kept:
            return
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []
        remove(self.spark, self.root)


def losses(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, batches: int = 4, fanout: int = 3, runs: Runs | None = None) -> DataFrame:
    """(id, lost array<struct<h1, h2>>): for each document the keys whose lines it loses. runs: those of earlier documents, which these are added to."""
    spark = docs.sparkSession
    # narrow rows by id: many small partitions become few, since each batch and each join below goes over all of them
    keys = cut(line_keys(docs, id, text, least).repartition("id"))
    cuts = keys.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(cuts))
    runs = runs or Runs(spark, fanout)
    dups = []
    for n in range(len(bounds) + 1):
        batch = keys
        if n:
            batch = batch.where(F.col("id") > bounds[n - 1])
        if n < len(bounds):
            batch = batch.where(F.col("id") <= bounds[n])
        dups.append(runs.add(batch).withColumn("batch", F.lit(n)))
    runs.close()
    every = dups[0]
    for d in dups[1:]:
        every = every.unionByName(d)
    number = F.lit(0)
    for b in bounds:
        number = number + (F.col("id") > b).cast("int")
    hit = keys.withColumn("batch", number).join(every, ["batch", "h1", "h2"]).where(F.col("keep").isNull() | (F.col("keep") < F.col("id")))
    return hit.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))  # at most the lines of one document


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, **options: object) -> DataFrame:
    """The rows of docs with ``text`` rid of repeated lines, and new columns n_lines, n_dropped (replacing columns of these names)."""
    of, cuts = fresh(docs, "_lost_id"), fresh(docs, "_lost")
    lost = losses(docs, id, text, least, **options).select(F.col("id").alias(of), F.col("lost").alias(cuts))
    rows = docs.join(lost, F.col(id) == F.col(of), "left").drop(of, "n_lines", "n_dropped")
    columns = [c for c in rows.columns if c != cuts]
    at = columns.index(text)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            for t, lost in zip(b.column(at), b.column(len(columns))):
                s, drop = t.as_py(), lost.as_py()
                lines = (s or "").encode().split(b"\n")
                total.append(len(lines))
                if drop:
                    out = {(x["h1"], x["h2"]) for x in drop}
                    keys = [line_key(x) for x in lines]
                    keep = [not (_eligible(k, least) and tuple(h) in out) for k, h in zip(keys, _hashes(keys).tolist())]
                    s = b"\n".join([x for x, y in zip(lines, keep) if y]).decode()
                    gone.append(len(lines) - sum(keep))
                else:
                    gone.append(0)
                texts.append(s)
            arrays = [pa.array(texts, pa.string()) if n == at else b.column(n) for n in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_dropped"])

    kinds = dict(docs.dtypes) | {text: "string"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_lines long, n_dropped long"
    return rows.select(*columns, cuts).mapInArrow(rebuilt, schema)
