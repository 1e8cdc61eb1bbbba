"""A table as key buckets with a manifest: a merge rewrites the buckets that it touches and no others.

Rows lie in ``buckets`` folders by a hash of their key. A manifest names the folder of each bucket that has rows, and the last batch of each streaming
query that went in. A change writes the new folders first and then the next manifest, which is the commit: until then readers see the old state, and
what a job that died has written is named by no manifest. A manifest is created and never overwritten, so of two writers at a time one fails.
A batch that is run again is recognized by its query and number and changes nothing. A stream that starts with an empty checkpoint is a new query: its
batches are merged into the newest state, whatever their numbers.

``merge_into_table`` gives the same rules to a catalog table with row-level operations (DataFrame.mergeInto).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.upserts import RULES, merge

KEEP = 2  # manifests, and so states, that stay readable


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        """``schema`` and ``buckets`` are fixed by the first write: a store that exists keeps its number of buckets."""
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._fs = spark._jvm.org.apache.hadoop.fs
        self.buckets = (self.manifest() or {"of": buckets})["of"]

    # ---- manifests ----

    def _at(self, name: str):
        p = self._fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self) -> dict | None:
        """The newest state: version, of (buckets), folders (by bucket), batches (by query)."""
        numbers = self.versions()
        if not numbers:
            return None
        p, fs = self._at(f"manifests/{numbers[-1]:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        p, fs = self._at(f"manifests/{state['version']:012d}.json")
        stream = fs.create(p, False)  # fails if another writer was first
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()

    def _forget(self, state: dict) -> None:
        """Removes manifests beyond KEEP, and folders that no manifest names any more."""
        old = self.versions()[:-KEEP]
        named = set()
        for number in self.versions()[-KEEP:]:
            p, fs = self._at(f"manifests/{number:012d}.json")
            stream = fs.open(p)
            named |= {f.split("/")[0] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
            stream.close()
        for name in (*(f"manifests/{n:012d}.json" for n in old), *(f"data/{n}" for n in self._names("data") if n not in named)):
            p, fs = self._at(name)
            fs.delete(p, True)

    # ---- rows ----

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The newest state, or the rows of some of its buckets."""
        folders = (self.manifest() or {"folders": {}})["folders"]
        paths = [f"{self.path}/data/{f}" for b, f in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, touched: DataFrame, new: Callable[[DataFrame], DataFrame], query: str | None = None, number: int | None = None) -> list[int]:
        """Rewrites the buckets of the keys in ``touched`` with new(their old rows), whose keys must be of these buckets; gives their numbers. A batch that
        went in before (query, number) changes nothing."""
        state = self.manifest() or {"version": 0, "of": self.buckets, "folders": {}, "batches": {}}
        if query is not None and number is not None and number <= state["batches"].get(query, -1):
            return []
        hit = sorted(r.b for r in touched.select(self.bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        folders = dict(state["folders"])
        if hit:
            made = uuid.uuid4().hex
            rows = new(self.read(hit)).withColumn("_bucket", self.bucket())
            rows.repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{made}")
            full = {n[8:] for n in self._names(f"data/{made}") if n.startswith("_bucket=")}
            for b in map(str, hit):
                folders.pop(b, None)
            folders |= {b: f"{made}/_bucket={b}" for b in full}
        batches = state["batches"] | ({query: number} if query is not None and number is not None else {})
        self._commit({"version": state["version"] + 1, "of": self.buckets, "folders": folders, "batches": batches})
        self._forget(state)
        return hit

    def merge(self, batch: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], query: str | None = None, number: int | None = None) -> list[int]:
        """Puts rule(old rows of the touched buckets, batch) in their place, for instance upserts.upsert_raw_messages."""
        return self.change(batch, lambda old: rule(old, batch).select(old.columns), query, number)

    def replace(self, keys: DataFrame, rows: DataFrame, query: str | None = None, number: int | None = None) -> list[int]:
        """All rows of the given keys are replaced by ``rows``; keys without any new row lose theirs."""
        return self.change(keys, lambda old: old.join(keys.select(*self.key).distinct(), self.key, "left_anti").unionByName(rows.select(old.columns)), query, number)


def merge_into_table(table: str, batch: DataFrame, key: list[str], rules: dict[str, str], default: str = "new") -> None:
    """The merge of upserts.merge on a catalog table that has row-level operations; where it has none Spark says so."""
    from hirelake.operators.upserts import last_of_each

    names = [c for c in batch.columns if c not in key]
    source = last_of_each(batch, key).alias("source")
    on = [F.col(f"{table}.{k}") == F.col(f"source.{k}") for k in key]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    put = {c: RULES[rules.get(c, default)](F.col(f"{table}.{c}"), F.col(f"source.{c}")) for c in names}
    source.mergeInto(table, condition).whenMatched().update(put).whenNotMatched().insertAll().merge()


def snapshot(old: DataFrame, batch: DataFrame, key: list[str], rules: dict[str, str], default: str = "new") -> DataFrame:
    """The same merge as a new snapshot."""
    return merge(old, batch, key, rules, default)
