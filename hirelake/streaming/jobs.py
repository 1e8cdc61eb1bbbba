"""Structured Streaming forms of the collector's duties. Each works on any streaming DataFrame with the message columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import upserts as U
from hirelake.plans import retrieval as R
from hirelake.session import cut
from hirelake.sources.store import KeyedStore

MESSAGE = "channel_id long, message_id long, chat_title string, chat_username string, sender_name string, raw_text string, message_date timestamp, edited_at timestamp, has_attachment boolean, attachment_type string, created_at timestamp, source string"


def read_messages(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """New files of a folder as a stream of messages and edits."""
    return spark.readStream.schema(MESSAGE).format(kind).load(path)


def dedupe(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per (channel, message, source) as long as the watermark remembers it; beyond it the merge by key is idempotent."""
    return stream.withWatermark("message_date", delay).dropDuplicatesWithinWatermark(["channel_id", "message_id", "source"])


def classify(stream: DataFrame) -> DataFrame:
    """kind: bench, vacancy or irrelevant; stateless columns."""
    rows = stream.withColumn("_line", T.normalize_bench_line("raw_text")).withColumn("_s", T.bench_signals("_line"))
    hint = F.col("_s.vacancy_hint")
    bench = ((F.col("_s.confidence") >= 0.55) & ~hint) | T.has(F.coalesce("raw_text", F.lit("")), r"\b(bench|бенч\w*)\b")
    return rows.withColumn("kind", F.when(bench, "bench").when(hint, "vacancy").otherwise("irrelevant")).drop("_line", "_s")


def digest_counts(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Messages by day from 16:00 Moscow time (13:00 UTC) and channel."""
    days = F.window("message_date", "1 day", "1 day", "13 hours")
    return stream.withWatermark("message_date", delay).groupBy(days.alias("w"), "channel_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "channel_id", "n")


def interval_bucket(ts: str, minutes: int):
    """The number of the time bucket of at least five minutes."""
    return F.floor(F.unix_timestamp(ts) / (60 * max(5, minutes)))


def query_of(spark: SparkSession) -> str | None:
    """The id of the streaming query whose batch is running; None outside of one. It lasts as long as the query's checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def merge_into(path: str, versions: str, buckets: int = 64):
    """For foreachBatch: merges each batch of messages and edits into the store below ``path`` (see sources.store), of which only the touched buckets are
    rewritten. Edits may be as late as they like; a batch that is run again changes nothing. ``versions`` is the columns' schema."""

    def run(batch: DataFrame, number: int) -> None:
        store = KeyedStore(batch.sparkSession, path, versions, ["channel_id", "message_id"], buckets)
        names = [c.split(" ")[0] for c in versions.split(", ")]
        one = U.last_per_key(batch.select(names).withColumn("_at", F.coalesce("edited_at", "message_date")), ["channel_id", "message_id"], ["_at"]).drop("_at")
        store.merge(cut(one), U.upsert_raw_messages, query_of(batch.sparkSession), number)

    return run


def progress(stream: DataFrame) -> DataFrame:
    """The greatest message id of each channel; update mode."""
    return stream.where(F.col("source").isin("source", "source_edit", "backfill")).groupBy("channel_id").agg(F.max("message_id").alias("last_message_id"))


def backfill(messages: DataFrame, channels: DataFrame, as_of: str, limit: int = 200, days: int = 7) -> DataFrame:
    """Per active channel the newest ``limit`` messages beyond its progress, not older than ``days``."""
    from pyspark.sql import Window

    ch = channels.where("is_active").select(F.col("telegram_id").alias("channel_id"), F.coalesce("last_message_id", F.lit(0)).alias("_seen"))
    rows = messages.join(ch, "channel_id").where((F.col("message_id") > F.col("_seen")) & (F.col("message_date") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))
    w = Window.partitionBy("channel_id").orderBy(F.desc("message_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n", "_seen")


HITS = "vacancy_id long, specialist_id long, sim double"
MATCHES = "vacancy_id long, specialist_id long, score double, rank int"


class Matching:
    """Matches that follow changes of vacancies and of specialists; each side's batches go to its method by foreachBatch.

    Below ``path`` lie stores of both sides' rows, of what was retrieved for each vacancy (its nearest specialists), and of its matches. A changed vacancy
    is matched again. A changed specialist touches the vacancies that had them among the nearest, and those that would have them now: the stored
    similarity of the k-th neighbour is the bound of a reverse search. A change of the own bench, which is united with every vacancy's
    neighbours, or a batch of more than ``few`` specialists, touches all. Only touched vacancies are rebuilt, so after any order of
    changes the matches are those of a full rebuild. Status, text and vector are of one row each, so a batch has whole rows; a row goes by another status.

    The stores are written in the order rows, nearest, matches, and a batch is noted with the matches, which come last: a batch that died anywhere is run
    again as a whole and gives the same state."""

    def __init__(self, spark: SparkSession, path: str, schema: str, registry: DataFrame, as_of: str, k: int = 50, best: int = 20, cap: int = 100, buckets: int = 64, few: int = 4096):
        self.registry, self.as_of, self.k, self.best, self.cap, self.few = registry, as_of, k, best, cap, few
        store = lambda name, columns, key: KeyedStore(spark, f"{path}/{name}", columns, [key], buckets)
        self.rows = {kind: store(kind, schema, "id") for kind in ("vacancies", "specialists")}
        self.near, self.matches = store("near", HITS, "vacancy_id"), store("matches", MATCHES, "vacancy_id")

    def _done(self, spark: SparkSession, number: int | None) -> bool:
        state = self.matches.manifest()
        return state is not None and number is not None and number <= state["batches"].get(query_of(spark), -1)

    def _put(self, kind: str, batch: DataFrame) -> DataFrame:
        one = cut(U.last_of_each(batch, ["id"]))
        self.rows[kind].replace(one.select("id"), one)
        return one

    def _rebuild(self, ids: DataFrame, number: int | None) -> None:
        """Nearest and matches of the vacancies (vacancy_id)."""
        ids = cut(ids.distinct())
        spark = ids.sparkSession
        v = self.rows["vacancies"].read().join(ids, F.col("id") == F.col("vacancy_id"), "left_semi")
        s = self.rows["specialists"].read()
        near = cut(R.near_specialists(v, s, self.as_of, self.k))
        hits = cut(R.with_own_bench(near, v, s, self.registry, self.as_of, max(self.k, self.cap)))
        best = cut(R.match_hits(hits, v, s, self.as_of, self.best).select("vacancy_id", "specialist_id", "score", "rank"))
        self.near.replace(ids, near)
        self.matches.replace(ids, best, query_of(spark), number)

    def vacancies(self, batch: DataFrame, number: int | None = None) -> None:
        if not self._done(batch.sparkSession, number):
            self._rebuild(self._put("vacancies", batch).select(F.col("id").alias("vacancy_id")), number)

    def specialists(self, batch: DataFrame, number: int | None = None) -> None:
        if self._done(batch.sparkSession, number):
            return
        bench = lambda: self._bench().select("id")
        before = cut(bench())
        one = self._put("specialists", batch)
        changed = cut(one.select(F.col("id").alias("specialist_id")))
        on_bench = changed.join(before.unionByName(bench()).select(F.col("id").alias("specialist_id")), "specialist_id", "left_semi")
        every = self.rows["vacancies"].read()
        if changed.limit(self.few + 1).count() > self.few or on_bench.limit(1).count():
            self._rebuild(every.select(F.col("id").alias("vacancy_id")), number)
            return
        near = self.near.read()
        had = near.join(changed, "specialist_id", "left_semi").select("vacancy_id")
        now = R.reverse_near(every, one, near, self.as_of, self.k)
        self._rebuild(had.unionByName(now), number)

    def _bench(self) -> DataFrame:
        return R.newest_bench(self.rows["specialists"].read(), self.registry, self.as_of, max(self.k, self.cap))

    def read(self) -> DataFrame:
        return self.matches.read()


def match_changed(path: str, specialists: DataFrame, registry: DataFrame, as_of: str, k: int = 20):
    """For foreachBatch over changed vacancies: matches them against the given specialists and puts the matches in place of theirs in the store below ``path``."""
    def run(batch: DataFrame, number: int) -> None:
        best = R.match_specialists(batch, specialists, registry, as_of, k, k).select("vacancy_id", "specialist_id", "score", "rank")
        store = KeyedStore(batch.sparkSession, path, MATCHES, ["vacancy_id"])
        store.replace(batch.select(F.col("id").alias("vacancy_id")), cut(best), query_of(batch.sparkSession), number)

    return run
