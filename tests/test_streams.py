"""The streaming jobs run as streams: late edits, batches that run again, watermarks, incremental matches; and the sinks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import upserts as U
from hirelake.plans import retrieval as V
from hirelake.sources import sinks
from hirelake.sources.store import KeyedStore, merge_into_table
from hirelake.streaming import jobs as S

AS_OF = "2024-03-01 00:00:00"
NAMES = [x.split()[0] for x in S.MESSAGE.split(", ")]
KEPT = ", ".join(x for x in S.MESSAGE.split(", ") if not x.startswith("source"))


def messages(spark, rows):
    """(message_id, text, minute, edited minute or None, source) as messages of channel 1."""
    full = [(1, i, "c", None, None, t, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", None if e is None else f"2024-01-01 {e // 60:02d}:{e % 60:02d}:00", False, None, "2024-01-01 00:00:00", s) for i, t, m, e, s in rows]
    kinds = ", ".join(f"{n} {'long' if n.endswith('_id') else 'boolean' if n == 'has_attachment' else 'string'}" for n in NAMES)
    df = spark.createDataFrame(full, kinds)
    return df.selectExpr(*[f"CAST({n} AS timestamp) AS {n}" if n in ("message_date", "edited_at", "created_at") else n for n in NAMES])


def put(spark, folder, rows):
    messages(spark, rows).coalesce(1).write.mode("append").json(folder)


def drain(stream, out, mark, mode="append"):
    q = stream.writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(out).collect()


def test_late_edits_and_batches_that_run_again(spark, tmp_path):
    source, out, mark = (os.fspath(tmp_path / x) for x in ("in", "out", "mark"))
    run = S.merge_into(out, KEPT)

    def go():
        q = S.read_messages(spark, source).writeStream.foreachBatch(run).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(120)

    put(spark, source, [(1, "one", 0, None, "source"), (2, "two", 1, None, "source")])
    go()
    put(spark, source, [(3, "three", 900, None, "source")])
    go()
    late = [(1, "one, edited much later", 0, 1200, "source_edit"), (1, "one, edited", 0, 5, "source_edit")]
    put(spark, source, late)
    go()
    store = KeyedStore(spark, out, KEPT, ["channel_id", "message_id"])
    read = lambda: {r.message_id: (r.raw_text, r.message_date.hour * 60 + r.message_date.minute) for r in store.read().collect()}
    expected = {1: ("one, edited much later", 0), 2: ("two", 1), 3: ("three", 900)}
    assert read() == expected
    run(messages(spark, late), 2)  # the last batch once more, as after a failure
    assert read() == expected
    assert len(store.versions()) == 2  # older states are gone
    mark = os.fspath(tmp_path / "another mark")  # the whole stream again, from an empty checkpoint: nothing is lost
    put(spark, source, [(4, "four", 2, None, "source")])
    go()
    assert read() == expected | {4: ("four", 2)}


def test_a_store_rewrites_the_touched_buckets_only(spark, tmp_path):
    path = os.fspath(tmp_path / "store")
    store = KeyedStore(spark, path, "id long, v string", ["id"], 8)
    put = lambda rows, **how: store.merge(spark.createDataFrame(rows, "id long, v string"), lambda o, n: U.merge(o, n, ["id"], {}), **how)
    assert len(put([(k, "a") for k in range(100)], query="q", number=0)) == 8
    before = store.manifest()
    assert len(put([(7, "b")], query="q", number=1)) == 1
    after = store.manifest()
    assert sum(before["folders"][b] != after["folders"][b] for b in before["folders"]) == 1
    assert put([(7, "c")], query="q", number=1) == [] and store.manifest() == after  # the same batch again
    put([(200, "d")], query="other", number=0)  # another query counts for itself
    assert {r.id: r.v for r in store.read().collect()} == {**{k: "a" for k in range(100)}, 7: "b", 200: "d"}
    assert KeyedStore(spark, path, "id long, v string", ["id"], 99).buckets == 8
    store.replace(spark.createDataFrame([(7,), (8,)], "id long"), spark.createDataFrame([(8, "z")], "id long, v string"))
    assert {r.id: r.v for r in store.read().where("id < 10").collect()} == {**{k: "a" for k in range(10) if k != 7}, 8: "z"}


def test_a_writer_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, os.fspath(tmp_path / "store"), "id long, v string", ["id"], 4)
    rule = lambda o, n: U.merge(o, n, ["id"], {})
    rows = lambda v: spark.createDataFrame([(k, v) for k in range(20)], "id long, v string")
    store.merge(rows("old"), rule, "q", 0)

    def die(state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", die)
        with pytest.raises(OSError):
            store.merge(rows("new"), rule, "q", 1)
    assert {r.v for r in store.read().collect()} == {"old"} and store.read().count() == 20
    store.merge(rows("new"), rule, "q", 1)
    assert {r.v for r in store.read().collect()} == {"new"}
    named = {f.split("/")[0] for f in store.manifest()["folders"].values()}
    assert named < set(store._names("data")) and len(store._names("data")) == 2  # the dead writer's folder went with the next commit
    state = store.manifest()
    with pytest.raises(Exception, match="exist"):  # another writer was first
        store._commit(state)


def test_table_without_row_level_operations_says_so(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS plain_rows (id BIGINT, v STRING) USING parquet")
    with pytest.raises(Exception, match="(?i)merge|row-level"):
        merge_into_table("plain_rows", spark.createDataFrame([(1, "a")], "id long, v string"), ["id"], {})
    spark.sql("DROP TABLE plain_rows")


def test_dedupe_within_the_watermark(spark, tmp_path):
    source = os.fspath(tmp_path / "in")
    put(spark, source, [(1, "a", 0, None, "source"), (1, "a", 0, None, "source"), (1, "a", 0, None, "backfill"), (2, "b", 1, None, "source")])
    put(spark, source, [(1, "a", 0, None, "source"), (3, "c", 2, None, "source")])
    got = drain(S.dedupe(S.read_messages(spark, source)), "deduped", os.fspath(tmp_path / "mark"))
    assert sorted((r.message_id, r.source) for r in got) == [(1, "backfill"), (1, "source"), (2, "source"), (3, "source")]


def test_progress_and_digests_equal_their_batch_forms(spark, tmp_path):
    source = os.fspath(tmp_path / "in")
    rows = [(k, "x", 60 * k, None, "source" if k % 4 else "other") for k in range(20)]
    put(spark, source, rows[:9])
    put(spark, source, rows[9:])
    batch = messages(spark, rows)
    got = drain(S.progress(S.read_messages(spark, source)), "progressed", os.fspath(tmp_path / "m1"), "complete")
    assert [(r.channel_id, r.last_message_id) for r in got] == [(r.channel_id, r.last_message_id) for r in S.progress(batch).collect()] == [(1, 19)]
    got = drain(S.digest_counts(S.read_messages(spark, source)), "digested", os.fspath(tmp_path / "m2"), "complete")
    assert {(r.day, r.n) for r in got} == {(r.day, r.n) for r in S.digest_counts(batch).collect()} and sum(r.n for r in got) == 20


ENTITY = "id long, role string, stack array<string>, grade string, rate_max int, rate_min int, location string, description string, original_text string, status string, is_internal boolean, expires_at timestamp, updated_at timestamp, embedding array<double>"


def entity(i, stack, vector, internal=False, status="active"):
    return (i, None, stack, "Senior", 3000, 2000, None, None, None, status, internal, None, None, vector)


def test_changed_vacancies_are_matched_again(spark, tmp_path):
    people = spark.createDataFrame([entity(k, ["Python"] if k % 2 else ["Go"], [1.0, k / 10]) for k in range(10)] + [entity(50, ["Python"], None)], ENTITY)
    registry = spark.createDataFrame([("k", 50, True, "u")], "registry_key string, specialist_id long, is_active boolean, source_url string")
    out = os.fspath(tmp_path / "out")
    run = S.match_changed(out, people, registry, AS_OF, 4)
    run(spark.createDataFrame([entity(1, ["Python"], [1.0, 0.0]), entity(2, ["Go"], [1.0, 0.9])], ENTITY), 0)
    read = lambda: {(r.vacancy_id, r.specialist_id): r.score for r in KeyedStore(spark, out, S.MATCHES, ["vacancy_id"]).read().collect()}
    first = read()
    assert {s for v, s in first if v == 1} == {1, 3, 50} and {s for v, s in first if v == 2} == {6, 8}
    assert first[1, 1] > first[1, 50]  # the similarity counts
    changed = spark.createDataFrame([entity(1, ["Go"], [1.0, 0.0]), entity(2, ["Rust"], [1.0, 0.0])], ENTITY)
    run(changed, 1)
    assert {k for k in read()} == {(1, 0), (1, 2)}
    run(changed, 1)
    assert {k for k in read()} == {(1, 0), (1, 2)}


def test_matches_follow_changes_of_both_sides(spark, tmp_path):
    rng = random.Random(3)
    registry = spark.createDataFrame([("k", 103, True, "u"), ("l", 104, True, "u")], "registry_key string, specialist_id long, is_active boolean, source_url string")
    changes = S.Matching(spark, os.fspath(tmp_path / "m"), ENTITY, registry, AS_OF, k=3, best=4, cap=2, buckets=4)
    sides = {"vacancies": {}, "specialists": {}}
    some = lambda i: entity(i, [rng.choice(["Python", "Go"])], [1.0, rng.random()] if rng.random() < 0.9 else None, status="hidden" if rng.random() < 0.2 else "active")
    built = []
    rebuild = changes._rebuild
    changes._rebuild = lambda ids, number: (built.append(ids.distinct().count()), rebuild(ids, number))
    for step, (kind, ids) in enumerate([("specialists", range(100, 112)), ("vacancies", range(12)), ("specialists", [105, 106]), ("vacancies", [3, 20]), ("specialists", [103])]):
        batch = [some(i) for i in ids]
        sides[kind] |= {r[0]: r for r in batch}
        getattr(changes, kind)(spark.createDataFrame(batch, ENTITY), step)
        if sides["vacancies"] and step > 1:
            v, s = (spark.createDataFrame(list(x.values()), ENTITY) for x in sides.values())
            want = V.match_specialists(v, s, registry, AS_OF, 3, 4, 3)
            read = lambda df: sorted((r.vacancy_id, r.specialist_id, r.score, r["rank"]) for r in df.collect())
            assert read(changes.read()) == read(want)
    assert built[2] < 12 and built[3] == 2 and built[4] == 13  # some vacancies, the two that changed, and all after the own bench changed


def test_retrieved_matches_pass_the_gates_and_are_few(spark):
    v = spark.createDataFrame([entity(1, ["Python"], [1.0, 0.0]), entity(2, ["Go"], None)], ENTITY)
    people = spark.createDataFrame([entity(k, ["Python"], [1.0, k / 10]) for k in range(20)] + [entity(90, ["Go"], None, True), entity(91, ["Go"], None, status="hired")], ENTITY)
    registry = spark.createDataFrame([("a", 90, True, "u"), ("b", 91, True, "u"), ("c", 3, False, "u")], "registry_key string, specialist_id long, is_active boolean, source_url string")
    got = {(r.vacancy_id, r.specialist_id): r["rank"] for r in V.match_specialists(v, people, registry, AS_OF, 5, 3).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 3, (2, 90): 1}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.3)], "vacancy_id long, specialist_id long, score double")
    new = spark.createDataFrame([(1, 9, 0.9)], old.schema)
    a = sinks.write_matches(str(tmp_path), None, old, "vacancy_id")
    b = sinks.write_matches(str(tmp_path), spark.read.parquet(a), new, "vacancy_id")
    assert a != b and sorted((r.vacancy_id, r.specialist_id) for r in spark.read.parquet(b).collect()) == [(1, 9), (2, 1)]
    events = sinks.audit_events(new, "saved", AS_OF, entity_type="vacancy", entity_id="vacancy_id")
    for _ in range(2):
        sinks.append_audit(str(tmp_path / "audit"), events)
    rows = spark.read.schema(sinks.AUDIT).parquet(str(tmp_path / "audit")).collect()
    assert len(rows) == 2 and rows[0].payload == '{"vacancy_id":1,"specialist_id":9,"score":0.9}' and rows[0].entity_id == 1


@pytest.mark.parametrize("text, kept", [("\n".join(f"line {k}" for k in range(100)), 80), ("\n".join([f"head {k}" for k in range(12)] + [f"срок {k}" if k % 2 else f"plain {k}" for k in range(60)]), 42)])
def test_relevant_lines(spark, text, kept):
    from hirelake.functions import messages as G

    out = spark.createDataFrame([(text,)], "t string").select(G.keep_relevant("t").alias("x")).first().x
    assert len([x for x in out.split("\n") if x]) == kept


def test_octal_text(spark):
    from hirelake.functions import messages as G

    rows = spark.createDataFrame([(r"a\320\277\321\200b",), (r"\303",), (r"plain \9 \\",), (None,)], "t string").select(G.octal_text("t").alias("x"))
    assert [r.x for r in rows.collect()] == ["aпрb", "�", r"plain \9 \\", ""]


def test_sheets_without_headers_and_context(spark):
    from hirelake.functions import sheets as N

    rows = spark.createDataFrame([("f", "QA specialists", k, c) for k, c in enumerate((["", ""], ["Имя", "Опыт"], ["Olga", "3"], ["full time", ""], ["Ivan", "5"]))] + [("f", "Шаблон", 0, ["Имя", "Роль"])], "file string, sheet string, row_index long, cells array<string>")
    got = {r.row_index: r for r in N.normalize_tables(rows).collect()}
    assert set(got) == {2, 3, 4} and got[2].role == "QA Engineer" and got[2].name == "Olga" and got[2].text.startswith("Entity type hint: BENCH\nИмя: Olga\nРоль: QA Engineer")


def test_entities_are_read_with_their_schema(spark, tmp_path):
    from hirelake.sources.domain import SCHEMAS, read_entities

    spark.sql("SELECT CAST(1 AS BIGINT) AS id, array('Go') AS stack, array(1.5F) AS embedding, 'x' AS more").write.parquet(str(tmp_path / "v"))
    rows = read_entities(spark, "vacancies", path=str(tmp_path / "v"))
    assert rows.columns == [c.split(" ")[0] for c in SCHEMAS["vacancies"].split(", ")] and rows.first().stack == ["Go"] and rows.first().role is None


def test_rows_without_a_whole_key_and_repeated_links_stay(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, None, "b")], "c long, m long, t string")
    batch = spark.createDataFrame([(1, 1, "n"), (1, None, "x"), (1, None, "y"), (None, None, "z")], old.schema)
    got = sorted(str(tuple(r)) for r in U.merge(old, batch, ["c", "m"], {}).collect())
    assert got == sorted(map(str, [(1, 1, "n"), (1, None, "b"), (1, None, "x"), (1, None, "y"), (None, None, "z")]))
    sources = spark.createDataFrame([(1, None, None), (2, "vacancy", 9)], "id long, entity_type string, entity_id long")
    links = spark.createDataFrame([(1, "vacancy", 5), (1, "specialist", 7)], "source_id long, entity_type string, entity_id long")
    assert sorted(map(tuple, U.link_entities(sources, links).collect())) == [(1, "specialist", 7), (2, "vacancy", 9)]


def test_stored_matches_keep_the_files_of_other_buckets(spark, tmp_path):
    path = os.fspath(tmp_path / "m")
    schema = "vacancy_id long, specialist_id long, score double"
    assert len(sinks.store_matches(spark, path, spark.createDataFrame([(v, s, 0.5) for v in range(40) for s in range(3)], schema), "vacancy_id", 8)) == 8
    store = KeyedStore(spark, path, schema, ["vacancy_id"])
    before = store.manifest()["folders"]
    assert len(sinks.store_matches(spark, path, spark.createDataFrame([(7, 99, 0.9), (7, 98, 0.8)], schema), "vacancy_id")) == 1
    after = store.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert sorted(r.specialist_id for r in store.read().where("vacancy_id = 7").collect()) == [98, 99] and store.read().count() == 39 * 3 + 2
    sinks.store_matches(spark, path, spark.createDataFrame([(7, None, None)], schema), "vacancy_id")
    assert store.read().where("vacancy_id = 7").count() == 0


def test_exports_are_whole_and_newest_first(spark, tmp_path):
    t = lambda n: f"2024-01-0{n} 10:00:00"
    e = lambda rows: spark.createDataFrame(rows, "id long, status string, stack array<string>, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    s, v = e([(1, "active", ["Go"], t(1)), (2, "hidden", None, t(3)), (3, "active", [], t(2))]), e([(1, "active", ["QA"], t(1))])
    p = spark.createDataFrame([(1, "vacancy", 1, t(1)), (2, "specialist", 2, t(2))], "id long, entity_type string, entity_id long, created_at string")
    m = spark.createDataFrame([(1, 1, t(1)), (1, 2, t(2))], "vacancy_id long, specialist_id long, created_at string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Moscow")
        moved = e([(1, "active", ["Go"], t(1))])
        sinks.write_export(str(tmp_path / "moscow"), {"specialists": sinks.export_tables(moved, v, p, m)["specialists"]})
        assert "2024-01-01T07:00:00" in spark.read.text(str(tmp_path / "moscow" / "specialists")).where("value LIKE '1%'").first().value
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    sinks.write_export(str(tmp_path / "all"), sinks.export_tables(s, v, p, m))
    read = lambda kind, name: [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / kind / name)).collect()]
    assert read("all", "specialists") == ["2", "3", "1"] and read("all", "sources") == ["2", "1"] and len(read("all", "matches")) == 2
    sinks.write_export(str(tmp_path / "active"), sinks.export_tables(s, v, p, m, only_active=True))
    assert [read("active", n) for n in ("specialists", "vacancies", "sources", "matches")] == [["3", "1"], ["1"], ["1"], ["1"]]


def test_a_moved_binding_hides_only_who_is_left_alone(spark):
    registry = spark.createDataFrame([("a", "p1", "u", 1, True), ("b", "p2", "u", 2, True), ("c", "p3", "u", 3, True), ("d", "p3", "other", 3, True), ("e", "p5", "u", 5, False)], "registry_key string, identity_key string, source_url string, specialist_id long, is_active boolean").withColumn("locator", F.lit("1"))
    sheet = spark.createDataFrame([("z", "p1", None, "1"), ("b", "p2", None, "2"), ("n", "p9", 9, "3")], "registry_key string, identity_key string, specialist_id long, locator string")
    changes = U.registry_changes(registry, sheet, "u")
    got = {r.registry_key: (r.op, r.specialist_id, r.is_active) for r in changes.collect()}
    assert got == {"a": ("move", 1, False), "z": ("insert", 1, True), "b": ("update", 2, True), "c": ("off", 3, False), "d": ("keep", 3, True), "e": ("keep", 5, False), "n": ("insert", 9, True)}
    people = spark.createDataFrame([(k, "active", True) for k in (1, 2, 3, 5)], "id long, status string, is_internal boolean")
    assert {r.id for r in U.bound_specialists(people, changes).where("status = 'hidden'").collect()} == set()
    gone = U.deactivations(U.registry_sync(registry, sheet, "u"), "u")
    assert {r.id: (r.status, r.is_internal) for r in U.bound_specialists(people, gone).collect()} == {1: ("hidden", False), 2: ("hidden", False), 3: ("active", True), 5: ("active", True)}
    assert tuple(U.change_stats(changes).first()) == (3, 2, 1, 1, 4)
