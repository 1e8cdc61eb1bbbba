"""The rules of the domain on small examples."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hirelake.functions import identity as H
from hirelake.functions import matching as M
from hirelake.functions import sheets as N
from hirelake.functions import text as T
from hirelake.operators import aggregates as A
from hirelake.operators import joins as J
from hirelake.operators import retrieve as R
from hirelake.operators import upserts as U
from hirelake.plans import matching as P
from hirelake.sources import files
from hirelake.sources.store import KeyedStore
from hirelake.streaming import jobs as S

AS_OF = "2024-03-01 00:00:00"
ENTITY = "id long, role string, stack array<string>, grade string, rate_max int, rate_min int, location string, description string, original_text string, status string, is_internal boolean, expires_at timestamp"


def one(spark, column, *values, names="a string"):
    return spark.createDataFrame([values], names).select(column.alias("x")).first()["x"]


def entity(i, role=None, stack=(), grade=None, rate_max=None, rate_min=None, location=None, internal=False):
    return (i, role, list(stack), grade, rate_max, rate_min, location, None, None, "active", internal, None)


def ranks(spark, vacancy, *specialists, legacy=False):
    v, s = spark.createDataFrame([vacancy], ENTITY), spark.createDataFrame(list(specialists), ENTITY)
    return [r.specialist_id for r in P.rank_specialists(v, s, AS_OF, legacy=legacy).orderBy("rank").collect()]


@pytest.mark.parametrize("a, b, passes", [(["Python", "PostgreSQL"], ["Python", "Redis"], True), (["Python"], ["Java"], False), ([], ["Python"], False), (["React"], ["JavaScript", "TypeScript"], False), (["C#"], [".NET", "ASP.NET"], True)])
def test_stack_gate(spark, a, b, passes):
    got = ranks(spark, entity(1, stack=a), entity(2, stack=b, grade="Senior"), legacy=True)
    assert bool(got) == passes


def test_cheaper_of_equals_comes_first_and_missing_rate_last(spark):
    python = ["Python"]
    assert ranks(spark, entity(1, "Python Developer", python), entity(10, stack=python, rate_min=2500), entity(11, stack=python, rate_min=1800), entity(12, stack=python)) == [11, 10, 12]


def test_tooling_is_no_primary_label(spark):
    assert ranks(spark, entity(1, "Middle", ["PVS-Studio"]), entity(2, stack=["C++"]), entity(3, stack=[".NET"])) == []


def test_work_formats_must_meet(spark):
    v = entity(1, "Python Developer", ["Python"], location="Remote")
    assert ranks(spark, v, entity(2, stack=["Python"], location="office"), entity(3, stack=["Python"], location="remote")) == [3]


def test_labels_and_tokens(spark):
    assert one(spark, M.primary_labels("a"), "javascript developer") == ["javascript"]
    assert one(spark, M.primary_labels("a"), "Java / Kotlin") == ["kotlin", "java"]
    assert one(spark, M.match_token("a"), " Node.JS ") == "nodejs" and one(spark, M.match_token("a"), "удалённо") == "удалнно"
    assert one(spark, M.work_formats("a"), "Можно удаленно или офис") == ["remote", "office"]
    assert [one(spark, M.normalize_grade("a"), g) for g in ("Middle +", "Сеньор", "jun", "стажёр", "x")] == ["middle+", "senior", "junior", "intern", None]


CARD = "Go Тимур К., Senior, 7,5 лет опыта, ставка: 3100 RUB /cv_q81"


def test_bench_lines(spark):
    assert one(spark, T.normalize_bench_line("a"), "Лев —  .NET  middle +,  стаж 2,5;  1900₽ /cv_z") == "Лев - DotNet middle +, стаж 2.5; 1900 RUB CV_CODE: cv_z"
    for text, kind in ((CARD, "BENCH"), ("Ищем Senior Go, ставка 3000", "UNKNOWN"), ("Доброе утро", "UNKNOWN")):
        assert one(spark, T.pre_classify(T.bench_signals(T.normalize_bench_line("a"))), text)["kind"] == kind
    docs = spark.createDataFrame([(1, "\n".join([CARD] * 8)), (2, "Доброе утро\nпогода хорошая"), (3, None)], "id long, text string")
    assert T.split_bench_lines(docs, "id", "text").groupBy("id").count().collect() == [(1, 8)]


def test_availability(spark):
    f = lambda *v: one(spark, T.availability("a", "w", "f"), *v, names="a string, w int, f boolean")
    assert [f("на проекте до мая", None, True), f("x", 2, True), f("на бенче, available now", None, False), f("x", None, None)] == [False, False, True, True]


def test_links(spark):
    assert one(spark, T.classify_url("a"), "https://docs.google.com/spreadsheets/d/abc/edit") == "google_sheet"
    assert one(spark, T.classify_url("a"), "https://disk.yandex.ru/i/x") == "yandex_disk_public"
    assert one(spark, T.url_allowed("a"), "http://localhost:80/x") is False and one(spark, T.url_allowed("a"), "http://192.168.1.4/") is False
    assert one(spark, T.url_allowed("a", ("google.com",)), "https://docs.google.com/x") is True
    private = ("http://[::1]/", "http://[fd00::1]:80/", "http://[fe80::2]/x", "http://[::ffff:10.0.0.1]/", "http://10.1.2.3:8080/", "http://172.20.0.1", "http://224.0.0.1/", "http://me@127.0.0.1/", "http://printer.local/", "ftp://a.com/", "no link", "http://[0:0:0:0:0:0:0:1]/")
    public = ("http://10.example.com/", "HTTP://a.com/", "https://[2a00:1450::1]/x", "http://172.32.0.1/", "http://8.8.8.8", "http://127.0.0.1.example.com/")
    rows = spark.createDataFrame([(x,) for x in private + public], "a string").select("a", T.url_allowed("a").alias("ok")).collect()
    assert {r.a for r in rows if r.ok} == set(public)
    wrapped = "https://docs.google.com/spreadsheets/d/1abc\nDEF/edit7gid=12"
    assert one(spark, T.extract_urls("a"), wrapped) == ["https://docs.google.com/spreadsheets/d/1abcDEF/edit?gid=12"]
    assert one(spark, T.export_url("a"), "https://docs.google.com/spreadsheets/d/q/edit#gid=7") == "https://docs.google.com/spreadsheets/d/q/export?format=csv&gid=7"
    assert one(spark, T.canonical_message_url("a"), "see t.me/chan/15?single") == "https://t.me/chan/15"


def test_identity(spark):
    f = lambda link, name: one(spark, H.specialist_identity("a", "n", F.lit("Dev"), F.lit("RF"), F.array(F.lit("Go")), F.lit(None).cast("string"), F.lit(None).cast("int")), link, name, names="a string, n string")
    assert f("http://x/1", "A") == f("HTTP://X/1", "B") != f("http://x/2", "A")
    assert f(None, "A  B") == f("", " a b ") != f(None, "C")
    none = F.lit(None).cast("string")
    g = lambda urls, low, high: one(spark, H.specialist_identity(none, none, F.lit("Dev"), F.lit("RF"), F.array(F.lit("Go")), none, "l", "u", "h"), urls, low, high, names="u array<string>, l int, h int")
    assert g([" ", "HTTP://x/1"], 1, 2) == f("http://x/1", None)
    assert g([], None, 25000) == g(None, 0, 25000) == g([], 27000, 1) != g([], 1, 25000)


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("k1", 1, "a"), ("k2", 2, None)], "registry_key string, specialist_id long, raw_text string").withColumn("is_active", F.lit(False))
    new = spark.createDataFrame([("k2", None, "b"), ("k3", 3, "c")], "registry_key string, specialist_id long, raw_text string")
    once = U.upsert_registry(old, new)
    rows = sorted(once.collect())
    assert rows == [("k1", 1, "a", False), ("k2", 2, "b", True), ("k3", 3, "c", True)]
    assert sorted(U.upsert_registry(once, new).collect()) == rows


def test_a_batch_with_repeated_keys_gives_each_key_once(spark):
    old = spark.createDataFrame([("k", 1, "a")], "registry_key string, specialist_id long, raw_text string").withColumn("is_active", F.lit(True))
    batch = spark.createDataFrame([("k", 2, "b"), ("k", 3, "c"), ("n", 4, "d"), ("n", 5, "e"), ("n", 5, "e")], "registry_key string, specialist_id long, raw_text string").repartition(3)
    rows = sorted(U.upsert_registry(old, batch).collect())
    assert [r.registry_key for r in rows] == ["k", "n"] and rows == sorted(U.upsert_registry(old, batch.repartition(2)).collect()) == sorted(U.upsert_registry(U.upsert_registry(old, batch), batch).collect())
    names = "channel_id long, message_id long, chat_title string, chat_username string, sender_name string, raw_text string, message_date string, edited_at string, has_attachment boolean, attachment_type string, created_at string"
    edits = spark.createDataFrame([(1, 1, "t", None, None, x, "2024", e, False, None, "2024") for x, e in (("first", "2024-01"), ("last", "2024-03"), ("between", "2024-02"))], names)
    assert [r.raw_text for r in U.upsert_raw_messages(edits.limit(0), edits).collect()] == ["last"]


@pytest.mark.parametrize("few", [100_000, 2])
def test_partner_names_are_normalized_and_blank_ones_match_nothing(spark, few, monkeypatch):
    monkeypatch.setattr(J, "NAMES", few)
    texts = spark.createDataFrame([(1, "Работа в SBERTECH"), (2, "acme and bolt"), (3, "Финтех"), (4, None), (5, "x3m"), (6, "рост сбера")], "id long, t string")
    names = spark.createDataFrame([("  ", 99), ("Финтех", 50), (" Bolt. ", 3), ("acme", 3), ("x3", 1), ("Sber CIB", 7), ("gone", 0)], "canonical_name string, mentions_count long")
    got = dict(J.partner_mention(texts, names, "id", "t").collect())
    assert got == {1: None, 2: " Bolt. ", 3: None, 4: None, 5: "x3", 6: "Sber CIB"}


def test_lexical_search_equals_a_plain_scan(spark):
    from hirelake.operators import filters as L

    rows = [entity(k, role) for k, role in enumerate(("Python Dev", "Go", "Data 100%", "a_b", "React"))]
    people = spark.createDataFrame(rows, ENTITY).withColumn("updated_at", F.col("id"))
    queries = spark.createDataFrame([(1, "PYTHON"), (2, "o"), (3, "a%e"), (4, "thon_dev"), (5, "nothing here"), (6, "")], "query_id long, query string")
    got = sorted((r.query_id, r.id) for r in L.lexical_search(people, queries, 9, AS_OF).collect())
    import re

    like = lambda q: re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower()) + ".*", re.S)
    assert got == sorted((r.query_id, k) for r in queries.collect() for k, e in enumerate(rows) if like(r.query).fullmatch(e[1].lower()))


def test_merged_hits_and_pages(spark):
    hits = spark.createDataFrame([(1, 0.73, 1, False, False, ""), (1, 0.0, 2, True, True, "u")], "id long, sim double, group long, is_internal boolean, is_own boolean, source_url string").withColumns({"rate_min": F.lit(1), "location": F.lit("x")})
    r = A.merge_hits(hits, ["id"]).first()
    assert (r.sim, r.is_internal, r.is_own, r.source_url) == (0.73, True, True, "u")
    assert [r.position for r in A.paginate(spark.range(25), [F.asc("id")], 3, 10).collect()] == [21, 22, 23, 24, 25]


def test_live_reference_takes_the_right_row(spark):
    people = spark.createDataFrame([(1, "s", "http://cv", "Анна", "QA", "RF"), (2, "s", None, "Nobody", None, None)], "id long, source_url string, resume_url string, name string, role string, location string")
    rows = spark.createDataFrame([("s", 3, None, "Пётр", "QA", "RF"), ("s", 8, "http://cv", "анна", "qa", "rf")], "source_url string, row_index int, resume_url string, name string, role string, location string")
    assert {r.id: r.row_index for r in J.live_reference(people, rows).collect()} == {1: 8, 2: None}


def test_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None), (98, [0.0] * 8), (97, [1.0])], "id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r["rank"]): r.id for r in R.vector_topk(df.where("id < 7"), df, 5, block=3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(7):
        assert [got[q, k + 1] for k in range(5)] == np.argsort(-(u @ u[q]), kind="stable")[:5].tolist()


def test_an_odd_vector_drops_no_other_query(spark):
    df = spark.createDataFrame([(0, [2.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r["rank"]): r.id for r in R.vector_topk(df, df, 2).collect()}
    assert got == {(0, 1): 0, (0, 2): 3, (3, 1): 0, (3, 2): 3, (1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1}


def test_whole_topk_searches_all_rows(spark, tmp_path, monkeypatch):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(101, 4))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(R, "CELLS", 150)
    got = {(r.query_id, r["rank"]): r.id for r in __spark_entry__.queries()["vector_topk_whole"](spark, str(tmp_path)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(q, k + 1): i for q in range(0, 101, 20) for k, i in enumerate(np.argsort(-(u @ u[q]), kind="stable")[:20].tolist())}


def test_whole_enrichment_has_a_row_for_every_customer(spark, tmp_path):
    spark.range(1, 13).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, c) for c in (1, 10, 11) for k in range(100 * c, 100 * c + 10)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.c_custkey: r.resume_text for r in __spark_entry__.queries()["resume_enrichment_whole"](spark, str(tmp_path)).collect()}
    assert got == {c: "\n\n".join(f"order {100 * c + k}" for k in range(8)) if c in (1, 10, 11) else None for c in range(1, 13)}


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("banner\nИмя,Роль,Стек,Ставка\nАнна,QA,\"Selenium, Postman\",2 500 руб\nJava,,,\nПётр,,Kotlin,\n,,,\nВсего,1,,\n", encoding="utf-8")
    rows = files.read_sheet_rows(spark, str(tmp_path), "csv")
    got = {r.row_index: r for r in N.normalize_tables(rows).collect()}
    assert (got[2].role, got[2].stack, got[2].rate_min, got[2].currency, got[2].confidence) == ("QA", ["Selenium", "Postman"], 2500, "RUB", "high")
    assert (got[4].role, got[4].stack) == ("Kotlin", ["Kotlin", "Java"]) and {k: r.skip_reason for k, r in got.items()} == {2: None, 3: "section", 4: None, 5: "empty", 6: "totals"}


def test_workbooks_and_documents(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.txt").write_text("  plain  ")
    assert [(r.sheet, r.row_index, r.cells) for r in files.read_sheet_rows(spark, str(tmp_path), "xlsx").collect()] == [("One", 1, ["shared", "", "5"])]
    assert [r.text for r in files.read_docx_text(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    assert [r.text for r in files.read_text_docs(spark, str(tmp_path)).collect()] == ["plain"]
    kinds = spark.createDataFrame([("x.CSV", None), ("x", "text/html; charset"), ("x.zip", None)], "p string, t string")
    assert [r[0] for r in kinds.select(files.file_kind(F.col("p"), F.col("t"))).collect()] == ["csv", "html", "unsupported"]


def test_streamed_messages_equal_the_batch(spark, tmp_path):
    rows = [(1, k % 5, f"c{k}", None, None, f"text {k}", f"2024-01-01 00:{k:02d}:00", None, False, None, "2024-01-01 00:00:00", "source") for k in range(12)]
    names = [x.split()[0] for x in S.MESSAGE.split(", ")]
    all_rows = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n.endswith('_id') else 'boolean' if n == 'has_attachment' else 'string'}" for n in names))
    all_rows = all_rows.selectExpr(*[f"CAST({n} AS timestamp) AS {n}" if n in ("message_date", "edited_at", "created_at") else n for n in names])
    source, out, mark = (os.fspath(tmp_path / x) for x in ("in", "out", "mark"))
    all_rows.coalesce(1).write.json(source)
    kept = ", ".join(x for x in S.MESSAGE.split(", ") if not x.startswith("source"))
    stream = S.read_messages(spark, source)
    q = stream.writeStream.foreachBatch(S.merge_into(out, kept)).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.message_id: r.raw_text for r in KeyedStore(spark, out, kept, ["channel_id", "message_id"]).read().collect()}
    assert got == {k: f"text {max(j for j in range(12) if j % 5 == k)}" for k in range(5)}


def test_entry_registers_all(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cleaning_and_companies(spark):
    from hirelake.functions import cleaning, companies

    bad = "привет".encode().decode("cp1251", "ignore")
    rows = spark.createDataFrame([(bad, [{"k": (bad, None)}, None]), (None, None), ("  ", []), ("see t.me/ÐÑ ", [{}]), ("ÐÐÐ", [{"a": ("plain", 3)}])], "t string, deep array<map<string, struct<s: string, n: int>>>")
    assert [r.t for r in rows.select(cleaning.repair_mojibake("t").alias("t")).collect()] == ["привет", None, "", "see t.me/ÐÑ", ""]
    got = cleaning.repair_all(rows).collect()
    assert [r.t for r in got] == ["привет", None, "", "see t.me/ÐÑ", ""] and got[0].deep == [{"k": ("привет", None)}, None] and got[1].deep is None and got[4].deep == [{"a": ("plain", 3)}]
    assert one(spark, cleaning.clean_message("a"), "Имя, [Feb 17, 2026 at 11:39 PM]:\n•  **Java** 🚀  5 €\n\n\n\nend") == "- Java 5 €\n\nend"
    rows = spark.createDataFrame([("команда сбера растёт",), ("customer - sberbank; срочно",), ("Компания: Лемана  Про, Москва",), (None,)], "t string")
    assert dict(companies.partner_counts(rows, "t").collect()) == {"Сбер": 2, "Лемана Про": 1}


@pytest.mark.parametrize("text, want", [
    ("\n ✅ Anna Kern - Java Developer, Senior / 5 years", ("Anna Kern", "Java Developer", "Senior")),
    ("Ivan graphic designer", ("Ivan", "graphic designer", None)),
    ("anna kern designer", (None, "designer", None)),
    ("Auto QA lead", (None, "Auto QA", "lead")),
    ("React", (None, "React", None)),
    ("just some words", (None, "just some words", None)),
    ("Senior", (None, None, "Senior")),
    ("", (None, None, None)),
    (None, (None, None, None)),
])
def test_first_line(spark, text, want):
    from hirelake.functions import people

    assert tuple(spark.createDataFrame([(text,)], "t string").select(people.first_line_fields("t").alias("f")).first().f) == want


def test_nearest_by_blocks_equal_brute_force_and_skip_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 8))
    v = np.concatenate([middle[rng.integers(0, 12, 700)] + 0.05 * rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(1, 8)), 150, 0)])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9999, None), (9998, [0.0] * 8), (9997, [1.0]), (9996, [2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(R, "ROWS", 50)
    count = {}
    got = {(r.query_id, r["rank"]): r.id for r in R.neighbour_join(df, df, 4, count=count).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    for q in range(len(v)):
        assert [got[q, k + 1] for k in range(4)] == np.lexsort((np.arange(len(v)), -sims[q]))[:4].tolist()
    assert (got[9997, 1], got[9996, 2], len(got)) == (9996, 9997, 4 * len(v) + 4)
    assert count["first"] + count["then"] < count["all"] / 3
    empty = df.where("id < 0")
    assert R.neighbour_join(df, empty, 4).count() == 0 and R.neighbour_join(empty, df, 4).count() == 0


def test_ranks_of_a_popular_label_score_few_pairs(spark, monkeypatch):
    """Many entities of one label, whose texts all differ: the ranks are those of all pairs, of which few are scored."""
    rng = random.Random(7)
    kinds = "id long, role string, stack array<string>, grade string, rate_max int, rate_min int, location string, description string, status string, is_internal boolean, expires_at timestamp"

    def entity(k):
        rate = rng.choice([None, 2000, 2100, 2600, 3000])
        return (k, "Python Developer", rng.sample(["Django", "Kafka", "Redis", "SQL", f"own{k}"], rng.randrange(4)), rng.choice(["Middle", "Senior", None]), rate, rate, rng.choice(["Remote", "Kazan", None]), f"about {k}", "active", rng.random() < 0.3, None)

    v, s = (spark.createDataFrame([entity(k) for k in range(n)], kinds) for n in (60, 400))
    made = []
    score = P.score_pairs
    monkeypatch.setattr(P, "score_pairs", lambda pairs, *a, **b: (made.append(pairs), score(pairs, *a, **b))[1])
    got = sorted(map(tuple, P.rank_specialists(v, s, AS_OF, 5).select("vacancy_id", "rank", "specialist_id", "score").collect()))
    few = [p.count() for p in made]
    a, b = P.carried(v, "VACANCY", AS_OF), P.carried(s, "BENCH", AS_OF)
    every = P.ranked(score(P.candidate_pairs(a, b)), P.specialist_order(), 5)
    assert got == sorted(map(tuple, every.select("v.id", "rank", "s.id", "score").collect()))
    assert P.candidate_pairs(a, b).count() > 5000
    assert few[1] <= 60 * 5 * 5 + 60 * 5
    back = sorted(map(tuple, P.rank_vacancies(s, v, AS_OF, 3).select("specialist_id", "rank", "vacancy_id", "score").collect()))
    turned = P.ranked(score(P.candidate_pairs(a, b).select(F.col("s").alias("v"), F.col("v").alias("s")), "s"), P.vacancy_order(), 3)
    assert back == sorted(map(tuple, turned.select("v.id", "rank", "s.id", "score").collect()))
    summary = {r.vacancy_id: (r.n, r.best) for r in P.rank_summary(v, s, AS_OF).collect()}
    plain = score(P.candidate_pairs(a, b)).groupBy("v.id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).collect()
    assert summary == {r.id: (r.n, r.best) for r in plain}


def test_many_partner_names_equal_a_plain_scan(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    names = {word(rng.randrange(3, 9)): rng.randrange(1, 50) for _ in range(20_000)}
    texts = [(k % 90, " ".join(word(rng.randrange(3, 12)) for _ in range(6)) if k % 9 else None) for k in range(120)]  # ids repeat
    best = lambda t: min(((-m, n) for n, m in names.items() if t and n in t), default=(0, None))[1]
    want = sorted(((i, best(t)) for i, t in texts), key=str)
    a, b = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(list(names.items()), "canonical_name string, mentions_count long")
    for most in (100_000, 6_000):
        monkeypatch.setattr(J, "NAMES", most)
        assert sorted(map(tuple, J.partner_mention(a, b, "id", "t").collect()), key=str) == want


def test_live_reference_equals_comparing_all_pairs(spark):
    rng = random.Random(4)
    part = lambda *v: rng.choice([None, " ", *v])
    make = lambda k: (k, rng.choice(["giant", "giant", "s", None]), part("http://a", "http://b"), part("Anna", "ANNA ", "Ivan"), part("qa", "QA", "dev"), part("rf", "by"))
    people, rows = [make(k) for k in range(80)], [make(k) for k in range(200)]
    plain = lambda v: (" ".join(v.lower().split()) or None) if v else None
    want = {}
    for p in people:
        best = None
        for r in rows:
            score = sum(n for n, x, y in zip((100, 40, 20, 10), p[2:], r[2:]) if plain(x) and plain(x) == plain(y))
            if p[1] and p[1] == r[1] and score >= 60 and (best is None or (score, -r[0]) > (best[1], -best[0])):
                best = (r[0], score)
        want[p[0]] = best or (None, None)
    names = "{} long, source_url string, resume_url string, name string, role string, location string"
    got = J.live_reference(spark.createDataFrame(people, names.format("id")), spark.createDataFrame(rows, names.format("row_index")))
    assert {r.id: (r.row_index, r.score) for r in got.collect()} == want


def test_keyword_match_joins_few_keys(spark):
    from hirelake.functions import cards as C

    rng = random.Random(6)
    text = lambda k: " ".join(["python", "everywhere", *rng.sample(["django", "redis", "kafka", "docker", "linux"], rng.randrange(4)), f"own{k}"])
    queries, targets = [(k, text(k)) for k in range(40)], [(k, text(1000 + k)) for k in range(300)]
    q, t = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(targets, "id long, text string")
    got = {}
    for r in C.keyword_match(q, t, 5, 35).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score, r.overlap))
    for i, x in queries:
        scored = []
        for j, y in targets:
            a, b = set(x.split()), set(y.split())
            o = len(a & b)
            scored.append((-int(o / len(a) * 55 + o / len(b) * 20 + 25 + 0.5), j, o))
        want = [(n + 1, j, -s, o) for n, (s, j, o) in enumerate(sorted(scored)[:5]) if -s >= 35]
        assert sorted(got.get(i, [])) == want
    side = lambda df, i: df.select(F.col(i).alias("id"), C.keywords("text").alias("words"), F.array_sort(C.profiles("text")).alias("profiles"))
    a, b = side(q, "query_id"), side(t, "id")
    known = C.shared_words(a, b)
    a, b = C._keyed(a, known), C._keyed(b, known)
    one = lambda df: df.dropDuplicates(["key"])
    assert C.keyword_pairs(one(a), one(b), 35).count() < 40 * 300 / 10  # every row has "python" and "everywhere"
