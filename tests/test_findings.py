"""Queries against their SQL on small tables that show what a review found."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def customers(*keys):
    return [(k, f"Customer {k}", k % 25, 1.0, "x") for k in keys], CUSTOMER


def orders(*pairs):
    return [(k, c, "F", 1.0, datetime(2024, 1, 2), "1-URGENT") for k, c in pairs], ORDERS


def documents(*texts):
    return [(n, t, "en", "web", len(t)) for n, t in enumerate(texts)], DOCUMENTS


def rows_of(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables given as (rows, schema)."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(repr, map(tuple, got.select(columns).collect()))), sorted(map(repr, want.fetchall()))


def test_text_without_a_line_of_three_characters_has_no_role(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, "guess_role", documents=documents("A.", "ab\nabc", "\n", "Senior"))
    assert got == want


def test_entities_without_a_semicolon_stay(spark, tmp_path):
    pages = [(1, "u", "<title>a&amp</title><p>b &lt c&copy d &amp;lt; &nbsp;e"), (2, "u", "plain &")]
    got, want = rows_of(spark, tmp_path, "html_to_text", pages=(pages, "page_id long, url string, html string"))
    assert got == want


def test_banner_gives_way_to_an_order_as_good(spark, tmp_path):
    # customer 5 has sections only, 10 has none but blanks, 15 has full rows
    got, want = rows_of(spark, tmp_path, "table_blocks", customer=customers(1, 5, 10, 15), orders=orders((6, 5), (12, 5), (7, 10), (18, 15), (4, 15), (8, 1)))
    assert got == want


def expressions(spark, folder, name, word):
    """How often a word stands in a query's plan: an expression that is repeated is worked out again each time."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    return __spark_entry__.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString().lower().count(word)


def test_fields_of_posts_are_worked_out_once(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, "structured_from_source", orders=orders(*((k, k * 7 % 13) for k in range(60))))
    assert got == want
    assert expressions(spark, tmp_path, "structured_from_source", "regexp_") < 100


@pytest.mark.parametrize("name", ["entity_hint_table", "entity_hint_row", "row_map", "row_kinds", "context_hints"])
def test_cells_are_normalized_once(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name, orders=orders(*((k, k * 7 % 13) for k in range(40))))
    assert got == want
    assert expressions(spark, tmp_path, name, "regexp_") < 20


def test_an_item_is_worked_out_once(spark, tmp_path):
    embeddings = ([(2, [0.0, 1.0], "a")], "vec_id long, embedding array<float>, label string")
    got, want = rows_of(spark, tmp_path, "structured_vacancy", customer=customers(*range(1, 50)), embeddings=embeddings)
    assert got == want
    assert expressions(spark, tmp_path, "structured_vacancy", "regexp_") < 120


def test_lines_are_lower_cased_once(spark, tmp_path):
    head = "\n".join(f"line {n}" for n in range(12))
    texts = documents(head + "\nopыт, ставка 3000 rub\n12.05.2024\nplain\nKeep CV", "short", "")
    got, want = rows_of(spark, tmp_path, "keep_relevant", documents=texts)
    assert got == want
    assert expressions(spark, tmp_path, "keep_relevant", "lower(") < 5


def test_only_lines_that_may_be_cards_are_normalized(spark, tmp_path):
    from hirelake.functions import text as T

    card = "Go Senior 5 years опыт, rate 3000"
    rows = spark.createDataFrame([(1, f"- {card}\n\n2) {card}\nplain words only"), (2, f"{card}\na\nb"), (3, "a\nb"), (4, None)], "id long, t string")
    assert [tuple(r) for r in T.split_bench_lines(rows, "id", "t").orderBy("idx").collect()] == [(1, 1, card), (1, 3, card)]
    plan = T.split_bench_lines(rows, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(_cards" in plan  # the patterns run over these


def test_lines_of_lists_are_looked_through_once(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, "split_bench_lists", customer=customers(*range(0, 2000, 3)))
    assert got == want and len(got) > 100
    assert expressions(spark, tmp_path, "split_bench_lists", "regexp_") < 30


def test_ascii_needs_no_other_reading(spark):
    from hirelake.functions import cleaning as C

    rows = spark.createDataFrame([(" plain ",), ("Привет".encode().decode("latin1"),), ("",), (None,), ("Привет",)], "t string")
    got = [r[0] for r in rows.select(C.repair_mojibake("t")).collect()]
    assert got == ["plain", "Привет", "", None, "Привет"]
    assert "x7f" in rows.select(C.repair_mojibake("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_many_small_partitions_are_few_partitions(spark, monkeypatch):
    from hirelake.llm import linededup

    seen, real = [], linededup.cut

    def watched(df):
        out = real(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(linededup, "cut", watched)
    docs = spark.createDataFrame([(n, f"common line of all\nline of {n} alone") for n in range(80)], "doc_id long, text string").repartition(40)
    rows = linededup.dedup(docs).collect()
    assert sum(r.n_dropped for r in rows) == 79 and seen[0] <= 8


def test_keyword_sides_are_dealt_and_made_plain_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hirelake.functions import cards

    texts = ["Python  developer with Kafka", "python developer, kafka", "Spring Boot java", "no profile here", "", None, "the и из", "React Native kotlin developer"]
    q, t = (spark.createDataFrame([(n, x) for n, x in enumerate(texts)], f"{i} long, text string").coalesce(1) for i in ("query_id", "id"))
    plan = t.select(F.array_sort(cards.profiles("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 6  # once for a text, not once for each of the 11 profiles
    seen, real = [], cards.cut

    def watched(df):
        out = real(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(cards, "cut", watched)
    got = sorted((r.query_id, r["rank"], r.id, r.score, r.overlap) for r in cards.keyword_match(q, t).collect())
    assert min(seen[:2]) >= 4  # one file is one task, else
    assert got == [(0, 1, 0, 100, 3), (0, 2, 1, 100, 3), (1, 1, 0, 100, 3), (1, 2, 1, 100, 3), (2, 1, 2, 100, 3), (7, 1, 7, 100, 4)]


def test_every_pair_is_made_of_ids_alone(spark, tmp_path, monkeypatch):
    """Members of a key lie in several rows, tasks grow with the pairs, and no pair is ranked or carries features."""
    from hirelake.plans import matching as P

    monkeypatch.setattr(P, "MEMBERS", 2)
    monkeypatch.setattr(P, "PAIRS", 100)
    suppliers = [(k, f"Supplier {k}", k % 25, 1.0) for k in range(90)]
    embeddings = ([(2, [0.0, 1.0], "a")], "vec_id long, embedding array<float>, label string")
    tables = dict(customer=customers(*range(200)), supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), embeddings=embeddings)
    for name in ("candidate_pairs", "threshold_filter"):
        (tmp_path / name).mkdir()
        got, want = rows_of(spark, tmp_path / name, name, **tables)
        assert got == want and len(got) > 200
        made = __spark_entry__.queries()[name](spark, str(tmp_path / name))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Generate explode") == 2
        assert made.rdd.getNumPartitions() >= len(got) // 100


@pytest.mark.parametrize("named", [256, 0])
def test_pairs_need_the_features_of_the_gate_alone(spark, tmp_path, monkeypatch, named):
    """Known tokens stand in the plan or are joined; lists of several rows are moved as one and unfolded in a loop of its own, list by list."""
    from hirelake.plans import matching as P

    seen, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: (seen.append(df.columns), real(df))[1])
    monkeypatch.setattr(P, "NAMED_TOKENS", named)
    monkeypatch.setattr(P, "MEMBERS", 2)
    suppliers = [(k, f"Supplier {k}", k % 25, 1.0) for k in range(60)]
    embeddings = ([(2, [0.0, 1.0], "a")], "vec_id long, embedding array<float>, label string")
    tables = dict(customer=customers(*range(150)), supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), embeddings=embeddings)
    got, want = rows_of(spark, tmp_path, "candidate_pairs", **tables)
    assert got == want and len(got) > 200
    assert not any("work_formats" in columns for columns in seen)
    plan = __spark_entry__.queries()["candidate_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved, loops = plan.index("Generate inline"), plan.index("Generate explode")
    assert "Coalesce" in plan[loops:moved]
    (tmp_path / "t").mkdir()
    got, want = rows_of(spark, tmp_path / "t", "threshold_filter", **tables)
    assert got == want and len(got) > 50


def test_a_text_is_its_only_piece(spark):
    """Only texts with an end of a piece are cut, and a text's token is made once."""
    from hirelake.functions import matching as M

    rows = spark.createDataFrame([([" Java/ Kotlin ", "java", "A  b", None, " ", "see t.me/x, Go"],), (None,)], "a array<string>")
    got = [sorted(r[0]) for r in rows.select(M.match_texts("a")).collect()]
    assert got == [["A", "A  b", "Go", "Java", "Java/ Kotlin", "Kotlin", "b", "see t.me", "x"], []]
    texts = rows.select(M.distinct_keyed(M.match_texts("a"), M.match_token).alias("m"))
    assert texts.select(M.labels_of("m"))._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9а-я]+") == 1


def test_patterns_are_tried_where_their_words_stand(spark, monkeypatch):
    import random

    from hirelake.functions import matching as M

    rng = random.Random(3)
    words = ["ıOS", "İos", "objective c", "TYPEſCRIPT", "Kotlin", "kotlin", "аналитик данных", "Системный аналитик", "бизнес-аналитик", "ᲃистемный аналитик", "UX/UI", "ui designer", "Дизайнер", "тестировщик", "Tester", "AQA", "1С", "1c", ".NET", "VB.NET", "c#", "c++", "Nuxt.js", "Node JS",
             "node.js", "Scrum  Master", "delivery manager", "React   Native", "golang", "PVS Studio", "styled components", "platform engineer", "Java Script", "plain", "sap", "swift", "data analyst", "product owner", "Product Manager", "quality assurance", "C", "git", "vite"]
    texts = words + [" ".join(rng.sample(words, 3)) + rng.choice(["", "\n", "x", " - y"]) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    labels = lambda: [tuple(r) for r in rows.select(M.primary_labels("t"), M.tooling_labels("t")).collect()]
    few = labels()
    monkeypatch.setattr(M, "PATTERN_WORDS", {label: ("",) for label, _ in (*M.PRIMARY_PATTERNS, *M.TOOLING_PATTERNS)})
    assert few == labels()  # an empty word stands everywhere, so here every pattern is tried
    assert len({str(x) for x in few}) > 30


def test_csv_goes_through_python_in_pieces(spark, tmp_path, monkeypatch):
    import csv
    import io

    import pyarrow as pa

    from hirelake.sources import files

    data = 'a,"x\r\ny ""z""",пр\r\n\n1,,\rlone,2\n'.encode() * 9 + b'\xff\xd0,"open\nend'
    want = [list(r) for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""))]
    for n in (1, 2, 7, 1000):
        assert [r[3] for r in files._csv(data[i : i + n] for i in range(0, len(data), n))] == want
    (tmp_path / "a.csv").write_bytes(data)
    (tmp_path / "b.csv").write_bytes(b"")
    monkeypatch.setattr(files, "PIECE", 7)
    got = files.read_sheet_rows(spark, str(tmp_path), "csv").orderBy("row_index").collect()
    assert [(r.row_index, r.cells) for r in got] == list(enumerate(want))
    monkeypatch.setattr(files, "BATCH_ROWS", 4)
    batches = list(files._rows("csv")(iter([pa.RecordBatch.from_arrays([pa.array(["f", "f"]), pa.array([data[:50], data[50:]])], ["path", "content"])])))
    assert max(b.num_rows for b in batches) <= 4 and sum(b.num_rows for b in batches) == len(want)


def test_features_are_those_of_rows_that_are_hit(spark, monkeypatch):
    from hirelake.plans import matching as P
    from hirelake.plans import retrieval as V

    kinds = "id long, role string, stack array<string>, grade string, rate_max int, rate_min int, location string, description string, status string, is_internal boolean, expires_at timestamp"
    rows = spark.createDataFrame([(k, "Python Developer", ["Python", "Kafka"], "Senior", 2000, 2000, "Remote", None, "active", False, None) for k in range(20)], kinds)
    seen, real = [], P.carried
    monkeypatch.setattr(P, "carried", lambda entities, *a: (seen.append(entities.count()), real(entities, *a))[1])
    hits = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "vacancy_id long, specialist_id long, sim double")
    got = sorted((r[0], r[1]) for r in V.scored_hits(hits, rows, rows, "2024-03-01 00:00:00").select("v.id", "s.id").collect())
    assert got == [(1, 2), (1, 3)] and seen == [1, 2]
