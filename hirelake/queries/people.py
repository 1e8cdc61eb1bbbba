"""Queries of names, identities, units and structured entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelake.functions import entities as E
from hirelake.functions import people as H
from hirelake.operators import units as N
from hirelake.session import spread
from hirelake.sources.domain import table, with_tables

from . import query

_ONE = lambda x: f"regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')"
#: A registry row as text: labelled name in some, contacts in others.
_ROW_SQL = "CASE specialist_id % 4 WHEN 0 THEN 'ФИО: ' || raw_text || chr(10) || 'https://cv.example.com/' || specialist_id || ', mail p' || specialist_id || '@example.org.' WHEN 1 THEN 'handle @user' || specialist_id WHEN 2 THEN '  ' ELSE raw_text END"


def _row():
    i, k = F.col("specialist_id"), F.col("specialist_id") % 4
    labelled = F.concat(F.lit("ФИО: "), "raw_text", F.lit("\nhttps://cv.example.com/"), i, F.lit(", mail p"), i, F.lit("@example.org."))
    return F.when(k == 0, labelled).when(k == 1, F.concat(F.lit("handle @user"), i)).when(k == 2, "  ").otherwise(F.col("raw_text"))


@query("contact_tokens", with_tables(f"SELECT specialist_id, list_concat(['mailto:x'], regexp_extract_all(t, 'https?://[^\\s,;]+'), regexp_extract_all(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])(@[a-zA-Z0-9_]{{4,}})', 1)) AS tokens FROM (SELECT specialist_id, {_ROW_SQL} AS t FROM registry) q", "registry"))
def contact_tokens(spark, d):
    return table(spark, d, "registry").select("specialist_id", H.contact_tokens(_row(), F.create_map(F.lit("email"), F.lit(" MAILTO:X; "))).alias("tokens"))


@query("person_name", with_tables(f"SELECT specialist_id, CASE WHEN specialist_id % 4 = 0 THEN raw_text WHEN specialist_id % 5 = 0 THEN 'Ada Lovelace' ELSE '-' END AS name FROM registry", "registry"))
def person_name(spark, d):
    k = F.col("specialist_id") % 5
    given = F.when(k == 0, " Ada Lovelace ").when(k == 1, "Senior Java").when(k == 2, "n/a").when(k == 3, "Agent 7").otherwise("Data lead")
    return table(spark, d, "registry").select("specialist_id", H.person_name(_row(), given, F.lit("Dev")).alias("name"))


_KEY = f"""'source=' || source_url || CASE WHEN specialist_id % 4 = 0 THEN '|contacts=https://cv.example.com/' || specialist_id || '|p' || specialist_id || '@example.org|name=' || {_ONE('raw_text')}
 WHEN specialist_id % 4 = 1 THEN '|contacts=@user' || specialist_id ELSE '' END || CASE WHEN specialist_id % 3 = 0 THEN '|role=qa lead|stack=go|sql' WHEN specialist_id % 4 = 2 THEN '|locator=' || lower(locator) WHEN specialist_id % 4 = 3 THEN '|raw=' || {_ONE('raw_text')} ELSE '' END"""


@query("registry_identity", with_tables(f"SELECT specialist_id, left(sha256({_KEY}), 32) AS key FROM registry", "registry"))
def registry_identity(spark, d):
    some = F.col("specialist_id") % 3 == 0
    role, stack = F.when(some, " QA   Lead"), F.when(some, F.array(F.lit("Go"), F.lit(" "), F.lit("SQL "), F.lit("go")))
    none = F.lit(None).cast("string")
    return table(spark, d, "registry").select("specialist_id", H.registry_identity("source_url", _row(), none, role, stack, "locator").alias("key"))


@query("registry_locator", with_tables("SELECT specialist_id, CASE WHEN specialist_id % 3 = 0 THEN 'Bench:' || specialist_id WHEN specialist_id % 3 = 1 THEN 'row:' || specialist_id ELSE 'idx:' || row_number() OVER (PARTITION BY source_url ORDER BY specialist_id) END AS locator FROM registry", "registry"))
def registry_locator(spark, d):
    k = F.col("specialist_id") % 3
    rows = table(spark, d, "registry").withColumn("place", F.row_number().over(Window.partitionBy("source_url").orderBy("specialist_id")))
    return rows.select("specialist_id", H.registry_locator(F.when(k == 0, "Bench").otherwise(" "), F.when(k != 2, F.col("specialist_id")), "place").alias("locator"))


@query("pick_resume_url", with_tables("SELECT id, CASE WHEN id % 6 = 0 THEN 'http://cv/' || id WHEN contains(text, 'https://x.example.com/cv.pdf') THEN 'https://x.example.com/cv.pdf' END AS url FROM posts", "posts"))
def pick_resume_url(spark, d):
    i = F.col("id")
    fields = F.create_map(F.lit("resume_url"), F.lit("  "), F.lit("cv_url"), F.when(i % 6 == 0, F.concat(F.lit(" http://cv/"), i)))
    return table(spark, d, "posts").select("id", H.resume_url(fields, "text").alias("url"))


@query("bench_blocks", with_tables("""SELECT c, n AS blocks, CASE WHEN c % 3 = 0 AND n >= 2 THEN two ELSE one END AS picked FROM (SELECT o_custkey AS c, count(*) AS n, arg_min(b, id) AS one, arg_min(b, id, 2)[2] AS two FROM
 (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN '✅ ' ELSE '' END || replace(trim(text, ' ' || chr(10)), chr(10) || ' ' || chr(10), chr(10)) AS b FROM posts) p GROUP BY 1) q""", "posts"))
def bench_blocks(spark, d):
    c = F.col("o_custkey")
    rows = table(spark, d, "posts").groupBy(c.alias("c")).agg(F.sort_array(F.collect_list(F.struct("id", F.concat(F.when(c % 2 == 0, "✅ ").otherwise(""), F.regexp_replace(F.regexp_replace("text", "^[ \n]+|[ \n]+$", ""), "\n \n", "\n")).alias("t")))).alias("l"))  # one customer's posts
    rows = rows.select("c", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("t"))
    return rows.select("c", F.size(H.bench_blocks("t")).cast("long").alias("blocks"), H.indexed_block("t", F.when(F.col("c") % 3 == 0, "2").when(F.col("c") % 3 == 1, "x").otherwise("99999")).alias("picked"))


@query("first_line_role_name", with_tables("""SELECT id, CASE id % 7 WHEN 0 THEN 'Ищем' WHEN 2 THEN '=' WHEN 3 THEN '~' WHEN 5 THEN 'Анна Смирнова' END AS name,
 CASE id % 7 WHEN 0 THEN 'Java разработчика' WHEN 2 THEN 'Go 5 лет опыта' WHEN 3 THEN 'QA' WHEN 4 THEN 'Вакансия: Аналитик' WHEN 5 THEN 'Java Developer' WHEN 6 THEN 'С++ на бенче' END AS role,
 CASE id % 7 WHEN 1 THEN 'Senior' WHEN 3 THEN 'Lead' WHEN 5 THEN 'Senior' END AS grade FROM posts""", "posts"))
def first_line_role_name(spark, d):
    return table(spark, d, "posts").select("id", H.first_line_fields("text").alias("f")).select("id", "f.name", "f.role", "f.grade")


_PLACE = "CASE id % 11 % 2 WHEN 0 THEN 'Город: Казань ' ELSE 'работа, локация   Пермь' END"


@query("structured_from_source", with_tables(f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'Given Name' WHEN id % 5 = 1 THEN 'Row Name' ELSE CASE id % 7 WHEN 0 THEN 'Ищем' WHEN 2 THEN '=' WHEN 3 THEN '~' WHEN 5 THEN 'Анна Смирнова' END END AS name,
 CASE WHEN id % 5 = 0 THEN NULL WHEN id % 11 % 2 = 0 THEN 'Казань' ELSE 'Пермь' END AS location, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 1500 WHEN id % 8 = 0 THEN 2500 WHEN id % 8 = 1 THEN 3000 END AS rate_min,
 CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'http://cv/' || id END AS resume_url FROM posts""", "posts"))
def structured_from_source(spark, d):
    i = F.col("id")
    given = F.struct(*[(F.when(i % 5 == 0, "Given Name") if n == "name" else F.lit(None).cast("int" if n == "rate_min" else "string")).alias(n) for n in H.FIELDS])
    row = F.when(i % 5 == 1, F.create_map(F.lit("ФИО"), F.lit(" Row Name"), F.lit("Name of specialist"), F.lit("second"), F.lit("Ставка, руб"), F.lit("1 500 руб"), F.lit("Ссылка на резюме"), F.concat(F.lit("cv http://cv/"), i, F.lit(", old"))))
    place = F.when(i % 11 % 2 == 0, "Город: Казань ").otherwise("работа, локация   Пермь")
    text = F.concat_ws("\n", F.regexp_replace("text", "\n \n", "\n"), place)
    rows = table(spark, d, "posts", dealt=True).select("id", given.alias("g"), row.alias("m"), text.alias("t"), F.lit("1").alias("n"), F.lit("Имя: Never").alias("o"))
    return H.structured_fields(rows, "id", "g", "m", "t", "n", "o").select("id", "name", "location", "rate_min", "resume_url")


def _fields(i):
    """Fields of a card by its number, as a map."""
    pairs = {
        "name": F.when(i % 3 == 0, F.concat(F.lit("Ann  Lee")))
        .when(i % 3 == 1, "Java lead"),
        "role": F.when(i % 4 == 0, " Data   Engineer ").when(i % 4 == 1, "Stack: go, sql").when(i % 4 == 2, "http://x/y"),
        "grade": F.when(i % 2 == 0, "Senior"), "rate_min": F.when(i % 5 == 0, "2500").when(i % 5 == 1, "many"), "location": F.lit(" New\n York "),
        "availability": F.when(i % 6 == 0, "ASAP").when(i % 6 == 1, "not available now"), "resume_url": F.when(i % 7 == 0, "http://cv/1"), "english": F.when(i % 7 == 1, "B2"),
        "company": F.when(i % 3 == 0, "Acme"), "requirements_text": F.when(i % 4 == 3, "SQL"),
    }
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


_STACKS = "CASE WHEN s % 3 = 0 THEN ['Go', 'Backend Engineer'] WHEN s % 3 = 1 THEN ['Kafka'] ELSE CAST([] AS VARCHAR[]) END"
_ROLES = "CASE WHEN s % 4 = 0 THEN 'Data Engineer' WHEN s % 5 = 2 THEN 'Guessed QA' WHEN s % 3 = 0 THEN 'Backend Engineer' WHEN s % 3 = 1 THEN 'Kafka' ELSE 'Unknown' END"
_TEXTS = "concat_ws(chr(10), CASE WHEN s % 4 = 3 THEN 'SQL' END, CASE WHEN s % 7 = 1 THEN 'B2' END, CASE WHEN s % 6 = 0 THEN 'ASAP' WHEN s % 6 = 1 THEN 'not available now' END, CASE WHEN s % 7 = 0 THEN 'http://cv/1' END, 'Card ' || s)"


def _cards(spark, d):
    s = spread(table(spark, d, "specialists").select(F.col("id").alias("s")))
    i = F.col("s")
    stack = F.when(i % 3 == 0, F.array(F.lit("Go; stack: Backend Engineer"), F.lit("go"))).when(i % 3 == 1, F.array(F.lit("Kafka"), F.lit("x" * 81)))
    return s.select("s", _fields(i).alias("f"), stack.alias("stack"), F.concat(F.lit("  Card "), i).alias("t"), F.when(i % 5 == 2, "Guessed QA").alias("guessed"))


@query("coerce_role", with_tables(f"SELECT s, {_ROLES} AS role FROM (SELECT id AS s FROM specialists) q", "specialists"))
def coerce_role(spark, d):
    return _cards(spark, d).select("s", E.coerce_role(F.col("f")["role"], E.sanitize_stack("stack"), "guessed").alias("role"))


@query("structured_specialist", with_tables(f"""SELECT s, CASE WHEN s % 3 = 0 THEN 'Ann Lee' END AS name, {_ROLES} AS role, CASE WHEN len({_STACKS}) > 0 THEN {_STACKS} WHEN {_ROLES} <> 'Unknown' THEN [{_ROLES}] ELSE CAST([] AS VARCHAR[]) END AS stack,
 CASE WHEN s % 2 = 0 THEN 'Senior' END AS grade, CASE WHEN s % 5 = 0 THEN 2500 END AS rate_min, 'New York' AS location, CASE WHEN s % 6 = 0 THEN 0 END AS availability_weeks, s % 6 <> 1 AS is_available,
 CASE WHEN s % 7 = 0 THEN ['http://cv/1'] ELSE CAST([] AS VARCHAR[]) END AS source_urls, CASE WHEN s % 7 = 1 THEN ['B2'] ELSE CAST([] AS VARCHAR[]) END AS languages, {_TEXTS} AS description FROM (SELECT id AS s FROM specialists) q""", "specialists"))
def structured_specialist(spark, d):
    rows = _cards(spark, d).select("s", E.structured_specialist("f", "stack", "t", "guessed").alias("x"))
    return rows.select("s", *[f"x.{c}" for c in ("name", "role", "stack", "grade", "rate_min", "location", "availability_weeks", "is_available", "source_urls", "languages", "description")])


@query("structured_vacancy", with_tables(f"""SELECT s, {_ROLES} AS role, CASE WHEN s % 3 = 0 THEN 'Acme' END AS company, CASE WHEN s % 4 = 3 THEN ['SQL'] ELSE CAST([] AS VARCHAR[]) END AS requirements, FALSE AS is_closed, {_TEXTS} AS description FROM (SELECT id AS s FROM specialists) q""", "specialists"))
def structured_vacancy(spark, d):
    rows = _cards(spark, d).select("s", E.structured_vacancy("f", "stack", "t", "guessed").alias("x"))
    return rows.select("s", *[f"x.{c}" for c in ("role", "company", "requirements", "is_closed", "description")])


@query("experience", with_tables("SELECT id, CASE WHEN id % 3 <> 0 THEN id % 12 END AS years FROM specialists", "specialists"))
def experience(spark, d):
    i = F.col("id")
    return table(spark, d, "specialists").select("id", E.experience(F.when(i % 3 != 0, i % 12), F.when(i % 2 == 0, i % 12)).alias("years"))


# ---- units: posts with links (customers' orders as a link's items), with attachments, and plain ----

_CARD = "Go Senior 5 years опыт, rate 3000"


def _items(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("item"))
    k = F.col("id") % 3
    cards = F.array_join(F.array_repeat(F.lit(_CARD), 3), "\n")
    return li.select("id", "item", F.when(k == 0, "google_sheet").otherwise("google_doc").alias("kind"), F.concat(F.lit("http://d/"), F.col("id")).alias("url"), F.when(k == 2, F.lit("plain item")).otherwise(cards).alias("text"), F.when(F.col("item") % 2 == 0, F.col("item")).alias("row_index"))


_HEAD = "'External source kind: ' || kind || chr(10) || 'External source URL: http://d/' || id || chr(10) || coalesce('Row: ' || r || chr(10), '') || chr(10) || t"
_EXPANDED = f"""SELECT id, item, n AS local, {_HEAD} AS text, kind AS external_kind, 'row:' || r AS external_locator FROM (SELECT *, CASE WHEN n = 0 THEN row_index ELSE coalesce(row_index + n - 1, n) END AS r, CASE WHEN n = 0 THEN full_text ELSE '{_CARD}' END AS t
 FROM (SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS item, CASE WHEN l_orderkey % 3 = 0 THEN 'google_sheet' ELSE 'google_doc' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS INT) END AS row_index,
 CASE WHEN l_orderkey % 3 = 2 THEN 'plain item' ELSE '{_CARD}' || chr(10) || '{_CARD}' || chr(10) || '{_CARD}' END AS full_text, unnest(CASE WHEN l_orderkey % 3 = 1 THEN [1, 2, 3] ELSE [0] END) AS n FROM lineitem) q) r"""


@query("unit_expand", _EXPANDED)
def unit_expand(spark, d):
    return N.expand_items(_items(spark, d), "id").select("id", "item", "local", "text", "external_kind", "external_locator")


@query("unit_priority", f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'external_link' WHEN id % 4 = 1 THEN 'telegram_attachment' WHEN id % 4 = 2 THEN 'telegram_line_split' ELSE 'telegram_message' END AS source_type, count(*) AS units, max(unit_no) AS last_no
 FROM (SELECT id, row_number() OVER (PARTITION BY id) AS unit_no FROM (SELECT id FROM ({_EXPANDED}) e WHERE id % 4 IN (0, 1) UNION ALL SELECT o_orderkey FROM orders, range(2) WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 8 <> 3) u) v GROUP BY 1, 2""")
def unit_priority(spark, d):
    i = F.col("id")
    text = F.when(i % 4 == 2, F.lit(f"1) {_CARD}\n2) {_CARD}")).when(i % 8 == 3, "  ").when(i % 4 == 3, "hello")
    messages = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select("id", text.alias("text"))
    items = _items(spark, d)
    units = N.numbered(N.message_units(messages, items.where("id % 4 = 0"), items.where("id % 4 IN (0, 1)"), "id"), "id")
    return units.groupBy("id", "source_type").agg(F.count(F.lit(1)).alias("units"), F.max("unit_no").cast("long").alias("last_no"))


@query("unit_index", f"SELECT id, item, local, row_number() OVER (PARTITION BY id ORDER BY item, local) AS unit_no, id * 1000 + row_number() OVER (PARTITION BY id ORDER BY item, local) * 1000 + item AS trace FROM ({_EXPANDED}) e")
def unit_index(spark, d):
    units = N.numbered(N.expand_items(_items(spark, d), "id"), "id")
    return units.select("id", "item", "local", F.col("unit_no").cast("long").alias("unit_no"), N.trace_id(F.col("id"), F.col("unit_no"), F.col("item")).alias("trace"))
