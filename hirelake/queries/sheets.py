"""Queries of spreadsheet normalization and role profiles over derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import sheets as N
from hirelake.operators import catalog as C
from hirelake.sources.domain import table, with_tables

from . import query
from .messages import _holds

CATALOG = [
    ("profile_1", "alias", "python developer, backend developer"), ("profile_1", "term", "Python / Django / FastAPI"), ("profile_1", "stack_alias", "python, py; redis"),
    ("profile_2", "alias", "java developer, backend developer"), ("profile_2", "term", "Java / Spring"), ("profile_2", "stack_alias", "kafka; redis"),
    ("profile_3", "alias", "qa engineer"), ("profile_3", "term", "QA / Postman"), ("profile_3", "stack_alias", "selenium"),
]


def _rows(spark, d):
    """One sheet for each nation: a header and its customers."""
    head = table(spark, d, "nation").select(F.col("n_name").alias("file"), F.lit("Bench").alias("sheet"), F.lit(-1).cast("long").alias("row_index"), F.array(*map(F.lit, ("Name", "Role", "Stack", "Grade", "Rate", "Кандидат"))).alias("cells"))
    c = table(spark, d, "specialists").join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey"), "id").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    body = c.select(F.col("n_name").alias("file"), F.lit("Bench").alias("sheet"), F.col("id").alias("row_index"), F.array("c_name", "role", F.array_join("stack", ", "), F.coalesce("grade", F.lit("")), F.coalesce(F.concat(F.col("rate_min"), F.lit(" rub")), F.lit("")), "c_name").alias("cells"))
    return head.unionByName(body)


@query("normalize_tables", with_tables("""SELECT n_name AS file, id AS row_index, role, replace(grade, '+', '') AS grade, rate_min, CASE WHEN rate_min IS NOT NULL THEN 'RUB' END AS currency, c_name AS name FROM specialists JOIN customer ON c_custkey = id JOIN nation ON n_nationkey = c_nationkey""", "specialists"))
def normalize_tables(spark, d):
    rows = N.normalize_tables(_rows(spark, d), most=10**9).where("skip_reason IS NULL")
    return rows.select("file", "row_index", "role", "grade", "rate_min", "currency", "name")


@query("table_summaries", with_tables("SELECT n_name AS file, CAST(1 AS BIGINT) AS tables, least(count(*), 200) AS imported FROM specialists JOIN customer ON c_custkey = id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", "specialists"))
def table_summaries(spark, d):
    return N.table_summaries(N.normalize_tables(_rows(spark, d))).select("file", "tables", "imported")


@query("catalog_score", with_tables("""SELECT id, 'profile_1' AS profile, CAST(14.0 AS DOUBLE) AS score FROM specialists WHERE role = 'Python Developer'
 UNION ALL SELECT id, 'profile_2', 11.0 FROM specialists WHERE role = 'Java Developer' UNION ALL SELECT id, 'profile_3', 11.0 FROM specialists WHERE role = 'QA Engineer'""", "specialists"))
def catalog_score(spark, d):
    catalog = spark.createDataFrame(CATALOG, "profile string, kind string, terms string")
    return C.profile_scores(table(spark, d, "specialists"), catalog, "id", "role").select("id", "profile", "score")


# ---- the steps one by one, over cells made of orders ----

_HEADS = "ФИО кандидата|Должность|Tech stack|Seniority|English level|Availability|City, location|Rate USD|CV link|Company|Client name|Remote|Employment|Must have|Responsibilities|About|xyz| "
_CELLS = "Анна|QA|Go, SQL;  stack: Kafka|Senior|B2 upper|ASAP|Omsk|2 500 rub|http://cv/1|Acme|total 5|x|||||| "


def _sql_strings(text: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in text.split("|")) + "]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9а-я]+', ' ', 'g'))"


def _canonical(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(_norm(x), words)} THEN '{field}'" for field, words in N.HEADERS.items()) + " END"


def _orders(spark, d):
    """Orders dealt evenly: their cells cost far more than moving two numbers."""
    return table(spark, d, "orders", ("o_orderkey", "o_custkey"), dealt=True)


def _pick(text: str, by):
    return F.get(F.array(*[F.lit(x) for x in text.split("|")]), by.cast("int"))


@query("canonical_header", f"SELECT o_orderkey, {_canonical('h')} AS field FROM (SELECT o_orderkey, {_sql_strings(_HEADS)}[o_orderkey % 18 + 1] || ' ' || o_orderpriority AS h FROM orders) q")
def canonical_header(spark, d):
    head = F.concat_ws(" ", _pick(_HEADS, F.col("o_orderkey") % 18), "o_orderpriority")
    return table(spark, d, "orders", ("o_orderkey", "o_orderpriority"), dealt=True).select("o_orderkey", N.canonical_header(head).alias("field"))


#: Rows of four cells by the order's number.
_ROW = "list_transform(range(4), lambda i: {}[(o_orderkey * (i + 1) + o_custkey) % {} + 1])"
_HEAD_ROW, _CELL_ROW = _ROW.format(_sql_strings(_HEADS), 18), _ROW.format(_sql_strings(_CELLS), 18)


def _row(text: str):
    return F.array(*[_pick(text, (F.col("o_orderkey") * (i + 1) + F.col("o_custkey")) % 18) for i in range(4)])


_FIELDS = f"list_filter(list_transform({_HEAD_ROW}, lambda h: {_canonical('h')}), lambda f: f IS NOT NULL)"


@query("header_metrics", f"SELECT o_orderkey, len({_FIELDS}) AS hits, len(list_distinct({_FIELDS})) AS distinct_fields, len(list_filter({_HEAD_ROW}, lambda c: trim(c) <> '')) AS full_cells FROM orders")
def header_metrics(spark, d):
    return _orders(spark, d).select("o_orderkey", N.header_metrics(_row(_HEADS)).alias("m")).select("o_orderkey", F.col("m.hits").cast("long").alias("hits"), F.col("m.distinct").cast("long").alias("distinct_fields"), F.col("m.full").cast("long").alias("full_cells"))


@query("header_row", f"SELECT o_orderkey FROM orders WHERE len({_FIELDS}) >= 2 AND len(list_distinct({_FIELDS})) >= 2 AND len(list_filter({_HEAD_ROW}, lambda c: trim(c) <> '')) >= 2")
def header_row(spark, d):
    rows = _orders(spark, d).select("o_orderkey", N.header_metrics(_row(_HEADS)).alias("m"))
    return rows.where("m.hits >= 2 AND m.distinct >= 2 AND m.full >= 2").select("o_orderkey")


_W = lambda n, *names: f"CASE WHEN {' OR '.join(f'list_contains(f, {chr(39)}{x}{chr(39)})' for x in names)} THEN {n} ELSE 0 END"
_BENCH = " + ".join([_W(3, "name"), _W(3, "availability"), _W(2, "resume_url"), _W(1, "english")])
_VACANCY = " + ".join([_W(3, "requirements"), _W(3, "responsibilities"), _W(2, "company", "client"), _W(1, "employment_type", "work_format")])


@query("entity_hint_table", f"SELECT o_orderkey, CASE WHEN b >= v AND b >= 3 THEN 'BENCH' WHEN v > b AND v >= 3 THEN 'VACANCY' END AS hint FROM (SELECT o_orderkey, {_BENCH} AS b, {_VACANCY} AS v FROM (SELECT o_orderkey, {_FIELDS} AS f FROM orders) q) r")
def entity_hint_table(spark, d):
    heads = F.array_compact(N.canonical_headers(_row(_HEADS)))
    return _orders(spark, d).select("o_orderkey", N.entity_hint(heads).alias("hint"))


_PAIRED = f"SELECT o_orderkey, list_transform({_HEAD_ROW}, lambda h: {_canonical('h')}) AS heads, list_transform({_CELL_ROW}, lambda c: trim(c)) AS cells FROM orders"
_CELL = lambda name: f"list_filter(list_zip(heads, cells), lambda p: p[1] = '{name}' AND p[2] <> '')[1][2]"


def _fields(spark, d):
    rows = _orders(spark, d).select("o_orderkey", N.canonical_headers(_row(_HEADS)).alias("heads"), _row(_CELLS).alias("cells"))
    return rows.withColumn("f", N.row_map(F.col("heads"), F.col("cells")))


_SHOWN = ("name", "role", "stack", "grade", "english", "availability", "location", "rate", "resume_url", "company")


@query("row_map", f"SELECT o_orderkey, {', '.join(f'{_CELL(n)} AS {n}' for n in _SHOWN)} FROM ({_PAIRED}) q")
def row_map(spark, d):
    return _fields(spark, d).select("o_orderkey", *[F.try_element_at("f", F.lit(n)).alias(n) for n in _SHOWN])


_HAS = lambda n: f"{_CELL(n)} IS NOT NULL"


@query("entity_hint_row", f"SELECT o_orderkey, CASE WHEN {_HAS('name')} OR {_HAS('availability')} THEN 'BENCH' WHEN {_HAS('requirements')} OR {_HAS('responsibilities')} THEN 'VACANCY' WHEN {_HAS('resume_url')} AND {_HAS('rate')} THEN 'BENCH' WHEN len(list_intersect(list_filter(heads, lambda h: h IS NOT NULL), ['company', 'client', 'employment_type', 'work_format'])) > 0 THEN 'VACANCY' END AS hint FROM ({_PAIRED}) q")
def entity_hint_row(spark, d):
    return _fields(spark, d).select("o_orderkey", N.row_hint(F.col("f"), F.array_compact("heads")).alias("hint"))


_FULL = "list_filter(cells, lambda c: c <> '')"


@query("row_kinds", f"SELECT o_orderkey, CASE WHEN len({_FULL}) = 0 THEN 'empty' WHEN regexp_matches({_FULL}[1], '(?i)(^|[^а-яёa-z0-9_])(total|sum|итог|всего|subtotal|результат)($|[^а-яёa-z0-9_])') THEN 'totals' WHEN len(list_filter(heads, lambda h: h IS NOT NULL)) >= 3 AND len({_FULL}) = 1 THEN 'section' ELSE 'data' END AS kind FROM ({_PAIRED}) q")
def row_kinds(spark, d):
    return _fields(spark, d).select("o_orderkey", N.row_kind(F.col("cells"), F.col("heads")).alias("kind"))


@query("pick_grade", f"SELECT o_orderkey, CASE WHEN len(g) > 0 THEN upper(g[1][1]) || lower(g[1][2:]) END AS grade FROM (SELECT o_orderkey, regexp_extract_all(array_to_string(cells, chr(10)), '(?i)\\b(junior|middle\\+?|senior|lead|architect|staff|principal|head)\\b') AS g FROM ({_PAIRED}) q) r")
def pick_grade(spark, d):
    return _fields(spark, d).select("o_orderkey", N.pick_grade(F.col("cells")).alias("grade"))


_RATES = "CASE o_orderkey % 6 WHEN 0 THEN o_custkey || ' 500 rub' WHEN 1 THEN 'from 2 000₽' WHEN 2 THEN '$' || o_custkey WHEN 3 THEN o_custkey || ' usd/h' WHEN 4 THEN '12' ELSE o_orderpriority END"


@query("pick_rate", f"SELECT o_orderkey, CAST(nullif(regexp_replace(regexp_extract(t, '([0-9][0-9\\s]{{2,}})', 1), '[^0-9]', '', 'g'), '') AS INT) AS rate, CASE lower(regexp_extract(t, '(?i)([0-9][0-9\\s]{{2,}})(?:\\s*(₽|руб|rub|\\$|usd|eur|€))?', 2)) WHEN '₽' THEN 'RUB' WHEN 'rub' THEN 'RUB' WHEN 'usd' THEN 'USD' END AS currency FROM (SELECT o_orderkey, {_RATES} AS t FROM orders) q")
def pick_rate(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.concat(c, F.lit(" 500 rub"))).when(k == 1, "from 2 000₽").when(k == 2, F.concat(F.lit("$"), c)).when(k == 3, F.concat(c, F.lit(" usd/h"))).when(k == 4, "12").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", N.pick_rate(text).alias("rate"), N.pick_currency(text).alias("currency"))


@query("pick_english", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'B2' WHEN 1 THEN 'UPPER-INTERMEDIATE' WHEN 2 THEN o_orderpriority END AS english FROM orders")
def pick_english(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", N.pick_english(F.when(k == 0, "level b2, ok").when(k == 1, "Upper-Intermediate").when(k == 2, F.concat(F.lit(" "), "o_orderpriority")).otherwise(" ")).alias("english"))


_STACKS = "SA|qa; QA|stack: Go, go ,SQL|Java Developer|Kotlin|a, b, c, d, e, f|one two three four five six|http://x|"


@query("pick_role", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'Lead dev' ELSE CASE o_orderkey % 9 WHEN 0 THEN 'SA' WHEN 1 THEN 'qa; QA' WHEN 3 THEN 'Java Developer' WHEN 4 THEN 'Kotlin' END END AS role FROM orders")
def pick_role(spark, d):
    c, stack = F.col("o_custkey") % 3, _pick(_STACKS, F.col("o_orderkey") % 9)
    fields = F.create_map(F.lit("role"), F.when(c == 0, " Lead dev").when(c == 1, "http://t.me/x").otherwise("a,b,c,d,e,f"), F.lit("stack"), stack)
    return table(spark, d, "orders").select("o_orderkey", N.pick_role(fields).alias("role"))


@query("pick_stack", "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN ['SA'] WHEN 1 THEN ['QA Engineer'] WHEN 2 THEN ['Go', 'SQL'] WHEN 3 THEN ['Java Developer'] WHEN 4 THEN ['Kotlin'] WHEN 5 THEN ['a', 'b', 'c', 'd', 'e', 'f'] WHEN 6 THEN ['one two three four five six'] WHEN 7 THEN ['http://x'] ELSE ['Lead dev'] END AS stack FROM orders")
def pick_stack(spark, d):
    fields = F.create_map(F.lit("stack"), _pick(_STACKS, F.col("o_orderkey") % 9))
    return table(spark, d, "orders").select("o_orderkey", N.stack_of(fields, F.lit("Lead dev")).alias("stack"))


_LABELS = "Free QA specialists|Java_Developers - bench|Full time vacancies|part time: Go, SQL|Лист| "


@query("context_hints", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'QA Engineer' WHEN 1 THEN 'Java Developers' END AS role_hint, CASE o_orderkey % 6 WHEN 0 THEN ['QA Engineer'] WHEN 1 THEN ['Java Developers'] WHEN 2 THEN ['Full time'] WHEN 3 THEN ['part time: Go', 'SQL'] WHEN 4 THEN ['Лист'] END AS stack_hints,
 CASE o_orderkey % 6 WHEN 2 THEN 'fulltime' WHEN 3 THEN 'parttime' END AS availability_hint FROM orders""".replace("['part time: Go', 'SQL']", "['part time: Go SQL']"))
def context_hints(spark, d):
    rows = _orders(spark, d).select("o_orderkey", N.context_hints(_pick(_LABELS, F.col("o_orderkey") % 6)).alias("c"))
    return rows.select("o_orderkey", "c.role_hint", "c.stack_hints", "c.availability_hint")


def _sheets(spark, d):
    """A sheet for each customer with orders: a banner, a header unless the customer's number is divisible by five, the orders with sections, blanks and totals
    between."""
    head = table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey") % 50).alias("file"), F.when(F.col("c_custkey") % 7 == 0, "Summary").otherwise(F.concat(F.lit("S"), "c_custkey")).alias("sheet"), F.col("c_custkey"))
    banner = head.select("file", "sheet", F.lit(-2).cast("long").alias("row_index"), F.array(F.lit("banner"), F.lit("")).alias("cells"))
    top = head.where("c_custkey % 5 <> 0").select("file", "sheet", F.lit(-1).cast("long").alias("row_index"), F.array(*map(F.lit, ("Кандидат", "Role", "Stack", "Rate"))).alias("cells"))
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    e = F.lit("")
    cells = F.when(k == 0, F.array(F.lit("Java Developer"), e, e, e)).when(k == 1, F.array(e, F.lit(" "), e, e)).when(k == 2, F.array(F.lit("Итог"), F.lit("7"), e, e)).when(k == 3, F.array(F.lit("x"), F.lit("y"), e, e)).otherwise(F.array(F.lit("Ann"), F.lit("QA"), F.lit("Go, SQL"), F.lit("2000 rub")))
    body = o.select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), F.when(F.col("o_custkey") % 7 == 0, "Summary").otherwise(F.concat(F.lit("S"), "o_custkey")).alias("sheet"), F.col("o_orderkey").alias("row_index"), cells.alias("cells"))
    return banner.unionByName(top).unionByName(body)


@query("sheet_relevance", """SELECT 'f' || (c_custkey % 50) AS file, CASE WHEN c_custkey % 7 = 0 THEN 'Summary' ELSE 'S' || c_custkey END AS sheet, c_custkey % 7 <> 0 AS relevant,
 CASE WHEN c_custkey % 7 = 0 THEN 'service_sheet_name' WHEN c_custkey % 5 <> 0 THEN 'sheet_has_headers' ELSE 'sheet_has_context' END AS reason, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN 'BENCH' END AS entity_hint FROM customer GROUP BY ALL""")
def sheet_relevance(spark, d):
    return N.sheet_relevance(_sheets(spark, d))


@query("block_summaries", """SELECT 'f' || (o_custkey % 50) AS file, 'S' || o_custkey AS sheet, CAST(count(*) FILTER (WHERE o_orderkey % 6 > 2) AS BIGINT) AS imported, CAST(count(*) FILTER (WHERE o_orderkey % 6 > 2) AS BIGINT) AS high, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS sections, count(*) FILTER (WHERE o_orderkey % 6 = 1) AS empty, count(*) FILTER (WHERE o_orderkey % 6 = 2) AS totals
 FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 5 <> 0 GROUP BY 1, 2""")
def block_summaries(spark, d):
    # sheets without a header are the matter of table_blocks
    by = N.block_summaries(N.normalize_tables(_sheets(spark, d), most=10**9)).join(table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("S"), "c_custkey").alias("sheet")), "sheet", "left_semi")
    n = lambda k: F.coalesce(F.try_element_at("skip_reasons", F.lit(k)), F.lit(0)).cast("long")
    return by.select("file", "sheet", "imported", "high", n("section").alias("sections"), n("empty").alias("empty"), n("totals").alias("totals"))


@query("table_blocks", """SELECT 'S' || c_custkey AS sheet, CASE WHEN c_custkey % 5 <> 0 THEN -1 WHEN n IS NULL THEN -2 ELSE best END AS header FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, (-s, o_orderkey)) AS best FROM
 (SELECT o_custkey, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN -5 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 4 END AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 6 <> 1) o WHERE k <= 9 GROUP BY 1) q ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0""")
def table_blocks(spark, d):
    rows = N.blocks(_sheets(spark, d).where("sheet <> 'Summary'"), last=F.col("row_index") < 0)  # banners give way to orders
    return rows.where("is_header").select("sheet", F.col("row_index").alias("header"))


@query("structured_text", f"""SELECT o_orderkey, concat_ws(chr(10), 'Entity type hint: BENCH', 'Имя: ' || n, 'Роль: ' || r, array_to_string(list_filter(ls, lambda x: x <> 'Имя: ' || n AND x <> 'Роль: ' || r), chr(10))) AS text FROM (SELECT o_orderkey, 'Ann ' || o_custkey AS n, o_orderpriority AS r, ['Имя: Ann ' || o_custkey, 'Role: ' || o_orderpriority, 'Column 3: ' || o_orderkey] AS ls FROM orders) q""")
def structured_text(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("Ann "), "o_custkey")
    lines = N.display_lines(F.array(F.lit("Имя"), F.lit(" Role "), F.lit(" ")), F.array(name, F.col("o_orderpriority"), F.concat(F.lit(" "), "o_orderkey"), F.lit("  ")))
    return o.select("o_orderkey", N.structured_text(F.lit("BENCH"), {"name": name, "role": F.col("o_orderpriority"), "grade": F.lit(None).cast("string")}, lines).alias("text"))


@query("row_confidence", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 6 THEN 'high' WHEN o_orderkey % 10 >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM orders")
def row_confidence(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.confidence(F.col("o_orderkey") % 10).alias("confidence"))
