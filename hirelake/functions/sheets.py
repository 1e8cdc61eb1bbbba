"""Spreadsheet rows (file, sheet, row_index, cells) to structured rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import cut, spread

from .matching import IU, _c, distinct_by, given, strip, urlish
from .text import has

# ---- fixed values ----
HEADERS = {
    "name": ("имя", "фио", "кандидат", "специалист"),
    "role": ("роль", "role", "позиция", "вакансия", "должность", "специализация", "специалицация", "title"),
    "stack": ("стек", "стэк", "stack", "технолог", "skills", "skill", "tool", "инструмент"),
    "grade": ("грейд", "уровень", "seniority", "grade"),
    "english": ("англ", "english", "язык"),
    "availability": ("готовность", "доступност", "availability", "start"),
    "location": ("локац", "город", "страна", "регион", "location"),
    "rate": ("ставк", "рейт", "rate", "salary", "cost", "budget"),
    "resume_url": ("резюме", "cv", "resume", "ссылка"),
    "company": ("компан", "company"),
    "client": ("клиент", "заказчик", "client"),
    "work_format": ("формат", "удален", "remote", "office", "hybrid"),
    "employment_type": ("занятост", "оформление", "employment"),
    "requirements": ("требован", "навык", "must have"),
    "responsibilities": ("обязанност", "задач", "responsibilit"),
    "description": ("описание", "комментар", "note", "about"),
}
SKIPPED_SHEETS = r"\b(readme|summary|sum|итог|итоги|свод|archive|архив|template|шаблон|guide|help|инструк|legend|справоч|пример)\b"
TOTALS = r"\b(total|sum|итог|всего|subtotal|результат)\b"
GRADE = r"\b(junior|middle\+?|senior|lead|architect|staff|principal|head)\b"
ENGLISH = r"\b(a1|a2|b1|b2|c1|c2|upper[- ]?intermediate|intermediate|advanced|fluent|native)\b"
RATE = r"(\d[\d\s]{2,})(?:\s*(₽|руб|rub|\$|usd|eur|€))?"
ROLEISH = r"\b(analyst|designer|developer|engineer|qa|devops|manager|architect|разработ|аналит|дизайн|тест|архитект|менедж)\w*\b"
SHORT_ROLES = {
    "са": "Системный аналитик", "ca": "Системный аналитик", "systemanalyst": "Системный аналитик", "системныйаналитик": "Системный аналитик", "ба": "Бизнес-аналитик", "businessanalyst": "Бизнес-аналитик",
    "бизнесаналитик": "Бизнес-аналитик", "qa": "QA Engineer", "aqa": "AQA Engineer", "pm": "Project Manager", "po": "Product Owner",
}
GENERIC = ("bench", "vacancy", "vacancies", "specialists", "specialist", "candidates", "candidate", "free", "available", "свободные", "специалисты", "специалист", "кандидаты", "кандидат", "вакансии", "вакансия", "лист", "sheet")
TEXT_LABELS = (("name", "Имя"), ("role", "Роль"), ("stack", "Стек"), ("grade", "Грейд"), ("english", "Английский"), ("availability", "Готовность"), ("location", "Локация"), ("rate", "Ставка"), ("resume_url", "Резюме"))
# ---- end of fixed values ----
#: Rows of a sheet that tell whether it is relevant, and rows among which a header is looked for where none is plain.
LOOKED_AT, FIRST = 25, 10
#: Sheets up to which a row for each is broadcast.
FEW_SHEETS = 100_000


def _header_words(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "[^a-z0-9а-я]+", " "))


def _header_field(norm: Column) -> Column:
    out = None
    for field, words in HEADERS.items():
        hit = reduce(lambda a, b: a | b, [F.contains(norm, F.lit(w)) for w in words])
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def canonical_header(x: Column | str) -> Column:
    """The first field one of whose words is in the header."""
    return given(_header_words(_c(x)), _header_field)


def canonical_headers(cells: Column | str) -> Column:
    """The same for an array of cells; each is normalized once and then looked through for the words."""
    return F.transform(F.transform(_c(cells), _header_words), _header_field)


def full_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: strip(F.coalesce(c, F.lit(""))) != "")


def entity_hint(headers: Column) -> Column:
    """BENCH or VACANCY by the weights of the table's canonical headers."""

    def weights(h: Column) -> Column:
        weight = lambda n, *names: F.when(F.arrays_overlap(h, F.array(*map(F.lit, names))), n).otherwise(0)
        bench = weight(3, "name") + weight(3, "availability") + weight(2, "resume_url") + weight(1, "english")
        vacancy = weight(3, "requirements") + weight(3, "responsibilities") + weight(2, "company", "client") + weight(1, "employment_type", "work_format")
        return F.struct(bench.alias("b"), vacancy.alias("v"))

    hint = lambda w: F.when((w["b"] >= w["v"]) & (w["b"] >= 3), "BENCH").when((w["v"] > w["b"]) & (w["v"] >= 3), "VACANCY")
    return given(given(headers, weights), hint)


def row_hint(fields: Column, headers: Column) -> Column:
    """The rules for a row whose table gives no hint. fields: map of canonical header to value."""
    k = lambda n: F.map_contains_key(fields, F.lit(n))
    firm = F.arrays_overlap(headers, F.array(*map(F.lit, ("company", "client", "employment_type", "work_format"))))
    return F.when(k("name") | k("availability"), "BENCH").when(k("requirements") | k("responsibilities"), "VACANCY").when(k("resume_url") & k("rate"), "BENCH").when(firm, "VACANCY")


def row_map(headers: Column, cells: Column) -> Column:
    """map of canonical header to cell; the first column of a header wins, blank cells and unknown headers are left out."""
    pairs = F.transform(F.arrays_zip(headers.alias("h"), cells.alias("c")), lambda p: F.struct(p["h"].alias("key"), strip(F.coalesce(p["c"], F.lit(""))).alias("value")))
    good = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["value"] != ""))
    first = lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, 1, i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(given(good, first))


def header_metrics(cells: Column, headers: Column | None = None) -> Column:
    """struct(hits, distinct, full) of a row: cells with known words, fields of these, cells that are not blank. headers: the cells' fields, if known."""
    known = F.filter(canonical_headers(cells) if headers is None else headers, lambda h: h.isNotNull())
    return F.struct(F.size(known).alias("hits"), F.size(F.array_distinct(known)).alias("distinct"), F.size(full_cells(cells)).alias("full"))


def _is_header() -> Column:
    return (F.col("_m.hits") >= 2) & (F.col("_m.distinct") >= 2) & (F.col("_m.full") >= 2)


def marked(rows: DataFrame) -> DataFrame:
    """rows with the field of each cell (_h) and the header metrics (_m): the part that looks through all words, once for each row. Rows that have them stay."""
    if "_m" in rows.columns:
        return rows
    return rows.withColumn("_h", canonical_headers("cells")).withColumn("_m", header_metrics(F.col("cells"), F.col("_h")))


def blocks(rows: DataFrame, last: Column | None = None) -> DataFrame:
    """rows with headers (canonical, of the block), header_cells, block (1.. by header row; null before the first) and is_header.

    A header has at least two cells with known words, of at least two fields. Where a sheet has none, the best of its first rows that are not blank is
    taken, so that no sheet's rows are lost: of equal ones the first, of ``last`` (rows for which it is true) only where no other is as good."""
    last = F.lit(False) if last is None else F.coalesce(last, F.lit(False))
    marks = marked(rows).withColumn("is_header", _is_header())
    sheet = Window.partitionBy("file", "sheet")
    marks = marks.withColumn("_full", F.sum((F.col("_m.full") > 0).cast("int")).over(sheet.orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)))
    score = F.col("_m.hits") * 5 + F.col("_m.distinct") * 2 + F.col("_m.full") - F.when(F.col("_m.full") <= 1, 6).otherwise(0)
    best = F.min(F.when((F.col("_m.full") > 0) & (F.col("_full") <= FIRST), F.struct((-score).alias("s"), last.alias("l"), F.col("row_index").alias("r")))).over(sheet)
    any_header = F.max("is_header").over(sheet)
    marks = marks.withColumn("is_header", F.col("is_header") | (~any_header & (F.col("row_index") == best["r"]))).drop("_m", "_full")
    w = Window.partitionBy("file", "sheet").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("is_header").cast("int")).over(w)
    marks = marks.withColumn("header_cells", F.last(F.when(F.col("is_header"), F.col("cells")), ignorenulls=True).over(w))
    return marks.withColumn("block", F.nullif(number, F.lit(0))).withColumn("headers", F.last(F.when(F.col("is_header"), F.col("_h")), ignorenulls=True).over(w)).drop("_h")


def row_kind(cells: Column, headers: Column) -> Column:
    width = F.size(F.filter(headers, lambda h: h.isNotNull()))
    total = lambda x: has(F.coalesce(x, F.lit("")), TOTALS)
    kind = lambda full: F.when(F.size(full) == 0, "empty").when(total(F.get(full, F.lit(0))), "totals").when((F.size(full) == 1) & (width >= 3), "section").otherwise("data")
    return given(full_cells(cells), kind)


def pick_grade(values: Column) -> Column:
    """The first grade word of the cells, in canonical case."""
    g = F.lower(F.regexp_extract(F.array_join(values, "\n"), IU + GRADE, 1))
    return F.nullif(F.concat(F.upper(F.substring(g, 1, 1)), F.substring(g, 2, 20)), F.lit(""))


def pick_rate(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(x, F.lit("")), IU + RATE, 1), r"(?U)\D", ""), F.lit("")).cast("int")


def pick_currency(x: Column) -> Column:
    c = F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), IU + RATE, 2))
    return F.when(c.isin("₽", "руб", "rub"), "RUB").when(c.isin("$", "usd"), "USD").when(c.isin("€", "eur"), "EUR")


def pick_english(x: Column) -> Column:
    level = F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), IU + ENGLISH, 1))
    return F.coalesce(F.nullif(level, F.lit("")), F.nullif(strip(x), F.lit("")))


def pick_stack(x: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"[\n,;]|(?U:\s{2,})"), lambda p: strip(F.regexp_replace(p, IU + r"^\s*(langs?|databases?|devops|stack|tools?|frameworks?)\s*:", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def _token(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), "[^a-z0-9а-я]+", "")


def _long_form(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in SHORT_ROLES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, _token(x)), strip(x))


def split_stack(x: Column) -> Column:
    """The items of a stack cell without labels, short forms written out, one per token."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"[\n,;]|(?U:\s{2,})"), lambda p: F.regexp_replace(strip(p), IU + r"^(langs?|databases?|devops|stack)\s*:\s*", ""))
    return distinct_by(F.transform(F.filter(parts, lambda p: p != ""), _long_form), _token)


def _blob(x: Column) -> Column:
    return (F.length(x) > 120) | (F.contains(x, F.lit("\n")) & has(x, r"\b(langs?|databases?|devops|stack|tools?|frameworks?)\s*:")) | (F.regexp_count(x, F.lit(",")) >= 5)


def pick_role(fields: Column) -> Column:
    """The role cell unless it is a list of tools or a link; else the stack cell if it is a short form, is like a role, or has five words at most and no list."""
    f = lambda n: strip(F.try_element_at(fields, F.lit(n)))
    role, stack = f("role"), f("stack")
    known = F.create_map(*[F.lit(v) for kv in SHORT_ROLES.items() for v in kv])
    words = F.size(F.filter(F.split(stack, r"(?U)\s+"), lambda w: w != ""))
    plain = ~F.contains(stack, F.lit(",")) & ~F.contains(stack, F.lit("\n")) & (words <= 5)
    from_stack = F.when((stack != "") & ~_blob(stack) & ~urlish(stack), F.coalesce(F.try_element_at(known, _token(stack)), F.when(has(stack, ROLEISH) | plain, stack)))
    return F.coalesce(F.when((role != "") & ~_blob(role) & ~urlish(role), role), from_stack)


def stack_of(fields: Column, role: Column) -> Column:
    """The stack cell's items; the role itself where there is no such cell, or where it says the role only."""
    raw = strip(F.coalesce(F.try_element_at(fields, F.lit("stack")), F.lit("")))
    parts = split_stack(raw)
    only = F.array_compact(F.array(_long_form(role)))
    same = (raw == role) | ((F.size(parts) == 1) & (_token(F.get(parts, F.lit(0))) == _token(role)))
    return F.when(raw == "", F.array_compact(F.array(role))).when(F.coalesce(same, F.lit(False)) | (F.size(parts) == 0), only).otherwise(F.transform(parts, _long_form))


def context_hints(label: Column | str) -> Column:
    """struct(label, role_hint, stack_hints, availability_hint, entity_hint) of the words of a sheet's name or a section row; null for a blank one."""
    kept = lambda raw: F.filter(F.split(raw, r"(?U)[\s/,_\-]+"), lambda w: (w != "") & ~_token(w).isin(*GENERIC))
    known = F.create_map(*[F.lit(v) for kv in SHORT_ROLES.items() for v in kv])

    def hints(raw: Column, joined: Column) -> Column:
        clean = F.when(joined != "", joined).otherwise(raw)
        role = F.coalesce(F.try_element_at(known, _token(clean)), F.when(has(clean, ROLEISH), clean))
        holds = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.lower(clean), F.lit(w)) for w in words])
        when = F.when(holds("fulltime", "full time"), "fulltime").when(holds("parttime", "part time"), "parttime")
        kind = F.when(has(clean, r"\bvacanc|ваканс"), "VACANCY").when(has(clean, r"\bbench|специал|кандидат"), "BENCH")
        return F.struct(clean.alias("label"), role.alias("role_hint"), split_stack(clean).alias("stack_hints"), when.alias("availability_hint"), kind.alias("entity_hint"))

    two = given(strip(F.coalesce(_c(label), F.lit(""))), lambda raw: F.struct(raw.alias("r"), F.array_join(kept(raw), " ").alias("j")))
    return given(two, lambda s: F.when(s["r"] != "", hints(s["r"], s["j"])))


def sheet_relevance(rows: DataFrame) -> DataFrame:
    """file, sheet, relevant, reason, entity_hint: by the sheet's name, and headers and role words in its first rows."""
    w = Window.partitionBy("file", "sheet").orderBy("row_index")
    if "_m" in rows.columns:
        m = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LOOKED_AT)
    else:  # only these rows are looked through
        m = marked(rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LOOKED_AT))
    header = _is_header()
    first = F.min_by("_h", F.when(header, F.col("_n")))
    by = m.groupBy("file", "sheet").agg(F.bool_or(header).alias("_header"), F.count_if(has(F.array_join(full_cells(F.col("cells")), " "), ROLEISH)).alias("_roles"), first.alias("_h"))
    by = by.withColumn("_c", context_hints("sheet"))
    service = has(F.coalesce(strip(F.col("sheet")), F.lit("")), SKIPPED_SHEETS)
    good = F.col("_header") | (F.col("_roles") >= 2) | F.coalesce(F.col("_c.role_hint").isNotNull() | (F.size("_c.stack_hints") > 0), F.lit(False))
    hint = F.coalesce(entity_hint(F.filter("_h", lambda h: h.isNotNull())), F.col("_c.entity_hint"))
    reason = F.when(service, "service_sheet_name").when(F.col("_header"), "sheet_has_headers").when(good, "sheet_has_context").otherwise("no_relevant_structure")
    return by.select("file", "sheet", (~service & good).alias("relevant"), reason.alias("reason"), F.when(~service, hint).alias("entity_hint"))


def display_lines(header_cells: Column, cells: Column) -> Column:
    """``header: value`` of each cell that is not blank; ``Column i`` where the header is blank or missing."""
    name = lambda i: F.coalesce(F.nullif(strip(F.get(header_cells, i)), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string")))
    lines = F.transform(cells, lambda c, i: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(name(i), F.lit(": "), strip(c))))
    return F.array_compact(lines)


def rest_of_lines(lines: Column, composed: Column) -> Column:
    """The lines that are not among the composed ones; repeats stay."""
    return F.filter(lines, lambda x: ~F.array_contains(composed, x))


def structured_text(hint: Column, values: dict[str, Column], lines: Column) -> Column:
    """A row as canonical labelled lines, followed by its other lines."""
    full = lambda c: F.nullif(strip(c.cast("string")), F.lit(""))
    head = [F.concat(F.lit("Entity type hint: "), hint)] + [F.concat(F.lit(f"{label}: "), full(values[k])) for k, label in TEXT_LABELS if k in values]
    composed = F.array_compact(F.array(*head))
    return F.array_join(F.concat(composed, rest_of_lines(lines, composed)), "\n")


def confidence(points: Column) -> Column:
    return F.when(points >= 6, "high").when(points >= 3, "medium").otherwise("low")


def normalize_tables(rows: DataFrame, most: int = 200) -> DataFrame:
    """(file, sheet, row_index, block, kind, hint, role, stack, grade, rate_min, currency, english, name, location, company, availability, text, confidence,
    confidence_reason, skip_reason) of each row below a header of a relevant sheet. What the sheet's name and the last section row above say of role, stack and
    availability fills gaps. Data rows of low confidence, empty rows, totals and sections have a skip_reason; of the others the first ``most`` of a file stay."""
    rows = cut(marked(spread(rows)))
    sheets = cut(sheet_relevance(rows).where("relevant").select("file", "sheet", F.col("entity_hint").alias("_sheet_hint"), context_hints("sheet").alias("_b")))
    sheets = F.broadcast(sheets) if sheets.limit(FEW_SHEETS + 1).count() <= FEW_SHEETS else sheets
    df = blocks(rows.join(sheets, ["file", "sheet"])).where(F.col("block").isNotNull() & ~F.col("is_header"))
    df = df.withColumn("fields", row_map(F.col("headers"), F.col("cells"))).withColumn("kind", row_kind(F.col("cells"), F.col("headers")))
    df = df.withColumn("hint", F.coalesce(entity_hint(F.filter("headers", lambda h: h.isNotNull())), F.col("_sheet_hint"), row_hint(F.col("fields"), F.col("headers"))))
    # a section row names the role of the rows below it, within its block
    w = Window.partitionBy("file", "sheet", "block").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_section", F.last(F.when(F.col("kind") == "section", F.get(full_cells(F.col("cells")), F.lit(0))), ignorenulls=True).over(w))
    df = df.withColumn("_s", context_hints("_section"))
    df = df.withColumn("context", F.coalesce("_s.role_hint", "_b.role_hint"))
    hints = F.coalesce(F.when(F.size("_s.stack_hints") > 0, F.col("_s.stack_hints")), F.col("_b.stack_hints"), F.array().cast("array<string>"))
    f = lambda n: F.try_element_at("fields", F.lit(n))
    others = F.map_values(F.map_filter("fields", lambda k, v: k != "english"))
    df = df.withColumn("_role", F.coalesce(pick_role(F.col("fields")), "context"))
    df = df.withColumn("_stack", distinct_by(F.concat(stack_of(F.col("fields"), F.col("_role")), hints), _token))
    df = df.withColumn("_role", F.coalesce("_role", F.when(F.col("hint") == "VACANCY", f("stack"))))
    df = df.select(
        "file", "sheet", "row_index", "block", "kind", "hint", "fields", "context", F.col("_role").alias("role"), F.col("_stack").alias("stack"), "cells", "header_cells",
        F.coalesce(f("availability"), F.col("_s.availability_hint"), F.col("_b.availability_hint")).alias("availability"),
        pick_grade(others).alias("grade"), pick_rate(f("rate")).alias("rate_min"), pick_currency(f("rate")).alias("currency"), pick_english(f("english")).alias("english"),
        f("name").alias("name"), f("location").alias("location"), F.coalesce(f("company"), f("client")).alias("company"),
    )
    one = lambda c, n: F.when(c, n).otherwise(0)
    bench, vacancy = F.coalesce(F.col("hint") == "BENCH", F.lit(False)), F.coalesce(F.col("hint") == "VACANCY", F.lit(False))
    points = (
        one(F.col("hint").isNotNull(), 1) + one(F.col("role").isNotNull(), 2) + one(F.size("stack") > 0, 2) + one(F.col("grade").isNotNull(), 1) + one(F.col("rate_min").isNotNull(), 1)
        + one(F.col("location").isNotNull(), 1) + one(F.col("availability").isNotNull(), 1) + one(bench & F.col("name").isNotNull(), 2) + one(bench & f("resume_url").isNotNull(), 1)
        + one(vacancy & F.col("company").isNotNull(), 1) + one(vacancy & (f("requirements").isNotNull() | f("responsibilities").isNotNull()), 2)
        - one(f("role").isNull() & F.col("context").isNotNull(), 1)
    )
    df = df.withColumn("confidence", confidence(points))
    have = {"entity_hint": "hint", "role": "role", "grade": "grade", "rate": "rate_min", "location": "location", "availability": "availability", "name": "name", "company": "company"}
    df = df.withColumn("confidence_reason", F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in have.items()], F.when(F.size("stack") > 0, F.lit("stack"))))
    rate = F.concat_ws(" ", F.col("rate_min").cast("string"), F.when(F.col("rate_min").isNotNull(), F.col("currency")))
    values = {k: F.col(k) for k in ("name", "role", "grade", "english", "availability", "location")} | {"stack": F.array_join("stack", ", "), "rate": rate, "resume_url": f("resume_url")}
    df = df.withColumn("text", structured_text(F.col("hint"), values, display_lines(F.col("header_cells"), F.col("cells"))))
    df = df.withColumn("skip_reason", F.when(F.col("kind") != "data", F.col("kind")).when(F.col("confidence") == "low", "low_confidence")).drop("fields", "context", "cells", "header_cells")
    kept = Window.partitionBy("file").orderBy("sheet", "row_index")
    place = F.sum(F.col("skip_reason").isNull().cast("int")).over(kept)
    return df.withColumn("_n", place).where(F.col("skip_reason").isNotNull() | (F.col("_n") <= most)).drop("_n")


def block_summaries(normalized: DataFrame) -> DataFrame:
    """By block of a sheet: rows imported by confidence, and the skipped ones by reason (map)."""
    kept = F.col("skip_reason").isNull()
    by = normalized.groupBy("file", "sheet", "block", "skip_reason").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(kept & (F.col("confidence") == c)).alias(c) for c in ("high", "medium")])
    entries = F.filter(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("skip_reason", "n"))), lambda s: s.isNotNull())  # one for each reason
    return by.groupBy("file", "sheet", "block").agg(F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("imported"), F.sum("high").alias("high"), F.sum("medium").alias("medium"), F.map_from_entries(F.array_sort(entries)).alias("skip_reasons"))


def sheet_summaries(blocks_: DataFrame, relevance: DataFrame) -> DataFrame:
    """By file: sheets processed and skipped, tables, rows imported."""
    tables = blocks_.groupBy("file").agg(F.count(F.lit(1)).alias("tables"), F.sum("imported").alias("imported"))
    sheets = relevance.groupBy("file").agg(F.count_if("relevant").alias("sheets"), F.count_if(~F.col("relevant")).alias("sheets_skipped"))
    return sheets.join(tables, "file", "left").select("file", "sheets", "sheets_skipped", F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("imported", F.lit(0)).alias("imported"))


def table_summaries(normalized: DataFrame) -> DataFrame:
    """By file: tables, rows imported by confidence, rows skipped."""
    kept = F.col("skip_reason").isNull()
    return normalized.groupBy("file").agg(
        F.countDistinct("sheet", "block").alias("tables"), F.count_if(kept).alias("imported"), F.count_if(kept & (F.col("confidence") == "high")).alias("high"),
        F.count_if(kept & (F.col("confidence") == "medium")).alias("medium"), F.count_if(~kept).alias("skipped"),
    )
