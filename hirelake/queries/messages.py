"""Queries of message rules over documents and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import messages as G
from hirelake.functions import text as T
from hirelake.operators.joins import partner_mention
from hirelake.session import spread
from hirelake.sources.domain import table, with_tables

from . import query

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _trim(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _holds(x: str, words) -> str:
    return f"len(list_filter({_quoted(words)}, lambda w: contains({x}, w))) > 0"


_LETTER = "[A-Za-zА-Яа-яЁё0-9_]"


def _anchors(patterns) -> str:
    """The number of places; in these patterns the second limit follows from what must come next, blanks and a sign."""
    one = lambda p: p.replace(r"\b", "", 1).replace(r"\b", "").replace("'", "''")
    return " + ".join(f"len(list_filter(regexp_extract_all(t, '(?i)(.|\\n|^)?(?:{one(p)})', 1), lambda c: NOT regexp_matches(c, '{_LETTER}')))" for p in patterns)


_SEPARATORS = "len(regexp_extract_all(t, '(?m)^\\s*[=~]\\s*\\S'))"
_TWICE = " OR ".join(f"length(replace(lower(t), '{w}', '')) <= length(t) - {2 * len(w)}" for w in G.REPEATED)
_BATCH = f"({_SEPARATORS} >= 2 OR ({_anchors(G.BENCH_ANCHORS)}) >= 2 OR ({_anchors(G.VACANCY_ANCHORS)}) >= 2 OR {_TWICE})"


@query("is_batch", with_tables(f"SELECT id, {_BATCH} AS batch FROM (SELECT id, text AS t FROM posts) p", "posts"))
def is_batch(spark, d):
    return table(spark, d, "posts").select("id", G.is_batch("text").alias("batch"))


_MONEY = f"regexp_matches(l, '(^|[^0-9A-Za-z_])[0-9]{{3,6}}($|[^0-9A-Za-z_])') AND {_holds('lower(l)', G.MONEY_WORDS)}"
_RELEVANT = f"(contains(l, '@') OR {_holds('lower(l)', ('t.me/', 'http'))} OR regexp_matches(l, '(^|[^0-9A-Za-z_])[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}($|[^0-9A-Za-z_])') OR ({_MONEY}) OR {_holds('lower(l)', G.KEPT_WORDS)})"


def _kept(lines: str, most: int) -> str:
    body = f"CASE WHEN len(list_filter({lines}[13:], lambda l: {_RELEVANT})) < 12 THEN {lines}[13:80] ELSE list_filter({lines}[13:], lambda l: {_RELEVANT}) END"
    return _trim(f"array_to_string(list_concat({lines}[1:12], [''], {body})[1:{most}], chr(10))")


#: Every document, one word to a line, so that there is something to leave out.
_AS_LINES = "regexp_replace(text, '[.,] ', chr(10), 'g')"


@query("keep_relevant", f"SELECT doc_id, {_kept('ls', 200)} AS text FROM (SELECT doc_id, list_filter(list_transform(string_split({_AS_LINES}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '') AS ls FROM documents) q")
def keep_relevant(spark, d):
    return table(spark, d, "documents").select("doc_id", G.keep_relevant(F.regexp_replace("text", "[.,] ", "\n")).alias("text"))


@query("archive_payload", with_tables(f"""SELECT id, CASE WHEN contains(text, 'Копия исходного сообщения') THEN CASE WHEN {_trim("string_split(text, 'Копия исходного сообщения')[2]")} <> '' THEN {_trim("substr(text, strpos(text, 'Копия исходного сообщения') + 25)")} ELSE {_trim('text')} END
 WHEN contains(text, 'Текст сообщения:') THEN CASE WHEN {_trim("string_split(text, 'Текст сообщения:')[2]")} <> '' THEN {_trim("substr(text, strpos(text, 'Текст сообщения:') + 16)")} ELSE {_trim('text')} END ELSE {_trim('text')} END AS payload,
 CASE id % 3 WHEN 0 THEN 'BENCH' WHEN 1 THEN 'VACANCY' END AS declared FROM posts""", "posts"))
def archive_payload(spark, d):
    return table(spark, d, "posts").select("id", G.archive_payload("text").alias("payload"), G.archive_type("text").alias("declared"))


@query("bench_blast", with_tables("SELECT id, lower(text) LIKE '%доступны%специалист%' OR lower(text) LIKE '%специалист%доступны%' OR contains(lower(text), 'подробные анкеты') AS blast FROM posts", "posts"))
def bench_blast(spark, d):
    return table(spark, d, "posts").select("id", G.bench_blast("text").alias("blast"))


_POSTS = "SELECT o_custkey AS c, string_agg(CASE WHEN id % 3 = 0 THEN '- ' WHEN id % 3 = 1 THEN '• ' ELSE '–' END || text, chr(10) ORDER BY id) AS t FROM posts GROUP BY 1"


@query("bulk_bench_split", with_tables(f"""SELECT c, CASE WHEN len(b) >= 5 AND {_holds('lower(t)', G.BULK_HINTS)} THEN list_filter(list_transform(b, lambda l: {_trim("ltrim(l, '–•-')")}), lambda l: length(l) >= 6) ELSE [] END AS items
 FROM (SELECT c, t, list_filter(list_transform(string_split(t, chr(10)), lambda l: {_trim('l')}), lambda l: regexp_matches(l, '^[–•-]')) AS b FROM ({_POSTS}) p) q""", "posts"))
def bulk_bench_split(spark, d):
    k = F.col("id") % 3
    mark = F.when(k == 0, "- ").when(k == 1, "• ").otherwise("–")
    rows = table(spark, d, "posts").groupBy(F.col("o_custkey").alias("c")).agg(F.sort_array(F.collect_list(F.struct("id", F.concat(mark, "text").alias("t")))).alias("l"))  # one customer's posts
    return rows.select("c", G.bulk_items(F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("items"))


@query("keyword_classify", with_tables(f"""SELECT id, CASE WHEN {_holds('lower(text)', G.BENCH_HINTS)} THEN 'BENCH' WHEN {_holds('lower(text)', G.STRONG_VACANCY_HINTS)} THEN 'VACANCY' WHEN id % 4 = 0 THEN 'VACANCY' WHEN id % 4 = 1 THEN 'BENCH' ELSE 'OTHER' END AS kind FROM posts""", "posts"))
def keyword_classify(spark, d):
    k = F.col("id") % 4
    return table(spark, d, "posts").select("id", G.keyword_kind("text", F.when(k == 0, " vacancy").when(k == 1, "Candidate").when(k == 2, "other")).alias("kind"))


@query("needs_reference", with_tables("SELECT id, id % 2 = 0 AND id % 9 <> 0 AND id % 13 <> 0 AND NOT contains(text, 't.me/') AND NOT contains(text, 'https://') AS needs FROM posts", "posts"))
def needs_reference(spark, d):
    i = F.col("id")
    return table(spark, d, "posts").select("id", G.needs_reference("text", i % 2 == 0, i % 9 == 0, F.when(i % 13 == 0, "channel").otherwise(" ")).alias("needs"))


@query("trim_error", f"SELECT doc_id, CASE WHEN length(t) <= 160 THEN nullif(t, '') ELSE rtrim(left(t, 159), {_BLANKS}) || '…' END AS error FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) AS t FROM documents) q")
def trim_error(spark, d):
    return table(spark, d, "documents").select("doc_id", G.trim_error("text").alias("error"))


@query("sync_status", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Наш бенч ещё не синхронизирован. Последняя ошибка: ' || event_type ELSE 'Наш бенч сейчас не синхронизирован. Последняя успешная версия: ' || strftime(ts + INTERVAL 3 HOUR, '%d.%m %H:%M') || ' МСК. Последняя ошибка: ' || event_type END AS status FROM events""")
def sync_status(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", G.sync_text(F.when(i % 3 != 0, F.concat(F.lit("  "), "event_type")), F.when(i % 2 != 0, F.col("ts"))).alias("status"))


@query("archive_text_cut", "SELECT doc_id, CASE WHEN length(text) <= 3900 - length(source) THEN text ELSE left(text, 3899 - length(source)) || '…' END AS body FROM documents")
def archive_text_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", G.cut_body("source", "text").alias("body"))


@query("octal_preview_decode", "SELECT doc_id, replace(text, '\\\\', '/') || 'é/' || 'и' AS text FROM documents")
def octal_preview_decode(spark, d):
    plain = F.replace("text", F.lit("\\"), F.lit("/"))
    return table(spark, d, "documents").select("doc_id", G.octal_text(F.concat(plain, F.lit(r"\303\251\057\320\270"))).alias("text"))


@query("partner_bias", with_tables("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND p.name IS NOT NULL AND c_custkey % 3 <> 0 THEN 'VACANCY' WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE 'BENCH' END AS kind,
 CASE WHEN c_custkey % 4 = 0 AND p.name IS NOT NULL AND c_custkey % 3 <> 0 THEN 'partner_bias' ELSE 'llm' END AS source, p.name AS partner
 FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN LATERAL (SELECT arg_min(canonical_name, (-mentions_count, canonical_name)) AS name FROM partners WHERE mentions_count > 0 AND contains(lower('project of ' || n_name || ', ' || c_mktsegment), lower(canonical_name))) p ON TRUE""", "partners"))
def partner_bias(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    texts = rows.select("c_custkey", F.concat(F.lit("Project of "), "n_name", F.lit(", "), "c_mktsegment").alias("text"))
    named = partner_mention(texts, table(spark, d, "partners"), "c_custkey", "text")
    kind = F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise("BENCH")
    out = named.select("c_custkey", G.partner_bias(F.struct(kind.alias("kind"), F.lit("llm").alias("source")), "partner", F.col("c_custkey") % 3 == 0).alias("x"), "partner")
    return out.select("c_custkey", "x.*", "partner")


@query("fallback_items", with_tables(f"""SELECT id, coalesce(role, 'Unknown') AS role, stack, {_trim('left(text, 1500)')} AS description, FALSE AS is_closed, TRUE AS is_available, nullif({_trim('left(text, 1000)')}, '') AS short FROM
 (SELECT id, text, list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{s}' END" for w, s in T.TOOL_WORDS)}], lambda x: x IS NOT NULL) AS stack,
 {_trim("regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^[=~—•*-]+\\s*', ''), '(?i)^(требуется|нужен|нужна|ищем|вакансия)\\s*[:-]?\\s*', '')")} AS role FROM posts) q""", "posts"))
def fallback_items(spark, d):
    rows = table(spark, d, "posts").select("id", "text", T.guess_role("text").alias("role"), T.guess_grade("text").alias("grade"), T.guess_stack("text").alias("stack"), T.contacts("text").alias("contacts"), T.text_urls("text").alias("urls"))
    rows = rows.select("id", G.fallback_item("VACANCY").alias("v"), G.fallback_item("BENCH").alias("s"))
    return rows.select("id", "v.role", "v.stack", "v.description", "v.is_closed", "s.is_available", F.col("s.description").alias("short"))


@query("normalize_bench_line", with_tables("SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Go — ' || (id % 9) || ',' || (id % 7) || ' лет  ' || id || '₽ /cv_' || id || '  ' || text, '[–—−]', '-', 'g'), '([0-9]),([0-9])', '\\1.\\2', 'g'), '/(cv[_-][A-Za-z0-9]+)', 'CV_CODE: \\1', 'g').replace('₽', ' RUB'), '[\\s]{2,}', ' ', 'g')) AS line FROM posts WHERE text NOT LIKE '%.net%'", "posts"))
def normalize_bench_line(spark, d):
    i = F.col("id")
    head = F.concat(F.lit("Go — "), i % 9, F.lit(","), i % 7, F.lit(" лет  "), i, F.lit("₽ /cv_"), i, F.lit("  "), "text")
    return table(spark, d, "posts").select("id", T.normalize_bench_line(head).alias("line"))


@query("extract_text_urls", with_tables("SELECT id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, 'https?://[^\\s)]+'), list_transform(regexp_extract_all(text, '\\bt\\.me/[^\\s)]+'), lambda u: 'https://' || u)), lambda u: rtrim(u, '.,;')))) AS urls FROM posts", "posts"))
def extract_text_urls(spark, d):
    return table(spark, d, "posts").select("id", T.text_urls("text").alias("urls"))


@query("canonical_message_url", with_tables("SELECT id, CASE WHEN contains(text, 't.me/chan/15') THEN 'https://t.me/chan/15' END AS text_url, 'https://t.me/c/' || (id % 20) || '/' || id AS url FROM posts", "posts"))
def canonical_message_url(spark, d):
    i = F.col("id")
    return table(spark, d, "posts").select("id", T.canonical_message_url("text").alias("text_url"), T.canonical_message_url(F.concat(F.lit("see HTTPS://T.me/c/").cast("string"), i % 20, F.lit("/"), i, F.lit("?single#x"))).alias("url"))


@query("guess_grade", with_tables("SELECT id, CASE WHEN regexp_matches(text, '(?i)уровень\\s*[:-]\\s*senior') THEN 'Senior' WHEN regexp_matches(text, '(?i)\\b(junior|middle|senior|lead|architect)\\b') THEN upper(regexp_extract(text, '(?i)\\b(junior|middle|senior|lead|architect)\\b', 1)[1]) || lower(regexp_extract(text, '(?i)\\b(junior|middle|senior|lead|architect)\\b', 1)[2:]) END AS grade FROM posts", "posts"))
def guess_grade(spark, d):
    return table(spark, d, "posts").select("id", T.guess_grade("text").alias("grade"))


_LINES = lambda t: f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"


@query("compact_message", f"""WITH q AS (SELECT doc_id, t, {_BATCH} AS is_batch, {_LINES('t')} AS ls FROM (SELECT doc_id, {_AS_LINES} AS t FROM documents) d),
o AS (SELECT doc_id, is_batch, CASE WHEN NOT is_batch AND length(t) > 7000 THEN {_kept('ls', 180)} ELSE t END AS t FROM q),
r AS (SELECT doc_id, is_batch, t, {_LINES('t')} AS ls FROM o),
a AS (SELECT doc_id, is_batch, t, {_kept('ls', 220)} AS again FROM r)
SELECT doc_id, is_batch, CASE WHEN NOT is_batch AND length(again) >= 250 THEN again ELSE t END AS text FROM a""")
def compact_message(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[.,] ", "\n").alias("t"))
    return G.compact(rows, "t").select("doc_id", "is_batch", "text")


@query("preprocess_text")
def preprocess_text(spark, d):
    return G.preprocess(table(spark, d, "documents"), "doc_id", "text")


_SCORE = f"""(CASE WHEN regexp_matches(l, '(?i)\\b(junior|middle\\+?|senior|lead|architect|staff|principal|head)\\b') THEN 0.20 ELSE 0 END + CASE WHEN regexp_matches(l, '(?i)\\b[0-9]+([.,][0-9]+)?\\s*(лет?|years?)\\s+опыт') THEN 0.25 ELSE 0 END
 + CASE WHEN regexp_matches(l, '(?i)(^|[^а-яёa-z0-9_])(ставк[аи]|rate)\\s*[:-]?\\s*[0-9]{{3,5}}') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(l, '(?i)\\bcv[_-][A-Za-z0-9]+\\b') THEN 0.25 ELSE 0 END
 + CASE WHEN hint THEN -0.35 WHEN len(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '')) >= 4 THEN 0.10 ELSE 0 END)"""
_JUDGED = f"""SELECT *, {_SCORE} AS raw FROM (SELECT *, {_holds('lower(l)', T.VACANCY_HINTS)} AS hint FROM (SELECT id, i, 'x ' || ls[i] || CASE WHEN id % 2 = 0 THEN ', senior, 5 лет опыта' ELSE '' END || CASE WHEN i % 2 = 0 THEN ', ставка 2500 cv_a1' ELSE '' END AS l
 FROM (SELECT id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM posts) a) b) c"""


def _lines(spark, d):
    """Every line of the posts, some with the signs of a card added; id, i, s: its signals."""
    rows = table(spark, d, "posts").select("id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("i", F.col("i") + 1)
    line = F.concat(F.lit("x "), "l", F.when(F.col("id") % 2 == 0, ", senior, 5 лет опыта").otherwise(""), F.when(F.col("i") % 2 == 0, ", ставка 2500 cv_a1").otherwise(""))
    return rows.select("id", "i", T.bench_signals(line).alias("s"))


_KIND = "CASE WHEN confidence >= 0.70 AND NOT hint THEN 'BENCH' ELSE 'UNKNOWN' END"


@query("pre_classify_lines", with_tables(f"""SELECT id, CAST(i AS INT) AS i, confidence, hint AS vacancy_hint, {_KIND} AS kind, CASE WHEN {_KIND} = 'BENCH' THEN 'bench_card_rule_match' WHEN hint THEN 'vacancy_hints_present' WHEN confidence >= 0.45 THEN 'weak_bench_signal' ELSE 'no_match' END AS reason
 FROM (SELECT *, CAST(greatest(0, least(1, raw)) AS DOUBLE) AS confidence FROM ({_JUDGED}) j) k""", "posts"))
def pre_classify_lines(spark, d):
    return _lines(spark, d).select("id", "i", T.pre_classify("s").alias("p")).select("id", "i", "p.confidence", "p.vacancy_hint", "p.kind", "p.reason")


@query("hybrid_decision_lines", with_tables(f"""SELECT id, CAST(i AS INT) AS i, CASE WHEN id % 7 = 0 THEN 'VACANCY' WHEN {_KIND} = 'BENCH' THEN 'BENCH' WHEN id % 5 = 0 THEN 'UNKNOWN' WHEN id % 5 < 3 AND confidence >= 0.55 AND NOT hint THEN 'BENCH' WHEN id % 5 < 3 THEN 'OTHER' ELSE 'VACANCY' END AS kind,
 CASE WHEN id % 7 = 0 THEN 'forced' WHEN {_KIND} = 'BENCH' THEN 'rule' WHEN id % 5 = 0 THEN 'pending_llm' WHEN id % 5 < 3 AND confidence >= 0.55 AND NOT hint THEN 'fallback' ELSE 'llm' END AS source
 FROM (SELECT *, CAST(greatest(0, least(1, raw)) AS DOUBLE) AS confidence FROM ({_JUDGED}) j) k""", "posts"))
def hybrid_decision_lines(spark, d):
    i = F.col("id")
    forced, label = F.when(i % 7 == 0, "VACANCY"), F.when(i % 5 == 0, F.lit(None)).when(i % 5 < 3, "OTHER").otherwise("VACANCY")
    rows = _lines(spark, d).select("id", "i", T.pre_classify("s").alias("p"))
    return rows.select("id", "i", T.hybrid_decision("p", forced, label).alias("x")).select("id", "i", "x.kind", "x.source")


_LISTS = f"SELECT c, i, l, hint, CAST(greatest(0, least(1, raw)) AS DOUBLE) AS confidence, count(*) OVER (PARTITION BY c) AS n FROM (SELECT *, {_SCORE} AS raw FROM (SELECT *, {_holds('lower(l)', T.VACANCY_HINTS)} AS hint FROM (SELECT c_nationkey * 1000 + c_custkey % 7 AS c, row_number() OVER (PARTITION BY c_nationkey * 1000 + c_custkey % 7 ORDER BY c_custkey) AS i, CASE WHEN c_custkey % (2 + c_nationkey % 4) = 0 THEN 'note ' || c_custkey ELSE 'Go senior ' || c_custkey || ', rate 3000' || CASE WHEN c_custkey % 3 = 0 THEN ' cv_x1' ELSE '' END END AS l FROM customer) a) b) e"


@query("split_bench_lists", f"SELECT c, CAST(i AS INT) AS idx, l AS text FROM (SELECT *, count(*) FILTER (WHERE confidence >= 0.55 AND NOT hint) OVER (PARTITION BY c) AS hits FROM ({_LISTS}) f) g WHERE confidence >= 0.55 AND NOT hint AND hits >= 2 AND hits >= floor(n * 0.6)")
def split_bench_lists(spark, d):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    card = F.concat(F.lit("Go senior "), k, F.lit(", rate 3000"), F.when(k % 3 == 0, " cv_x1").otherwise(""))
    line = F.when(k % (2 + nation % 4) == 0, F.concat(F.lit("note "), k)).otherwise(card)
    lists = table(spark, d, "customer").groupBy((nation * 1000 + k % 7).alias("c")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("s"))  # a post's lines
    posts = lists.select("c", F.array_join(F.transform("s", lambda x, i: F.concat(F.when(i % 2 == 0, "- ").otherwise("3) "), x["l"])), "\n").alias("text"))
    return T.split_bench_lines(spread(posts), "c", "text")


@query("stream_classify_posts", with_tables(f"""SELECT id, CASE WHEN (confidence >= 0.55 AND NOT hint) OR regexp_matches(l, '(?i)(^|[^а-яёa-z0-9_])(bench|бенч)') THEN 'bench' WHEN hint THEN 'vacancy' ELSE 'irrelevant' END AS kind FROM
 (SELECT *, CAST(greatest(0, least(1, {_SCORE})) AS DOUBLE) AS confidence FROM (SELECT id, text AS l, {_holds('lower(text)', T.VACANCY_HINTS)} AS hint FROM posts) b) c""", "posts"))
def stream_classify_posts(spark, d):
    from hirelake.streaming.jobs import classify

    return classify(table(spark, d, "posts").withColumnRenamed("text", "raw_text")).select("id", "kind")
