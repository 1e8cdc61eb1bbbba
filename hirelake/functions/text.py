"""Column functions over message texts, links and labels."""

from __future__ import annotations

import html
import html.entities
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .matching import IU, _c, distinct_by, given, strip

# ---- fixed values ----
CARD_WORDS = ("опыт", "ставк", "rate", "cv")
VACANCY_HINTS = ("нужен", "нужна", "нужно", "ищем", "требуется", "вакансия", "позиция", "проект", "отклик", "обязанности", "требования")
GRADE = r"\b(junior|middle\+?|senior|lead|architect|staff|principal|head)\b"
GRADE_PARTS = ("junior", "middle", "senior", "lead", "architect", "staff", "principal", "head")
EXPERIENCE = r"\b(\d+(?:[.,]\d+)?)\s*(?:лет?|years?)\s+опыт\w*\b"
RATE = r"\b(?:ставк[аи]|rate)\s*[:\-]?\s*(\d{3,5}(?:[.,]\d+)?)\s*(?:rub|₽|р\b)?"
CV = r"\b(?:cv[_\-][A-Za-z0-9]+|CV_CODE:\s*cv[_\-][A-Za-z0-9]+)\b"
UNAVAILABLE = (r"\bзанят\w*\b", r"\bна\s+проекте\b", r"\bвышел\b", r"\bустроил\w*\b", r"\bне\s+ищет\b", r"\bнеактуаль\w*\b", r"\bне\s+на\s+бенче\b", r"\bunavailable\b", r"\bon\s+project\b", r"\bengaged\b", r"\ballocated\b", r"\bbillable\b")
AVAILABLE = (r"\bbench\b", r"\bavailable\b", r"\bfree\b", r"\bсвобод\w*\b", r"\bна\s+бенче\b", r"\bосвободил\w*\b", r"\bищу\s+проект\b", r"\bищу\s+работу\b", r"\bдоступ\w*\b")
TOOL_WORDS = (
    ("jira", "Jira"), ("confluence", "Confluence"), ("atlassian", "Atlassian"), ("bitbucket", "Bitbucket"), ("bamboo", "Bamboo"), ("crowd", "Crowd"),
    ("ms office", "MS Office"), ("excel", "Excel"), ("powerpoint", "Powerpoint"), ("visio", "Visio"), ("bpmn", "Bpmn"), ("uml", "Uml"),
    ("sql", "SQL"), ("postgres", "Postgres"), ("api", "API"), ("rest", "REST"), ("soap", "SOAP"),
)
YANDEX_HOSTS = ("disk.yandex.ru", "disk.360.yandex.ru", "yadi.sk", "disk.yandex.com")
FILE_KINDS = ((".pdf", "direct_pdf"), (".docx", "direct_docx"), (".xlsx", "direct_xlsx"), (".csv", "direct_csv"), (".txt", "direct_txt"))
_N = r"\d{1,3}"
PRIVATE_V4 = rf"(?:0|10|127|22[4-9]|23\d|24\d|25[0-5])\.{_N}\.{_N}\.{_N}|(?:192\.168|169\.254|198\.1[89]|172\.(?:1[6-9]|2\d|3[01]))\.{_N}\.{_N}|(?:192\.0\.[02]|198\.51\.100|203\.0\.113)\.{_N}"
PRIVATE_V6 = rf"(?:0{{0,4}}:){{2,7}}0{{0,3}}[01]?|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{{2}}:.*|2001:0?db8:.*|::(?:ffff:)?(?:{PRIVATE_V4})"
# ---- end of fixed values ----

#: An entity with its semicolon.
ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

#: All line ends that the rules know.
LINES = "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85  ]"


def has(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(IU + pattern))


def any_of(x: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [has(x, p) for p in patterns])


def lines(x: Column | str) -> Column:
    return F.split(F.coalesce(_c(x), F.lit("")), LINES)


# ---- fixed values ----
#: Spellings of a line, each with a sign that a line must hold (lower-cased) for the pattern to be tried.
LINE_RULES = (
    ("net", IU + r"\.?\s*net\b", "DotNet"), ("#", IU + r"\bC\s*#\b", "C#"), ("+", IU + r"\bmiddle\s*\+\b", "Middle+"), (",", r"(\d),(\d)", "$1.$2"),
    ("/", IU + r"/(cv[_\-][A-Za-z0-9]+)\b", "CV_CODE: $1"), ("", r"(?U)\s{2,}", " "),
)
# ---- end of fixed values ----


def _plain_line(x: Column) -> Column:
    return F.replace(F.translate(strip(F.coalesce(x, F.lit(""))), "–—−", "---"), F.lit("₽"), F.lit(" RUB"))


def normalize_bench_line(x: Column | str) -> Column:
    t = _plain_line(_c(x))
    for _, pattern, by in LINE_RULES:
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def normalize_bench_lines(x: Column) -> Column:
    """An array's lines normalized, rule by rule: within a step a line is a variable, so nothing is worked out twice, and most lines pass most rules by."""
    t = F.transform(x, _plain_line)
    for sign, pattern, by in LINE_RULES:
        t = F.transform(t, _tried(sign, pattern, by))
    return F.transform(t, strip)


def _tried(sign: str, pattern: str, by: str):
    return lambda v: F.when(F.contains(F.lower(v), F.lit(sign)), F.regexp_replace(v, pattern, by)).otherwise(v)


def _hinted(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in VACANCY_HINTS])


def vacancy_hint(x: Column | str) -> Column:
    return _hinted(F.lower(_c(x)))


def _confidence(t: Column, low: Column, hint: Column) -> Column:
    points = lambda cond, n: F.when(cond, n).otherwise(0.0)
    near = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])  # noqa: E731  # before an expression is tried, a word that it needs
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    score = points(near(*GRADE_PARTS) & has(t, GRADE), 0.20) + points(near("опыт") & has(t, EXPERIENCE), 0.25) + points(near("ставк", "rate") & has(t, RATE), 0.25) + points(near("cv") & has(t, CV), 0.25) - points(hint, 0.35) + points((words >= 4) & ~hint, 0.10)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 10)


def bench_signals(normalized: Column | str) -> Column:
    """struct(confidence, vacancy_hint) of a normalized line: how much it looks like a specialist's card."""
    t = _c(normalized)
    hint = vacancy_hint(t)
    return F.struct(_confidence(t, F.lower(t), hint).alias("confidence"), hint.alias("vacancy_hint"))


def pre_classify(signals: Column | str) -> Column:
    """struct(kind, confidence, is_confident, reason, vacancy_hint) from a line's signals."""
    score, hint = _c(signals)["confidence"], _c(signals)["vacancy_hint"]
    sure = (score >= 0.70) & ~hint
    reason = F.when(sure, "bench_card_rule_match").when(hint, "vacancy_hints_present").when(score >= 0.45, "weak_bench_signal").otherwise("no_match")
    return F.struct(F.when(sure, "BENCH").otherwise("UNKNOWN").alias("kind"), score.alias("confidence"), sure.alias("is_confident"), reason.alias("reason"), hint.alias("vacancy_hint"))


def with_bench_lines(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: array of struct(idx, text) of the lines of texts that are lists of cards, else an empty one."""
    kept = df.columns
    # without one of these words a line's confidence is 0.30 at most, and normalizing makes none of them: only lines that hold one are normalized, and
    # only texts with two such lines are looked through
    card = lambda v: reduce(lambda a, b: a | b, [F.contains(v, F.lit(w)) for w in CARD_WORDS])
    raw = F.when(card(F.lower(_c(text))), F.transform(lines(text), lambda v: F.struct(v.alias("text"), card(F.lower(v)).alias("card"))))
    rows = df.select(*kept, raw.alias("_raw")).select(*kept, F.when(F.size(F.filter("_raw", lambda s: s["card"])) >= 2, F.col("_raw")).alias("_raw"))
    bare = F.transform("_raw", lambda s, i: F.struct((i + 1).alias("idx"), F.regexp_replace(strip(s["text"]), r"(?U)^[\-•\d).\s]+", "").alias("text"), s["card"].alias("card")))
    rows = rows.select(*kept, F.filter(bare, lambda s: s["text"] != "").alias("_full"))
    rows = rows.select(*kept, F.size("_full").alias("_n"), F.filter("_full", lambda s: s["card"]).alias("_cards"))
    rows = rows.select(*kept, "_n", F.when((F.size("_cards") >= 2) & (F.size("_cards") >= F.floor(F.col("_n") * 0.6)), F.col("_cards")).alias("_cards"))
    rows = rows.select(*kept, "_n", "_cards", normalize_bench_lines(F.transform("_cards", lambda s: s["text"])).alias("_lines"))
    done = F.zip_with("_cards", "_lines", lambda s, v: F.struct(s["idx"].alias("idx"), v.alias("text"), F.lower(v).alias("low")))
    rows = rows.select(*kept, "_n", F.filter(done, lambda s: ~_hinted(s["low"])).alias("_j"))
    rows = rows.select(*kept, "_n", F.filter("_j", lambda s: _confidence(s["text"], s["low"], F.lit(False)) >= 0.55).alias("_hits"))
    enough = (F.size("_hits") >= 2) & (F.size("_hits") >= F.floor(F.col("_n") * 0.6))
    found = F.transform("_hits", lambda s: F.struct(s["idx"].alias("idx"), s["text"].alias("text")))
    return rows.select(*kept, F.when(enough, found).otherwise(F.array().cast("array<struct<idx:int,text:string>>")).alias(out))


def split_bench_lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """id, idx, text: the lines of texts that are lists of cards; other texts have no row."""
    # an explode that is no outer one asks for lists that are not empty, and Spark moves that question below the steps, where each repeats the one before wherever it names it
    rows = with_bench_lines(df.select(id, text), text, "_cards").select(id, F.explode_outer("_cards").alias("_u"))
    return rows.where(F.col("_u").isNotNull()).select(id, "_u.idx", "_u.text")


def hybrid_decision(pre: Column | str, forced: Column, label: Column, threshold: float = 0.55) -> Column:
    """struct(kind, source): forced, then rule, then the model's label; an OTHER that looks like a card counts as one."""
    p = _c(pre)
    back = (label == "OTHER") & (p["confidence"] >= threshold) & ~p["vacancy_hint"]
    kind = F.when(forced.isNotNull(), forced).when(p["is_confident"], "BENCH").when(label.isNull(), "UNKNOWN").when(back, "BENCH").otherwise(label)
    source = F.when(forced.isNotNull(), "forced").when(p["is_confident"], "rule").when(label.isNull(), "pending_llm").when(back, "fallback").otherwise("llm")
    return F.struct(kind.alias("kind"), source.alias("source"))


def contacts(x: Column | str) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    none = F.array().cast("array<string>")
    at = lambda found: F.when(F.contains(t, F.lit("@")), found).otherwise(none)  # noqa: E731  # patterns are tried where their signs stand
    phone = F.regexp_extract_all(t, F.lit(r"(?U)(?:(?:\+7|7|8)\s*)?(?:\(?\d{3}\)?\s*)?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"), F.lit(0))
    phone = F.when(F.regexp_like(t, F.lit(r"(?U)\d{2}")), phone).otherwise(none)
    phone = F.transform(F.filter(phone, lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 10), strip)
    handles = F.regexp_extract_all(t, F.lit(r"@[A-Za-z0-9_]{4,64}"), F.lit(0))
    mails = F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(at(handles), at(mails), phone)))


def text_urls(x: Column | str) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    full = F.regexp_extract_all(t, F.lit(r"(?U)https?://[^\s)]+"), F.lit(0))
    bare = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\bt\.me/[^\s)]+"), F.lit(0)), lambda u: F.concat(F.lit("https://"), u))
    return F.array_sort(F.array_distinct(F.transform(F.concat(full, bare), lambda u: F.regexp_replace(u, "[.,;]+$", ""))))


def extract_urls(x: Column | str) -> Column:
    """Links in order, sheet and document links first, wrapped ones joined and odd edit forms repaired."""
    t = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?i)(https?://docs\.google\.com/spreadsheets/d/[A-Za-z0-9_-]+)\s+([A-Za-z0-9_-]+/edit(?:7gid=|gid=|[?#]gid=)[^\s<>()]+)", "$1$2")
    docs = F.regexp_extract_all(t, F.lit(r"(?i)https?://docs\.google\.com/(?:spreadsheets/d|document/d|forms/d|file/d)/[A-Za-z0-9_\-\s]+(?:/[^\s<>()]*)?"), F.lit(0))
    rest = F.regexp_extract_all(t, F.lit(r"(?i)https?://[^\s<>()]+"), F.lit(0))

    def clean(u: Column) -> Column:
        u = F.regexp_replace(F.regexp_replace(u, r"\s+", ""), r"[).,;\]>]+$", "")
        return F.regexp_replace(u, r"(?i)/edit(?:7gid=|gid=|&gid=)", "/edit?gid=")

    return F.array_distinct(F.transform(F.concat(docs, rest), clean))


def external_urls(x: Column | str) -> Column:
    return F.filter(extract_urls(x), lambda u: ~F.contains(F.lower(u), F.lit("t.me/")))


def url_host(u: Column) -> Column:
    """Host with port, lower-cased."""
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def classify_url(x: Column | str) -> Column:
    host, path = url_host(_c(x)), url_path(_c(x))
    docs = host == "docs.google.com"
    out = F.when(docs & F.startswith(path, F.lit("/spreadsheets/")), "google_sheet").when(docs & F.startswith(path, F.lit("/document/")), "google_doc")
    out = out.when((host == "drive.google.com") & F.contains(path, F.lit("/file/")), "google_drive_file").when(host.isin(*YANDEX_HOSTS), "yandex_disk_public")
    for ext, name in FILE_KINDS:
        out = out.when(F.endswith(path, F.lit(ext)), name)
    return out.otherwise("generic_url")


def url_allowed(x: Column | str, domains: tuple[str, ...] = ()) -> Column:
    """http(s) in any case, not local, private, multicast or reserved (whole addresses of both versions, not names that begin like one), and of an allowed
    domain if any are given."""
    u = _c(x)
    net = F.regexp_replace(url_host(u), r"^.*@", "")
    six = F.regexp_extract(net, r"^\[([^\]]*)\](?::\d*)?$", 1)
    host = F.when(F.startswith(net, F.lit("[")), six).otherwise(F.regexp_replace(net, r":\d*$", ""))
    private = F.regexp_like(host, F.lit(rf"^(?:localhost|.*\.local|{PRIVATE_V4}|{PRIVATE_V6})$"))
    good = F.regexp_like(u, F.lit("(?i)^https?://")) & (host != "") & ~private
    if domains:
        good = good & reduce(lambda a, b: a | b, [(host == d) | F.endswith(host, F.lit("." + d)) for d in (x.strip().lower() for x in domains) if d])
    return good


def export_url(x: Column | str) -> Column:
    """Share link of a sheet, document or file -> its download link; others as they are."""
    u = _c(x)
    sheet = F.regexp_extract(u, r"docs\.google\.com/spreadsheets/d/([A-Za-z0-9_-]+)", 1)
    gid = F.regexp_extract(u, r"[?#&]gid=(\d+)", 1)
    doc = F.regexp_extract(u, r"docs\.google\.com/document/d/([A-Za-z0-9_-]+)", 1)
    file = F.regexp_extract(u, r"drive\.google\.com/file/d/([A-Za-z0-9_-]+)", 1)
    csv = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sheet, F.lit("/export?format=csv"), F.when(gid != "", F.concat(F.lit("&gid="), gid)).otherwise(""))
    return (
        F.when(sheet != "", csv)
        .when(doc != "", F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/export?format=txt")))
        .when(file != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file))
        .otherwise(u)
    )


def message_url(chat_id: Column | str, message_id: Column | str, username: Column, thread_id: Column) -> Column:
    """Public link by name, private link of a negative chat id, null else; a thread comes before the message."""
    tail = F.concat(F.when(thread_id.isNotNull(), F.concat(thread_id.cast("string"), F.lit("/"))).otherwise(""), _c(message_id).cast("string"))
    chat = _c(chat_id).cast("string")
    public = F.concat(F.lit("https://t.me/"), F.ltrim(username, F.lit("@")), F.lit("/"), tail)
    private = F.concat(F.lit("https://t.me/c/"), F.regexp_replace(chat, "^-(100)?", ""), F.lit("/"), tail)
    return F.when(F.coalesce(username, F.lit("")) != "", public).when(F.startswith(chat, F.lit("-")), private)


def canonical_message_url(x: Column | str) -> Column:
    m = F.regexp_extract(_c(x), r"(?i)(?:https?://)?t\.me/((?:c/)?[A-Za-z0-9_]+(?:/\d+)?/\d+)", 1)
    return F.when(m != "", F.concat(F.lit("https://t.me/"), m))


def availability(x: Column | str, weeks: Column | str, flag: Column | str) -> Column:
    t = F.coalesce(_c(x), F.lit(""))
    return F.when(any_of(t, UNAVAILABLE), False).when(_c(weeks) > 0, False).when(any_of(t, AVAILABLE), True).otherwise(F.coalesce(_c(flag), F.lit(True)))


def labeled_value(x: Column | str, *labels: str) -> Column:
    v = F.regexp_extract(_c(x), r"(?imU)^(?:" + "|".join(labels) + r")\s*:\s*(.+?)\s*$", 1)
    return F.nullif(v, F.lit(""))


def guess_role(x: Column | str, weak: bool = True) -> Column:
    """The first of a post's first lines with three characters or more, without its mark and its opening word; else, if weak ones count, its first line."""
    mark = lambda v: F.regexp_replace(v, r"(?U)^[=~\-—•*]+\s*", "")
    verb = lambda v: F.regexp_replace(v, r"(?iU)^(требуется|нужен|нужна|ищем|вакансия)\s*[:\-]?\s*", "")
    cut = lambda v: strip(F.substring(v, 1, 120))
    found = lambda full: F.get(F.filter(F.transform(full, lambda v: cut(verb(mark(v)))), lambda v: F.length(v) >= 3), F.lit(0))
    first = lambda full: F.get(F.filter(F.transform(F.slice(full, 1, 1), lambda v: cut(mark(v))), lambda v: v != ""), F.lit(0))
    full = F.slice(F.filter(F.transform(lines(x), strip), lambda v: v != ""), 1, 6)
    return given(full, lambda v: F.coalesce(found(v), first(v)) if weak else found(v))


def guess_grade(x: Column | str) -> Column:
    t = _c(x)
    label = F.regexp_extract(t, r"(?iU)(?:уровень|грейд)\s*[:\-]\s*([A-Za-zА-Яа-я+/ ]{3,30})", 1)
    g = F.when(label != "", label).otherwise(F.regexp_extract(t, r"(?iU)\b(Junior|Middle\+?|Senior|Lead|Architect)\b", 1))
    g = F.replace(F.lower(strip(g)), F.lit(" "), F.lit(""))
    in_ = lambda w: F.contains(g, F.lit(w))
    return F.when(in_("junior"), "Junior").when(in_("middle+") | in_("middleplus"), "Middle+").when(in_("middle"), "Middle").when(in_("senior"), "Senior").when(in_("lead"), "Lead").when(in_("architect") | in_("архит"), "Architect")


def guess_stack(x: Column | str) -> Column:
    return given(F.lower(_c(x)), lambda low: F.slice(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(show)) for w, show in TOOL_WORDS])), 1, 25))


def parse_kv_lines(x: Column | str) -> Column:
    """``key: value`` lines as a map, keys lower-cased; the last of a key wins."""
    pairs = F.transform(F.filter(lines(x), lambda v: F.contains(v, F.lit(":"))), lambda v: F.struct(F.lower(strip(F.substring_index(v, ":", 1))).alias("key"), strip(F.regexp_replace(v, "^[^:]*:", "")).alias("value")))
    good = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(given(good, last))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numbered HTML entities; Spark has no function for them."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def unescape_ended(texts: pd.Series) -> pd.Series:
    """The same for those that a semicolon ends and whose whole name is known."""
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return texts.map(lambda t: ENDED.sub(known, t), na_action="ignore")


def html_to_text(x: Column | str, unended: bool = True) -> Column:
    """Text of a page: scripts and styles dropped, breaks and paragraph ends as line ends, other tags as blanks, all entities unescaped. unended: also those
    without a semicolon, as browsers read them."""
    t = F.coalesce(_c(x), F.lit(""))
    for pattern, by in ((r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n"), (r"(?s)<[^>]+>", " ")):
        t = F.regexp_replace(t, pattern, by)
    by = unescape if unended else unescape_ended
    t = F.coalesce(by(F.when(F.contains(t, F.lit("&")), t)), t)  # only texts with entities pass the helper
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t ]+", " "), r"\n{3,}", "\n\n")
    return strip(t)


def search_text(role: Column, stack: Column, grade: Column, years: Column, description: Column, most: int = 500) -> Column:
    full = lambda c, head: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(head), c.cast("string")))
    return F.concat_ws(" | ", full(role, "Role: "), full(F.array_join(stack, ", "), "Technologies: "), full(grade, "Grade: "), full(years, "Experience: "), full(F.substring(description, 1, most), "Description: "))


def format_rate(low: Column | str, high: Column | str) -> Column:
    a, b = F.format_number(_c(low).cast("double"), 0), F.format_number(_c(high).cast("double"), 0)
    return F.translate(F.coalesce(F.when(_c(low).isNotNull() & _c(high).isNotNull() & (_c(low) != _c(high)), F.concat(a, F.lit("–"), b)), a, b, F.lit("—")), ",", " ")


def entity_summary(role: Column, grade: Column, stack: Column) -> Column:
    dash = lambda c: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("—"))
    return F.concat_ws(" | ", dash(role), dash(grade), dash(F.array_join(F.slice(stack, 1, 6), ", ")))


def registry_index(locator: Column | str) -> Column:
    """What follows the last colon, else the last hash, of a registry place; the place itself if there is none; a dash if it is blank."""
    t = strip(F.coalesce(_c(locator), F.lit("")))
    tail = lambda sep: F.nullif(F.when(F.contains(t, F.lit(sep)), strip(F.substring_index(t, sep, -1))), F.lit(""))
    return F.coalesce(tail(":"), tail("#"), F.nullif(t, F.lit("")), F.lit("-"))


def rate_range(low: Column | str, high: Column | str, currency: Column | str) -> Column:
    """The range in words, as lists show it; zero counts as missing."""
    a, b = (F.nullif(_c(x), F.lit(0)).cast("string") for x in (low, high))
    full = F.coalesce(F.concat(F.lit("от "), a, F.lit(" до "), b), F.concat(F.lit("от "), a), F.concat(F.lit("до "), b))
    return F.coalesce(strip(F.concat(full, F.lit(" "), F.coalesce(strip(_c(currency)), F.lit("")))), F.lit("—"))


def registry_candidates(df: DataFrame, key: str, text: str, position: str, company: str, columns: tuple[str, ...]) -> DataFrame:
    """company, url, column, position: the links of the given columns of registry rows (``key: value`` lines), each once, at its first row and column."""
    pairs = df.select(key, position, parse_kv_lines(text).alias("_m"))
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("column"), F.try_element_at("_m", F.lit(c)).alias("v")) for n, c in enumerate(columns)])).alias("_x")
    rows = pairs.select(key, position, F.try_element_at("_m", F.lit(company)).alias("company"), at)
    rows = rows.select(position, "company", "_x.n", "_x.column", F.posexplode(external_urls("_x.v")).alias("_p", "url"))
    first = rows.groupBy("url").agg(F.min(F.struct(position, "n", "_p", "company", "column")).alias("f"))
    return first.select("f.company", "url", "f.column", F.col(f"f.{position}").alias("position"))


def source_index(locator: Column | str, fallback: Column | str) -> Column:
    n = lambda c: F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(\d+)\s*$", 1), F.lit(""))
    return F.coalesce(n(locator), n(fallback), F.lit("-"))

