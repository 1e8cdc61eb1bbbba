"""Whole messages: batches, what is relevant in them, archived copies, bulk posts, items guessed by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .cleaning import clean_message
from .matching import IU, _c, given, strip

# ---- fixed values ----
BENCH_ANCHORS = (r"\bуровень\b\s*[:\-]", r"\bопыт\b\s*[:\-]", r"\bстек\b\s*[:\-]", r"\bлокац(?:ия|ион)\b\s*[:\-]", r"\bготовност(?:ь|и)\b\s*[:\-]", r"\b(?:рейт|ставка)\b\s*[:\-]")
VACANCY_ANCHORS = (r"\bтребован(?:ия|ий)\b\s*[:\-]", r"\bобязанност(?:и|ей)\b\s*[:\-]", r"\bуслов(?:ия|ий)\b\s*[:\-]", r"\bзадач(?:и|)\b\s*[:\-]")
ANCHOR_WORDS = ("уровень", "опыт", "стек", "локац", "готовност", "рейт", "ставка", "требован", "обязанност", "услов", "задач")
REPEATED = ("уровень", "опыт", "требован")
SEPARATOR = r"(?m)^\s*[=~]\s*\S"
KEPT_WORDS = (
    "требован", "обязан", "задач", "ответствен", "услов", "ставк", "оплат", "срок", "дедлайн", "подач", "локац", "формат", "удал", "remote", "гибрид", "офис", "заказчик", "клиент",
    "компан", "контакт", "рекрутер", "telegram", "tg", "присылать", "прислать", "уровень", "опыт", "стек", "готовн", "рейт", "кандид", "специал", "jira", "confluence", "atlassian",
    "bitbucket", "bamboo", "crowd", "ндс", "vat", "net", "gross", "резюме", "cv",
)
MONEY_WORDS = ("руб", "rub", "usd", "eur", "₽", "$", "€", "ндс", "vat", "day", "дней", "дня")
DATE, NUMBER = r"\b\d{2}\.\d{2}\.\d{4}\b", r"\b\d{3,6}\b"
ARCHIVE_MARKERS = ("Копия исходного сообщения", "-- копия исходного сообщения --", "Текст сообщения:")
ARCHIVE_TYPE = r"(?im)^Тип:\s*(bench|vacancy)\s*$"
BULK_HINTS = ("доступны", "специалист", "анкеты", "кейсы", "ставки", "в л/с", "усилить команду", "топовые")
BENCH_HINTS = ("ищу проект", "ищу работу", "в поиске", "open to work", "готов рассмотреть", "рассмотрю предложения", "на бенче", "bench", "резюме", "ищу позицию", "доступен", "свободен", "готов к выходу")
STRONG_VACANCY_HINTS = ("ищем", "требуется", "вакансия", "нанимаем", "в команду", "открыта позиция", "обязанности", "требования", "условия", "мы предлагаем", "оформление")
# ---- end of fixed values ----

#: Lines of the head that always stay, relevant lines below which plain ones are taken instead, where these end, and characters that make it worth it.
HEAD, FEW, UPTO, WORTH = 12, 12, 80, 250


def _any(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def _hits(x: Column, patterns) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(x, F.lit(IU + p)) for p in patterns])


def is_batch(x: Column | str) -> Column:
    """Several cards or vacancies in one message."""
    def several(s: Column) -> Column:
        t, low, folded = s["t"], s["l"], s["f"]
        twice = reduce(lambda a, b: a | b, [F.regexp_count(low, F.lit(w)) >= 2 for w in REPEATED])
        # an anchor is looked for where its word stands
        hits = lambda patterns: F.when(_any(folded, ANCHOR_WORDS), _hits(t, patterns)).otherwise(0)
        return twice | (F.regexp_count(t, F.lit(SEPARATOR)) >= 2) | (hits(BENCH_ANCHORS) >= 2) | (hits(VACANCY_ANCHORS) >= 2)

    return given(given(F.coalesce(_c(x), F.lit("")), lambda t: F.struct(t.alias("t"), F.lower(t).alias("l"), F.lower(F.upper(t)).alias("f"))), several)


def _relevant(line: Column, low: Column) -> Column:
    money = F.regexp_like(line, F.lit(NUMBER)) & _any(low, MONEY_WORDS)
    return F.contains(line, F.lit("@")) | _any(low, ("t.me/", "http")) | F.regexp_like(line, F.lit(DATE)) | money | _any(low, KEPT_WORDS)


def keep_relevant(x: Column | str, most: int = 200) -> Column:
    """The first lines and the relevant ones of the rest, or, if these are few, the lines that follow the head."""

    def split(full: Column) -> Column:
        rest = F.transform(F.slice(full, HEAD + 1, F.greatest(F.size(full), F.lit(1))), lambda v: F.struct(v.alias("v"), F.lower(v).alias("l")))
        return F.struct(full.alias("full"), F.transform(F.filter(rest, lambda s: _relevant(s["v"], s["l"])), lambda s: s["v"]).alias("good"))

    def joined(s: Column) -> Column:
        body = F.when(F.size(s["good"]) < FEW, F.slice(s["full"], HEAD + 1, UPTO - HEAD)).otherwise(s["good"])
        return F.array_join(F.slice(F.concat(F.slice(s["full"], 1, HEAD), F.array(F.lit("")), body), 1, most), "\n")

    # nested, so that lines are stripped, lower-cased and looked through once
    return strip(given(given(F.filter(F.transform(T.lines(x), strip), lambda v: v != ""), split), joined))


def compact(df: DataFrame, cleaned: str, most: int = 7000) -> DataFrame:
    """df with ``text`` and ``is_batch`` of a cleaned message: unless it is a batch, its relevant lines if it is long or they are enough.

    Step by step, so that lines are looked through once for each step."""
    rows = df.withColumn("is_batch", is_batch(cleaned))
    rows = rows.withColumn("_once", F.when(~F.col("is_batch") & (F.length(cleaned) > most), keep_relevant(cleaned, 180)).otherwise(F.col(cleaned)))
    rows = rows.withColumn("_again", F.when(~F.col("is_batch"), keep_relevant("_once", 220)))
    return rows.withColumn("text", F.when(F.length("_again") >= WORTH, F.col("_again")).otherwise(F.col("_once"))).drop("_once", "_again")


def preprocess(df: DataFrame, id: str, text: str) -> DataFrame:
    """id, text, is_batch, contacts, urls, role, grade, stack: a message made ready for extraction, with what rules tell of it."""
    rows = compact(df.select(F.col(id), clean_message(text).alias("_t")), "_t")
    return rows.select(id, "text", "is_batch", T.contacts("_t").alias("contacts"), T.text_urls("_t").alias("urls"), T.guess_role("text").alias("role"), T.guess_grade("text").alias("grade"), T.guess_stack("text").alias("stack"))


def fallback_item(kind: str, text: str = "text", role: str = "role", grade: str = "grade", stack: str = "stack", contacts: str = "contacts", urls: str = "urls") -> Column:
    """An item as the model would give it, from the rules only. kind: VACANCY or BENCH."""
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    empty = lambda *names: [F.array().cast("array<string>").alias(n) for n in names]
    head = [F.coalesce(_c(role), F.lit("Unknown")).alias("role"), F.coalesce(_c(stack), F.array().cast("array<string>")).alias("stack"), _c(grade).alias("grade")]
    head += none("int", "experience_years_min", "experience_years_max", "rate_min", "rate_max") + none("string", "currency", "rate_period") + none("boolean", "rate_is_net")
    tail = [_c(contacts).alias("contacts"), _c(urls).alias("source_urls")]
    cut = lambda n: strip(F.substring(F.coalesce(_c(text), F.lit("")), 1, n))
    if kind == "VACANCY":
        own = none("string", "company", "client", "location", "work_format", "employment_type", "timezone", "start_date") + none("int", "duration_months") + empty("responsibilities", "requirements", "nice_to_have", "benefits")
        return F.struct(*head, *own, *tail, F.lit(False).alias("is_closed"), *none("string", "close_reason"), cut(1500).alias("description"))
    own = none("string", "location", "work_format", "timezone") + none("int", "availability_weeks") + [F.lit(True).alias("is_available")]
    return F.struct(*head, *own, *tail, *empty("languages"), *none("string", "relocation"), F.nullif(cut(1000), F.lit("")).alias("description"))


def archive_payload(x: Column | str) -> Column:
    """What follows the first marker that the text holds (in the markers' order), or the whole if that is blank."""
    t = F.coalesce(_c(x), F.lit(""))
    out = None
    for m in ARCHIVE_MARKERS:
        tail = strip(F.substring(t, F.locate(m, t) + F.lit(len(m)), F.length(t)))
        hit, value = F.contains(t, F.lit(m)), F.when(tail != "", tail).otherwise(strip(t))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(strip(t))


def archive_type(x: Column | str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(_c(x), F.lit("")), ARCHIVE_TYPE, 1)), F.lit(""))


def bench_blast(x: Column | str) -> Column:
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    return (F.contains(low, F.lit("доступны")) & F.contains(low, F.lit("специалист"))) | _any(low, ("подробные анкеты", "в л/с", "в лс"))


def bulk_items(x: Column | str) -> Column:
    """The bullet lines of a post with at least five bullets and a hint of several people; else none."""
    t = F.coalesce(_c(x), F.lit(""))
    full = F.filter(F.transform(T.lines(t), strip), lambda v: F.regexp_like(v, F.lit("^[–•-]")))
    items = F.filter(F.transform(full, lambda v: strip(F.regexp_replace(v, "^[–•-]+", ""))), lambda v: F.length(v) >= 6)
    return F.when((F.size(full) >= 5) & _any(F.lower(t), BULK_HINTS), items).otherwise(F.array().cast("array<string>"))


def keyword_kind(x: Column | str, label: Column | str) -> Column:
    """Bench hints, then strong vacancy hints, then the model's label by its beginning words, else OTHER."""
    low, said = F.lower(F.coalesce(_c(x), F.lit(""))), F.upper(strip(F.coalesce(_c(label), F.lit(""))))
    return F.when(_any(low, BENCH_HINTS), "BENCH").when(_any(low, STRONG_VACANCY_HINTS), "VACANCY").when(F.contains(said, F.lit("VAC")), "VACANCY").when(_any(said, ("BEN", "SPEC", "CAND")), "BENCH").otherwise("OTHER")


def partner_bias(decision: Column | str, partner: Column | str, sure: Column | str) -> Column:
    """A decision struct(kind, source) with OTHER turned to VACANCY where a partner is named and the rules are not sure."""
    d = _c(decision)
    flip = (d["kind"] == "OTHER") & _c(partner).isNotNull() & ~F.coalesce(_c(sure), F.lit(False))
    return F.struct(F.when(flip, "VACANCY").otherwise(d["kind"]).alias("kind"), F.when(flip, "partner_bias").otherwise(d["source"]).alias("source"))


def needs_reference(text: Column | str, manual: Column | str, archive: Column | str, forwarded: Column | str) -> Column:
    """Whether a message typed by hand has nothing to refer to: not from the archive, not forwarded, without links of either kind, not blank."""
    t = F.coalesce(_c(text), F.lit(""))
    typed = F.coalesce(_c(manual), F.lit(False)) & ~F.coalesce(_c(archive), F.lit(False))
    return typed & (strip(F.coalesce(_c(forwarded), F.lit(""))) == "") & T.canonical_message_url(t).isNull() & (F.size(T.external_urls(t)) == 0) & (strip(t) != "")


def trim_error(x: Column | str, most: int = 160) -> Column:
    t = strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.nullif(F.when(F.length(t) <= most, t).otherwise(cut), F.lit(""))


def sync_stamp(ts: Column | str) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(_c(ts), "Europe/Moscow"), "dd.MM HH:mm"), F.lit(" МСК"))


def sync_text(error: Column | str, success: Column | str) -> Column:
    """What an empty own bench says: the last error and, if there was one, the last good version; null if there is no error."""
    e, s = trim_error(error), sync_stamp(success)
    both = F.concat(F.lit("Наш бенч сейчас не синхронизирован. Последняя успешная версия: "), s, F.lit(". Последняя ошибка: "), e)
    return F.coalesce(both, F.concat(F.lit("Наш бенч ещё не синхронизирован. Последняя ошибка: "), e))


def cut_body(prefix: Column | str, body: Column | str, total: int = 3900) -> Column:
    """The body cut so that prefix and body have at most ``total`` characters."""
    b = F.coalesce(_c(body), F.lit(""))
    room = F.greatest(F.lit(0), F.lit(total) - F.length(F.coalesce(_c(prefix), F.lit(""))))
    return F.when(F.length(b) <= room, b).otherwise(F.concat(F.substring(b, F.lit(1), F.greatest(F.lit(0), room - 1)), F.lit("…")))


def octal_text(x: Column | str) -> Column:
    """Text with ``\\NNN`` octal escapes of UTF-8 bytes read back; cut or broken sequences become replacement marks."""
    t = F.coalesce(_c(x), F.lit(""))
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)(\\[0-3][0-7]{2}|.)"), F.lit(1))
    digit = lambda p, k: F.substring(p, k, 1).try_cast("int")
    octal = lambda p: F.hex(digit(p, 2) * 64 + digit(p, 3) * 8 + digit(p, 4))
    code = lambda p: F.when(F.regexp_like(p, F.lit(r"^\\[0-3][0-7]{2}$")), F.lpad(octal(p), 2, "0")).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, code), "")).cast("string"))
