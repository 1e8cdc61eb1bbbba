"""Entities from model output and stored JSON; provenance strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .matching import IU, _c, given, match_token, strip, urlish

ITEMS = "items array<struct<role:string,stack:array<string>,grade:string,rate_min:int,rate_max:int,currency:string,company:string,location:string,description:string,is_closed:boolean>>"


# ---- fixed values ----
LABELS = {"manager": "Менеджер: ", "file": "Ссылка на файл: ", "sheet": "Лист: ", "table": "Таблица: ", "index": "Индекс: ", "archive": "Ссылка на архив-пост: ", "message": "Ссылка на сообщение: "}
# ---- end of fixed values ----


def model_items(x: Column | str, schema: str = ITEMS) -> Column:
    """The items of a model's answer: what stands between the first and the last brace, parsed; a missing closing brace is added; null if it is no object."""
    t = F.coalesce(_c(x), F.lit(""))
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    cut = F.concat(F.regexp_extract(t, r"(?s)\{.*", 0), F.lit("]}"))
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), schema)["items"], F.from_json(cut, schema)["items"])


def json_list(x: Column | str) -> Column:
    """A JSON text as a list of strings; anything else gives an empty one."""
    return F.coalesce(F.from_json(_c(x), "array<string>"), F.array().cast("array<string>"))


def embedding(x: Column | str, dim: int) -> Column:
    """A JSON text as a vector; null if it is none or of another dimension."""
    v = F.from_json(_c(x), "array<double>")
    return F.when(F.size(v) == dim, v)


def sanitize_stack(x: Column | str, most: int = 20) -> Column:
    """Items split, without labels, links and long ones, one per token."""
    from .matching import distinct_by

    flat = F.flatten(F.transform(F.coalesce(_c(x), F.array().cast("array<string>")), lambda s: F.split(F.coalesce(s, F.lit("")), r"[\n,;]")))
    clean = F.transform(flat, lambda s: strip(F.regexp_replace(s, r"(?iU)^\s*(langs?|databases?|devops|stack|tools?|frameworks?)\s*:", "")))
    good = F.filter(clean, lambda s: (s != "") & (F.length(s) <= 80) & ~(F.contains(s, F.lit(":")) & (F.length(s) > 40)) & ~urlish(s))
    return F.slice(distinct_by(good, match_token), 1, most)


# ---- fixed values ----
STACK_LABEL = r"\b(langs?|databases?|devops|stack|tools?|frameworks?)\s*:"
ROLE_LIKE = r"\b(developer|engineer|analyst|designer|manager|architect|разработ|аналит|дизайн|менедж|архитект)\w*\b"
AWAY = r"\b(not available|занят|недоступ|hired|off)\b"
AT_ONCE = ("asap", "now", "сразу")
DESCRIBED = ("description", "requirements_text", "responsibilities_text", "english", "availability", "resume_url")
# ---- end of fixed values ----
#: The fields of a structured item, as a map of text with the stack apart.
NO_ROLE = "Unknown"


def short(x: Column, most: int) -> Column:
    """With single blanks, cut; null if blank."""
    return F.get(F.filter(F.array(F.substring(strip(F.regexp_replace(x, r"(?U)\s+", " ")), 1, most)), lambda v: v != ""), F.lit(0))


def stack_blob(x: Column) -> Column:
    """Whether a text is a list of tools and no role."""
    labelled = lambda t: F.contains(t, F.lit(":")) & F.regexp_like(t, F.lit(IU + STACK_LABEL))
    blob = lambda t: (F.length(t) > 120) | labelled(t) | (F.regexp_count(t, F.lit(",")) >= 5) | (F.regexp_count(t, F.lit("\n")) >= 2)
    return given(strip(F.coalesce(x, F.lit(""))), blob)


def coerce_role(role: Column | str, stack: Column | str, guessed: Column | str) -> Column:
    """The given role unless it is a list of tools or a link, else the guessed one on the same terms, else the first of the stack that is like a role, else
    the first that is no link, else Unknown."""
    good = lambda c: F.when((strip(c) != "") & ~stack_blob(c) & ~urlish(c), short(c, 255))
    s = F.coalesce(_c(stack), F.array().cast("array<string>"))  # a column or a variable: read twice
    like = F.get(F.filter(s, lambda x: F.regexp_like(x, F.lit(IU + ROLE_LIKE))), F.lit(0))
    plain = F.get(F.filter(s, lambda x: ~urlish(x)), F.lit(0))
    return F.coalesce(good(_c(role)), good(_c(guessed)), short(like, 255), short(plain, 255), F.lit(NO_ROLE))


def _item(fields: Column | str, stack: Column | str, text: Column | str, guessed: Column | str, make) -> Column:
    """make(field, stack, role, description), with stack and role worked out once."""
    f = lambda k: F.try_element_at(_c(fields), F.lit(k))
    full = lambda x: F.get(F.filter(F.array(x), lambda v: v != ""), F.lit(0))
    two = given(sanitize_stack(stack), lambda own: F.struct(own.alias("own"), coerce_role(f("role"), own, guessed).alias("role")))
    parts = [full(f(k)) for k in DESCRIBED] + [full(strip(F.coalesce(_c(text), F.lit(""))))]
    description = F.substring(strip(F.concat_ws("\n", *parts)), 1, 2000)
    own = lambda s: F.when(F.size(s["own"]) > 0, s["own"]).when(s["role"] != NO_ROLE, F.array(s["role"])).otherwise(s["own"])
    return given(two, lambda s: make(f, own(s), s["role"], description))


def structured_specialist(fields: Column | str, stack: Column | str, text: Column | str, guessed: Column | str) -> Column:
    """A specialist's item from the fields (map of text), the stack's texts, the unit's text and the role guessed from it."""
    from .people import unit_name

    def make(f, own: Column, role: Column, description: Column) -> Column:
        when = F.lower(F.coalesce(f("availability"), F.lit("")))
        one = lambda k: F.when(F.coalesce(f(k), F.lit("")) != "", F.array(f(k))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            unit_name(text, f("name"), role).alias("name"), role.alias("role"), own.alias("stack"), short(f("grade"), 50).alias("grade"), f("rate_min").try_cast("int").alias("rate_min"),
            short(f("currency"), 10).alias("currency"), short(f("location"), 255).alias("location"), short(f("work_format"), 120).alias("work_format"),
            F.when(when.isin(*AT_ONCE), 0).alias("availability_weeks"), (~F.regexp_like(when, F.lit(IU + AWAY))).alias("is_available"), one("resume_url").alias("source_urls"),
            one("english").alias("languages"), F.nullif(description, F.lit("")).alias("description"),
        )

    return _item(fields, stack, text, guessed, make)


def structured_vacancy(fields: Column | str, stack: Column | str, text: Column | str, guessed: Column | str) -> Column:
    def make(f, own: Column, role: Column, description: Column) -> Column:
        one = lambda k: F.when(F.coalesce(f(k), F.lit("")) != "", F.array(f(k))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            role.alias("role"), own.alias("stack"), short(f("grade"), 50).alias("grade"), f("rate_min").try_cast("int").alias("rate_min"), short(f("currency"), 10).alias("currency"),
            short(f("company"), 255).alias("company"), short(f("client"), 255).alias("client"), short(f("location"), 255).alias("location"), short(f("work_format"), 120).alias("work_format"),
            short(f("employment_type"), 120).alias("employment_type"), one("responsibilities_text").alias("responsibilities"), one("requirements_text").alias("requirements"),
            F.lit(False).alias("is_closed"), description.alias("description"),
        )

    return _item(fields, stack, text, guessed, make)


def experience(low: Column | str, high: Column | str) -> Column:
    """The lower bound; an equal upper bound changes nothing."""
    return _c(low)


def vacancy_status(closed: Column | str) -> Column:
    return F.when(F.coalesce(_c(closed), F.lit(False)), "closed").otherwise("active")


def specialist_status(hired: Column | str) -> Column:
    return F.when(F.coalesce(_c(hired), F.lit(False)), "hired").otherwise("active")


def source_display(**parts: Column) -> Column:
    """``key: value`` parts that are not blank, joined by ``; ``."""
    return F.concat_ws("; ", *[F.when(F.coalesce(strip(v), F.lit("")) != "", F.concat(F.lit(f"{k}: "), strip(v))) for k, v in parts.items()])


def provenance(manager: Column | str, kind: Column | str, message_url: Column | str, external_url: Column | str, locator: Column | str, index: Column | str, sheet: Column | str, table: Column | str) -> Column:
    """Where an entity comes from, in one of four forms: a file (with sheet and table, if any, and the place in it), a post of the archive with the entity's
    number, a message, or the manager alone. The place is the number at the locator's end, else the index, else a dash."""
    who = F.concat(F.lit(LABELS["manager"]), _c(manager))
    given = lambda c: F.coalesce(_c(c), F.lit("")) != ""
    labelled = lambda label, c: F.when(given(c), F.concat(F.lit(LABELS[label]), _c(c)))
    number = _c(index).cast("string")
    at = lambda c: F.concat(F.lit(LABELS["index"]), T.source_index(c, number))
    page = F.nullif(_c(table).cast("int"), F.lit(0)).cast("string")
    file = F.concat_ws("; ", who, labelled("file", external_url), labelled("sheet", sheet), labelled("table", page), at(locator))
    post = F.concat_ws("; ", who, labelled("archive", message_url), at(F.lit(None).cast("string")))
    message = F.concat_ws("; ", who, labelled("message", message_url))
    return F.when(given(external_url), file).when((_c(kind) == "archive_post") & given(message_url), post).otherwise(message)


def source_meta(base: Column | str, **parts: Column) -> Column:
    """The base (map of text) with the parts that are not blank put over it, as JSON with the keys in order."""
    more = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), strip(v).alias("value")) for k, v in parts.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    own = F.filter(F.map_entries(F.coalesce(_c(base), F.create_map().cast("map<string,string>"))), lambda e: ~F.exists(more, lambda m: m["key"] == e["key"]))
    return F.to_json(F.map_from_entries(F.array_sort(F.concat(own, more))))


def parse_source_display(x: Column | str) -> Column:
    """Such a string as a map; a value keeps its own colons."""
    pairs = F.transform(F.filter(F.split(F.coalesce(_c(x), F.lit("")), ";"), lambda p: F.contains(p, F.lit(":"))), lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("key"), strip(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    first = lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, 1, i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(given(pairs, first))
