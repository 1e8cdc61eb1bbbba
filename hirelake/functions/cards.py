"""What lists show of a specialist and of a match, and the ranking by keywords."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.session import cut, spread

from .matching import _c, given, strip

#: Words up to which a table of them is broadcast.
FEW_WORDS = 200_000

# ---- fixed values ----
STOPWORDS = ("это", "для", "или", "как", "что", "где", "при", "без", "под", "над", "из", "на", "по", "до", "от", "вы", "мы", "they", "with", "from", "that", "this", "your", "have", "has", "the", "and", "опыт", "лет", "год", "года")
PROFILES = (
    ("python", ("python", "питон", "питонист", "django", "fastapi", "flask")), ("java", ("java", "spring", "spring boot", "kotlin")), ("php", ("php", "bitrix", "laravel", "symfony")),
    ("frontend", ("frontend", "front-end", "react", "vue", "angular", "javascript", "typescript")), ("designer", ("designer", "design", "дизайнер", "ux", "ui", "figma", "product design")),
    ("analyst", ("analyst", "analysis", "аналитик", "системный аналитик", "business analyst", "business analysis")),
    ("qa", ("qa", "quality assurance", "тестировщик", "tester", "test automation", "авто qa", "manual qa")), ("devops", ("devops", "sre", "platform engineer", "kubernetes", "terraform", "argo cd", "argocd")),
    ("data", ("data engineer", "data analyst", "data scientist", "etl", "bi", "analyst data", "ml engineer")),
    ("mobile", ("android", "ios", "mobile", "swift", "kotlin developer", "flutter", "react native")), ("product", ("product manager", "project manager", "pm", "delivery manager", "scrum master")),
)
# ---- end of fixed values ----
LEAST, BEST = 35, 10


def _label(x: Column, *labels: str) -> Column:
    """The value of the first of the labels that a line has."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, rf"(?imU)^(?:{w})\s*[:\-]\s*(.+?)\s*$", 1), F.lit("")) for w in labels])


def specialist_card(original: Column | str, display: Column | str, location: Column | str) -> Column:
    """struct(display_name, identity_hint, reference) of a specialist from its text and the provenance string."""
    text = F.coalesce(_c(original), F.lit(""))
    source = F.replace(F.coalesce(_c(display), F.lit("")), F.lit("; "), F.lit("\n"))
    name = F.coalesce(_label(text, "Имя", "Name", "Column 1"), _label(source, "Специалист", "Кандидат", "Имя"))
    place = F.coalesce(_label(text, "Локация", "Location", "Город", "City"), F.nullif(strip(F.coalesce(_c(location), F.lit(""))), F.lit("")))
    sheet = F.coalesce(_label(source, "Лист", "Sheet"), _label(source, "Таблица", "Table"))
    row = F.coalesce(_label(text, "Row"), _label(source, "Строка", "Row"))
    index = _label(source, "Индекс", "Index")
    hint = F.concat_ws(" · ", F.when(name != "—", name), F.when(place != "—", place))
    reference = F.concat_ws(" · ", F.concat(F.lit("Лист: "), sheet), F.coalesce(F.concat(F.lit("Строка: "), row), F.concat(F.lit("Позиция: "), index)))
    return F.struct(name.alias("display_name"), F.nullif(hint, F.lit("")).alias("identity_hint"), F.nullif(reference, F.lit("")).alias("reference"))


def match_explanation(v: str, s: str, own: Column | str) -> Column:
    """array of struct(label, value): common stack (at most five), grade, rate and place of a vacancy and a specialist (structs with stack, grade, rate, location
    of text), and which bench is shown."""
    a, b = (lambda n: F.col(f"{v}.{n}")), (lambda n: F.col(f"{s}.{n}"))
    full = lambda x: F.nullif(strip(x), F.lit(""))
    theirs = F.transform(b("stack"), lambda x: F.struct(F.lower(strip(x)).alias("k"), x.alias("x")))
    match = lambda x: F.get(F.filter(theirs, lambda t: t["k"] == F.lower(strip(x))), F.lit(0))["x"]
    common = F.slice(F.filter(F.transform(a("stack"), match), lambda x: x.isNotNull()), 1, 5)
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    g, h = full(a("grade")), full(b("grade"))
    grade = F.when(F.lower(g) == F.lower(h), F.concat(F.lit("оба "), h)).when(g.isNotNull() & h.isNotNull(), F.concat(F.lit("вакансия "), g, F.lit(", специалист "), h)).otherwise(F.concat(F.lit("указан "), F.coalesce(g, h)))
    two = lambda n: F.concat_ws("; ", F.concat(F.lit("вакансия "), full(a(n))), F.concat(F.lit("специалист "), full(b(n))))
    stack = F.when(F.size(common) > 0, F.concat(F.lit("совпали "), F.array_join(common, ", "))).otherwise("точного пересечения по тегам не найдено")
    first = F.when(_c(own), "сначала проверен наш бенч").otherwise("показан партнерский бенч после проверки нашего")
    rows = F.array(row("Стек", stack), row("Грейд", grade), row("Ставка", F.nullif(two("rate"), F.lit(""))), row("Формат/локация", F.nullif(two("location"), F.lit(""))), row("Приоритет", first))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def plain_text(x: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))


def keywords(x: Column | str) -> Column:
    """The distinct words of more than two characters that are no stop words."""
    return _words_of(plain_text(_c(x)))


def _words_of(plain: Column) -> Column:
    words = F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}+#.]", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def profiles(x: Column | str) -> Column:
    """The role profiles of which a term stands in the text as a whole word or run of words."""
    return _profiles_of(plain_text(_c(x)))


def _profiles_of(plain: Column) -> Column:
    holds = lambda hay, terms: reduce(or_, [F.contains(hay, F.lit(f" {t} ")) for t in terms])
    found = lambda hay: F.array_compact(F.array(*[F.when(holds(hay, terms), F.lit(name)) for name, terms in PROFILES]))
    return given(F.concat(F.lit(" "), plain, F.lit(" ")), found)


def _side(rows: DataFrame, id: str) -> DataFrame:
    """id, words, profiles of the rows (id, text) that have both. A text is made plain once; the empty ones are left out only when all is stored, since a filter
    before would work out words and profiles once more."""
    plain = spread(rows.select(F.col(id).alias("id"), "text")).select("id", plain_text(F.col("text")).alias("_plain"))
    out = cut(plain.select("id", _words_of(F.col("_plain")).alias("words"), F.array_sort(_profiles_of(F.col("_plain"))).alias("profiles")))
    return out.where((F.size("words") > 0) & (F.size("profiles") > 0))


def shared_words(q: DataFrame, t: DataFrame) -> DataFrame:
    """(w, n): the words that both sides have, with their number on the side of t. Counts are combined before the shuffle."""
    count = t.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return cut(count.join(q.select(F.explode("words").alias("w")).distinct(), "w", "left_semi"))


def _keyed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (id, words, profiles) with ``pre``, their words that both sides have, rarest first, ``n``, the number of all, and ``key``, equal for rows alike in these."""
    known = F.broadcast(known) if known.limit(FEW_WORDS + 1).count() <= FEW_WORDS else known
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    words = rows.select("_row", F.explode("words").alias("w")).join(known, "w")
    pre = words.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda s: s["w"]).alias("pre"))
    out = rows.join(pre, "_row").select("id", "pre", "profiles", F.size("words").alias("n"))
    return cut(out.withColumn("key", F.md5(F.to_json(F.struct("pre", "profiles", "n")))))


def keyword_pairs(q: DataFrame, t: DataFrame, least: int) -> DataFrame:
    """(q, t, overlap, score) of the keys that share a profile and score ``least`` or more.

    A set-similarity join with prefix filter: the score asks for an overlap that depends on the sizes of both sides. Two sides that have it share a word among all
    but so many of their most frequent ones. They are joined on these words, and a pair is kept at the rarest that it shares, so it is made once."""
    need = F.ceil((least - 25.5) / (55 / F.col("nq") + 20 / F.col("nt")) - 1e-9).cast("int")
    a = q.select(F.col("key").alias("q"), F.col("n").alias("nq"), F.col("pre").alias("qw"), F.col("profiles").alias("qp"), F.posexplode("pre").alias("i", "w"))
    b = t.select(F.col("key").alias("t"), F.col("n").alias("nt"), F.col("pre").alias("tw"), F.col("profiles").alias("tp"), F.posexplode("pre").alias("j", "w"))
    met = a.join(b, "w").where((F.col("i") <= F.size("qw") - need) & (F.col("j") <= F.size("tw") - need) & F.arrays_overlap("qp", "tp"))
    met = met.withColumn("both", F.array_intersect("qw", "tw")).where(F.get("both", F.lit(0)) == F.col("w"))
    overlap = F.size("both").cast("long")
    score = F.floor(overlap / F.col("nq") * 55 + overlap / F.col("nt") * 20 + 25 + 0.5).cast("int")
    return met.select("q", "t", overlap.alias("overlap"), score.alias("score")).where(F.col("score") >= least)


def keyword_match(queries: DataFrame, targets: DataFrame, best: int = BEST, least: int = LEAST) -> DataFrame:
    """query_id, id, score, overlap, rank: for each query (query_id, text) the best targets (id, text) that share a role profile and keywords with it.

    Words that only one side has count in the sizes alone. What is left makes rows alike: of targets of one key, whose scores are equal for every query, only the
    first ``best`` can be among the best of any, and queries of one key have the same ones. So keys are joined (see keyword_pairs), the best keys of each taken
    apart into targets, and the result joined with the queries. A word that all rows have makes no pairs of rows."""
    from pyspark.sql import Window

    q, t = _side(queries, "query_id"), _side(targets, "id")
    known = shared_words(q, t)
    q, t = _keyed(q, known), _keyed(t, known)
    t = cut(t.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= best))
    one = lambda df: df.groupBy("key").agg(F.first(F.struct("pre", "profiles", "n")).alias("f"), F.min("id").alias("first_id")).select("key", "f.*", "first_id")
    heads = one(t)
    pairs = keyword_pairs(one(q), heads, least).join(heads.select(F.col("key").alias("t"), "first_id"), "t")
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("first_id")))).where(F.col("_n") <= best)
    hits = pairs.select("q", F.col("t").alias("key"), "score", "overlap").join(t.select("key", "id"), "key")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= best)
    return q.select(F.col("id").alias("query_id"), F.col("key").alias("q")).join(ranked, "q").select("query_id", "id", "score", "overlap", "rank")
