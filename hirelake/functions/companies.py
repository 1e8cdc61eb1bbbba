"""Company names in sheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import IU, _c, strip
from .text import has

# ---- fixed values ----
ALIASES = {"Сбер": (r"\bсбер\w*\b", r"\bsber(?:bank|business|cib|\w*)?\b"), "Лемана Про": (r"\bлемана\s*про\b", r"\blemana\b")}
FIELD = r"(?imU)(?:компан(?:ия|ии)|заказчик|клиент|customer|client)\s*[:\-]\s*([^\n|,;]{2,120})"
NO_NAMES = ("банки", "финтех", "ритейл", "промышленность", "гос", "россия", "снг", "европа", "нет", "нету")
# ---- end of fixed values ----


def company_name(x: Column | str) -> Column:
    """The canonical name, null for blanks, sectors, places and rates."""
    s = F.regexp_replace(F.regexp_replace(strip(F.coalesce(_c(x), F.lit(""))), r"(?U)\s{2,}", " "), r"^[ .,:;|]+|[ .,:;|]+$", "")
    low = F.lower(s)
    rate = F.contains(low, F.lit("руб/час")) | F.contains(low, F.lit("₽"))
    known = F.when(F.contains(low, F.lit("сбер")) | F.contains(low, F.lit("sber")), "Сбер").when(F.contains(low, F.lit("лемана")), "Лемана Про")
    return F.when(low.isin(*NO_NAMES) | rate, None).otherwise(F.coalesce(known, F.when(F.length(s) >= 2, s)))


def company_candidates(x: Column | str) -> Column:
    """The set of companies of a text: by alias and by labelled field."""
    t = F.coalesce(_c(x), F.lit(""))
    aliases = []
    for name, patterns in ALIASES.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | has(t, p)
        aliases.append(F.when(hit, F.lit(name)))
    fields = F.transform(F.regexp_extract_all(t, F.lit(FIELD), F.lit(1)), company_name)
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*aliases), fields))))


def partner_counts(rows: DataFrame, text: str) -> DataFrame:
    """canonical_name, mentions_count: in how many rows each company is named."""
    return rows.select(F.explode(company_candidates(text)).alias("canonical_name")).groupBy("canonical_name").agg(F.count(F.lit(1)).alias("mentions_count"))


def partner_source_url(x: Column | str) -> Column:
    """The link on a line labelled as a resume, else the first link."""
    t = F.coalesce(_c(x), F.lit(""))
    preferred = F.regexp_extract(t, IU + r"(?m)^[^:\n]*резюме[^:\n]*:\s*(?:.*?)(https?://\S+)", 1)
    return F.coalesce(F.nullif(preferred, F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)https?://\S+", 0), F.lit("")))
