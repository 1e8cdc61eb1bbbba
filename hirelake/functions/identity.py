"""Deterministic keys. Stack items with quotes would need another spelling of the list text and are not supported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import _c, strip


def _low(x: Column | str) -> Column:
    return F.lower(strip(F.coalesce(_c(x), F.lit(""))))


def _list_text(stack: Column | str) -> Column:
    items = F.array_sort(F.filter(F.transform(F.coalesce(_c(stack), F.array().cast("array<string>")), lambda s: _low(s)), lambda s: s != ""))
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']")))


def _hex(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def synthetic_id(role: Column | str, stack: Column | str, grade: Column | str, rate: Column | str) -> Column:
    bucket = F.floor(F.coalesce(_c(rate), F.lit(0)) / 10000).cast("string")
    return _hex(F.concat_ws("|", _low(role), _list_text(stack), _low(grade), bucket), 16)


def specialist_identity(resume_url: Column | str, name: Column | str, role: Column | str, location: Column | str, stack: Column | str, grade: Column | str, rate: Column | str, source_urls: Column | str | None = None, rate_max: Column | str | None = None) -> Column:
    """By resume link (else the first source link that is not blank), else by name with role, place and stack, else as synthetic_id by the lower rate
    (a missing or zero one by the upper)."""
    if source_urls is not None:
        resume_url = F.coalesce(F.nullif(strip(F.coalesce(_c(resume_url), F.lit(""))), F.lit("")), F.get(F.filter(_c(source_urls), lambda u: strip(F.coalesce(u, F.lit(""))) != ""), F.lit(0)))
    if rate_max is not None:
        rate = F.coalesce(F.nullif(_c(rate), F.lit(0)), _c(rate_max))
    one = lambda c: F.regexp_replace(_low(c), r"(?U)\s+", " ")
    by_link = _hex(F.concat(F.lit("specialist|resume|"), _low(resume_url)), 16)
    by_name = _hex(F.concat_ws("|", F.lit("specialist|name"), one(name), one(role), one(location), _list_text(stack)), 16)
    return F.when(_low(resume_url) != "", by_link).when(_low(name) != "", by_name).otherwise(synthetic_id(role, stack, grade, rate))


def registry_key(url: Column | str, locator: Column | str) -> Column:
    return _hex(F.concat_ws("|", F.coalesce(_c(url), F.lit("")), F.coalesce(_c(locator), F.lit(""))), 32)


def own_synthetic_id(identity: Column | str) -> Column:
    return _hex(F.concat(F.lit("own_registry|"), _c(identity)), 16)


def number_of(text: Column | str, digits: int = 15) -> Column:
    """The first hex digits of the hash as a number."""
    return F.conv(_hex(_c(text), digits), 16, 10).cast("long")


def source_ids(url: Column | str, locator: Column | str) -> Column:
    """struct(channel_id, message_id) of an external source."""
    return F.struct((-number_of(url)).alias("channel_id"), number_of(F.concat_ws("|", _c(url), _c(locator))).alias("message_id"))
