"""Role profiles: how well a text fits each profile of a catalog given as a table (profile, kind, term); kind: alias, term or stack_alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import term_frequency

#: kind -> weight of a term that one profile has alone, and of a shared one.
WEIGHTS = {"alias": (7.0, 2.0), "term": (4.0, 1.5), "stack_alias": (3.0, 1.0)}


def catalog_text(x: Column) -> Column:
    t = F.lower(F.coalesce(x, F.lit("")))
    for word, by in (("&nbsp;", " "), ("amp;", ""), ("c#", " csharp "), (".net", " dotnet "), ("c++", " cpp ")):
        t = F.replace(t, F.lit(word), F.lit(by))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9а-яё+#./ -]+", " "), r"\s+", " "))


def weighted_terms(catalog: DataFrame) -> DataFrame:
    """The catalog's terms with their weights; terms of the stack count over both of its lists."""
    rows = catalog.select("profile", "kind", F.explode(F.split(F.regexp_replace("terms", "[/+]", ";"), "[;,]")).alias("t")).select("profile", "kind", catalog_text(F.col("t")).alias("term")).where("term <> ''")
    group = F.when(F.col("kind") == "alias", "role").otherwise("stack")
    n = term_frequency(rows.select(group.alias("kind"), "profile", "term")).select(F.col("kind").alias("g"), F.col("term").alias("u"), "n")
    alone = F.create_map(*[F.lit(v) for k, (a, _) in WEIGHTS.items() for v in (k, a)])
    shared = F.create_map(*[F.lit(v) for k, (_, b) in WEIGHTS.items() for v in (k, b)])
    return rows.join(n, (group == F.col("g")) & (F.col("term") == F.col("u"))).select("profile", "kind", "term", F.when(F.col("n") == 1, alone[F.col("kind")]).otherwise(shared[F.col("kind")]).alias("weight"))


def profile_scores(texts: DataFrame, catalog: DataFrame, id: str, text: str) -> DataFrame:
    """id, profile, score, matched: from the words and word runs of each text by an equi-join with the terms (a small table of the catalog's size)."""
    terms = weighted_terms(catalog)
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = texts.select(id, F.split(catalog_text(F.col(text)), " ").alias("_w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0))), lambda i: F.array_join(F.slice("_w", i + 1, n), " "))))
    found = words.select(id, F.explode(F.array_distinct(runs)).alias("term")).join(F.broadcast(terms) if terms.limit(100_001).count() <= 100_000 else terms, "term")
    return found.groupBy(id, "profile").agg(F.round(F.sum("weight"), 3).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))


def primary_profile(scores: DataFrame, id: str) -> DataFrame:
    """id, catalog_profile: the best profile with at least 4 points and 2 more than the next."""
    w = Window.partitionBy(id).orderBy(F.desc("score"), F.asc("profile"))
    top = scores.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_n = 1")
    return top.where((F.col("score") >= 4) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= 2))).select(id, F.col("profile").alias("catalog_profile"))
