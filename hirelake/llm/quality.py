"""Quality rules whose cutoffs are certified on labelled rows by exact binomial tests (risk-controlled thresholds).

Each rule rejects a document whose measure exceeds a cutoff. For each stratum and rule, every cutoff of a fixed grid is tested on
the labelled rows: with n good rows of which k are rejected, the cutoff is certified if P(Bin(n, a) <= k) <= d, which is to say that the
exact (Clopper-Pearson) upper bound of its false rejection rate at confidence 1 - d is at most a. a is ``risk`` divided by the number of rules,
so all rules of a stratum together reject at most ``risk`` of its good rows that pass the base test (what that test rejects is not
certified); d is ``error`` divided by strata x rules x grid (Bonferroni), so
all certificates hold at once. Among the certified cutoffs the one with the best ``bad - penalty * good`` rejections is used, if that is positive.

Everything here is DataFrame expressions. Defined cases: a null text counts as empty (no words, so it fails the base test); a null stratum is
a stratum of its own; a stratum without certified cutoffs rejects nothing beyond the base test; repeated labels of a document count as their
minimum; labels without a document or a null id are ignored; repeated documents are each measured; input columns besides id, text and
stratum are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\f\r"
#: rule -> candidate cutoffs; the measure is named as the rule.
GRID = {
    "symbol_share": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "repeat_share": (0.1, 0.2, 0.25, 0.3, 0.35, 0.4),
    "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "mean_word": (6.5, 7.0, 7.5, 8.0, 9.0, 10.0),
}


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    base = docs.select(id, *keep, text_or_empty(text).alias("_t")).select(
        id, *keep, "_t",
        F.filter(F.split("_t", SPACE + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_l"),
    )
    base = base.select(
        id, *keep, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    counts = [id, *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    w = F.col("_w")
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    base = base.select(*counts, windows.alias("_g"))
    # only texts with some repeated window pay for the sort that finds which
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    base = base.select(*counts, F.when(repeated, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).alias("_s"))
    s = F.col("_s")
    twins = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    base = base.select(*counts, F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull()))).alias("_p"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2)))))
    base = base.select(*counts, F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def shares(m: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return m.withColumns({
        "symbol_share": per("n_symbols", "word_chars"), "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "mean_word": per("word_chars", "n_words"),
    })


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - reduce(lambda a, b: a + b, [F.log(x + float(k)) for k in range(8)])


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding for k <= n p; 0 beyond, where no cutoff is certified anyway."""
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, 12 * F.ceil(F.sqrt(n)) + 40).cast("int")  # terms beyond are below e^-280 of the first
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda a: a["sum"])
    return F.when(k <= n * p, top + F.log(series)).otherwise(F.lit(0.0))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, id: str = "doc_id", risk: float = 0.04, error: float = 0.05, penalty: float = 5.0) -> DataFrame:
    """stratum, cutoffs map<rule, cutoff>, from all labelled rows; a row for each stratum with a certified, useful cutoff."""
    truth = labels.where(F.col(id).isNotNull()).groupBy(F.col(id)).agg(F.min("quality").alias("_q"))
    rows = shares(measured.where(~F.col("base_failed"))).join(truth, id)
    good, bad = F.col("_q") == 1, F.col("_q") == 0
    over = {(r, c): F.col(r) > c for r, cs in GRID.items() for c in cs}
    sums = [F.count_if(good & x).alias(f"g_{r}_{j}") for j, ((r, _), x) in enumerate(over.items())]
    sums += [F.count_if(bad & x).alias(f"b_{r}_{j}") for j, ((r, _), x) in enumerate(over.items())]
    by = rows.groupBy(stratum).agg(F.count_if(good).alias("n"), *sums)
    cases = [F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"g_{r}_{j}").alias("k"), F.col(f"b_{r}_{j}").alias("bad")) for j, (r, c) in enumerate(over)]
    by = cut(by.select(stratum, "n", F.explode(F.array(*cases)).alias("x")).select(stratum, "n", "x.*"))
    tests = by.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("tests"))  # one row
    tail = log_binomial_tail(F.col("n"), F.col("k"), risk / len(GRID))
    gain = F.col("bad") - penalty * F.col("k")
    certified = by.crossJoin(F.broadcast(tests)).where((F.col("n") > 0) & (gain > 0)).where(tail <= F.log(F.lit(error) / F.col("tests")))
    best = certified.groupBy(stratum, "rule").agg(F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    return best.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # one entry for each rule at most


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The measures of each document with ``kept``: false if base_failed or if a certified cutoff of its stratum is exceeded."""
    m = cut(measures(docs, id, text, keep=(stratum,)))
    limits = small(cut(thresholds(m, labels, stratum, id, **options).withColumnRenamed(stratum, "_stratum")), 100_000)
    rows = shares(m).join(limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    fails = [F.coalesce(F.col(r) > F.col("cutoffs")[r], F.lit(False)) for r in GRID]
    return rows.withColumn("kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, fails)).drop("_stratum", "cutoffs")


def filter_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """The documents that judge() keeps, columns unchanged. Copies of an id are kept together if any of its texts is kept."""
    name = fresh(docs, "_kept_id")
    kept = cut(judge(docs, labels, stratum, id, text, **options).where("kept").select(F.col(id).alias(name)).distinct())
    return docs.join(small(kept), F.col(id).eqNullSafe(F.col(name)), "left_semi")
