"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, exact, linededup, neardup, packing, pii, quality, runs, secrets, sharding, substrings, toxicity
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text in a shard of op7: so few that the tables of the checks have buckets that split.
SHARD = 512 << 10


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items that contaminate them; clean documents have no row."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"hirelake surrogates")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(table(spark, sf_dir, "documents"), n=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), limit=SHARD)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.runs(runs.with_periods(table(spark, sf_dir, "documents"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_packing": op4_packing,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_near_dedup": op6_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _secret_sql() -> str:
    """Every rule run over every text; spans from the lengths of the pieces between the matches."""
    parts = []
    for order, r in enumerate(secrets.RULES):
        rx = r.pattern.replace("'", "''")
        long_enough = f"length(regexp_extract_all(text, '{rx}', {r.group})[i]) >= {r.least}" if r.least else "TRUE"
        before = f"CAST(list_sum(list_transform(string_split_regex(text, '{rx}')[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{rx}')[1:i-1], lambda p: length(p))), 0) AS BIGINT)"
        parts.append(f"SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, {before} AS since, {before} + length(regexp_extract_all(text, '{rx}')[i]) AS upto FROM (SELECT doc_id, text, unnest(range(1, len(regexp_extract_all(text, '{rx}')) + 1)) AS i FROM documents WHERE regexp_matches(text, '{rx}')) m WHERE {long_enough}")
    text = "kind || ':' || since || ':' || upto"
    agg = lambda where: f"coalesce(string_agg({text}, ',' ORDER BY since, ord){where}, '')"
    count = lambda k: f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}"
    base = ", ".join(f"'{b}'" for b in secrets.BASE)
    return f"""WITH s(doc_id, ord, kind, since, upto) AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {", ".join(count(b) for b in secrets.BASE)}, sha256({agg(f" FILTER (WHERE kind IN ({base}))")}) AS base_sha256, {agg("")} AS spans
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


#: What SQL says in reasonable length; the other operators are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op7_sharding": f"""WITH a AS (SELECT doc_id, lpad(bin(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15) AS BIGINT)), 60, '0') AS bits, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents),
t AS (SELECT d, left(bits, d) AS p, CAST(sum(n_bytes) AS BIGINT) AS s FROM a, unnest(range(0, 61)) r(d) GROUP BY 1, 2),
f AS (SELECT a.doc_id, a.n_bytes, t.p, t.d, t.s, row_number() OVER (PARTITION BY a.doc_id ORDER BY t.d) AS k FROM a JOIN t ON t.p = left(a.bits, t.d) AND (t.s <= {SHARD} OR t.d = 60))
SELECT doc_id, n_bytes, p AS shard, CAST(d AS INT) AS depth, s AS shard_bytes, s > {SHARD} AS oversize FROM f WHERE k = 1""",
    "op8_secret_scan": _secret_sql(),
    "op9_line_dedup": f"""WITH l AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
 FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) x) y),
k AS (SELECT key, min(doc_id) AS keep FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.keep IS NOT NULL AND k.keep <> l.doc_id AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op13_exact_dedup": r"""WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)""",
}
