"""Secret scanning through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: what every match must contain. The index maps trigrams of the
lower-cased texts to documents; postings are intersected and united per document, and only the candidates of a rule are scanned with its
expression. Rules without mandatory trigrams (any run of hexadecimal digits) are scanned in full. The index holds the trigrams that the rule set
asks for; ``postings`` takes any other set too.

All on DataFrame expressions. Defined cases: null text is empty; a null id is an id of its own; rows that share an id are scanned each by
itself (their candidates are pooled, the spans are not); extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as k
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: group whose length is tested after matching, and the least length; the match is dropped below it.
    group: int = 0
    least: int = 0


#: Fixed values. assign, access and hex are the base kinds, in the order of their listing; a run's minimum is in its quantifier where
#: that finds the same runs.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")
#: Literal alternatives are followed up to so many strings; beyond, the part counts as unknown.
MOST_STRINGS = 32


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """The query that holds for a text which contains one of the strings."""
    needs = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return _any([_all(sorted(n)) for n in sorted(needs, key=sorted) if not any(m < n for m in needs)])


def _literals(op, arg) -> set[str] | None:
    """All strings that a small piece of an expression can match, lower-cased; None if unknown or too many."""
    if op is k.LITERAL:
        return {chr(arg).lower()}
    if op is k.IN and all(o is k.LITERAL for o, _ in arg):
        return {chr(v).lower() for _, v in arg}
    if op is k.SUBPATTERN:
        return _sequence_literals(arg[3])
    if op is k.BRANCH:
        options = [_sequence_literals(x) for x in arg[1]]
        return None if None in options else set().union(*options)
    if op is k.MAX_REPEAT and arg[:2] == (0, 1) and (inner := _sequence_literals(arg[2])) is not None:
        return inner | {""}
    return None


def _sequence_literals(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        if (more := _literals(op, arg)) is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _query(items):
    """Concatenation: literal stretches give trigrams, what lies between is asked on its own."""
    parts, stretch = [], {""}
    for op, arg in items:
        more = _literals(op, arg)
        if more is not None and len(stretch) * len(more) <= MOST_STRINGS:
            stretch = {a + b for a, b in product(stretch, more)}
            continue
        parts.append(_of_strings(stretch))
        stretch = {""} if more is None else more
        if more is None and op is k.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif more is None and op is k.BRANCH:
            parts.append(_any([_query(x) for x in arg[1]]))
        elif more is None and op is k.MAX_REPEAT and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _all([*parts, _of_strings(stretch)])


def trigram_query(pattern: str):
    """True (no mandatory trigram), a trigram, or ("and" | "or", [queries]); trigrams are lower-cased."""
    return _query(parser.parse(pattern))


def grams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(grams_of, query[1]))


def holds(query, grams: Column) -> Column:
    """The Boolean query over an array of the trigrams found."""
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [holds(q, grams) for q in query[1]]
    return reduce(lambda a, b: a & b, parts) if query[0] == "and" else reduce(lambda a, b: a | b, parts)


def postings(docs: DataFrame, grams: set[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, id): the index entries of the given trigrams over all texts."""
    low = docs.select(F.col(id).alias("_id"), F.lower(text_or_empty(text)).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in sorted(grams)]))
    return low.select("_id", F.explode(found).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(_id, kinds): for each document in the index the rules whose trigram query its postings satisfy."""
    by = index.groupBy("_id").agg(F.collect_set("gram").alias("_g"))  # at most the rules' trigrams
    kinds = F.array_compact(F.array(*[F.when(holds(q, F.col("_g")), F.lit(kind)) for kind, q in queries.items()]))
    return by.select("_id", kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def _matches(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<at, ord, kind, upto>> of a rule in one text, code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.least else found
    none = F.lit(None).cast("array<struct<at:int,ord:int,upto:int>>")
    start = F.struct(F.lit(0).alias("pos"), F.filter(F.coalesce(none, F.array()), lambda x: F.lit(True)).cast("array<struct<at:int,ord:int,upto:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = a["pos"] + x["gap"]
        one = F.array(F.struct(at.alias("at"), F.lit(order).alias("ord"), (at + x["len"]).alias("upto")))
        return F.struct((at + x["len"]).alias("pos"), F.when(x["size"] >= rule.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("len"), sizes.alias("size"))
    return F.aggregate(rows, start, step, lambda a: a["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, spans array<struct<at, ord, upto>> by start, then by the rules' order; one row for each document."""
    return _with_spans(docs.select(id, text), rules, id, text, "spans").select(id, "spans")


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...], id: str, text: str, out: str) -> DataFrame:
    """docs with the spans of all rules as one more column."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not True}
    cid, kinds, rows = fresh(docs, "_cid"), fresh(docs, "_kinds"), docs
    if indexed:
        index = postings(docs, set().union(*map(grams_of, indexed.values())), id, text)
        chosen = cut(candidates(index, indexed)).select(F.col("_id").alias(cid), F.col("_kinds").alias(kinds))
        rows = rows.join(small(chosen), F.col(id).eqNullSafe(F.col(cid)), "left")
    else:
        rows = rows.withColumn(kinds, F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<at:int,ord:int,upto:int>>")
    per = []
    for order, r in enumerate(rules):
        asked = F.array_contains(kinds, r.kind) if r.kind in indexed else F.lit(True)
        t = text_or_empty(text)
        per.append(F.when(asked & F.regexp_like(t, F.lit(r.pattern)), _matches(r, order, t)).otherwise(nothing))
    return rows.select(*docs.columns, F.sort_array(F.concat(*per)).alias(out))


def rendered(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["at"].cast("string"), s["upto"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id") -> DataFrame:
    kinds = [r.kind for r in rules]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["ord"] == kinds.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["ord"].isin([kinds.index(b) for b in BASE]))
    return found.select(id, *[count(b) for b in BASE], F.sha2(rendered(base, kinds), 256).alias("base_sha256"), rendered(F.col("spans"), kinds).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Every document with the spans that scan() finds replaced by ``mask``, overlapping ones by one; other columns unchanged, a null text stays null."""
    name = fresh(docs, "_spans")
    rows = _with_spans(docs, rules, id, text, name)
    t = F.col(text)

    def step(a: Column, s: Column) -> Column:
        piece = F.when(s["at"] >= a["pos"], F.concat(F.substring(t, a["pos"] + 1, s["at"] - a["pos"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(a["pos"], s["upto"]).alias("pos"), F.concat(a["out"], piece).alias("out"))

    done = F.aggregate(name, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.length(t))))
    new = F.when(F.size(name) > 0, done).otherwise(t)
    return rows.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
