"""Periodic runs, tokenizer alignment and exact dedup against brute force, with the cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import alignment, exact, runs
from hirelake.llm.queries import tokenizer_path
from tests.llm.test_operators import CLASH, EDGE, make, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edge(spark):
    return make(spark, EDGE, CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


# ---- 11 periodic runs ----


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i = i if i > start else i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repetitive(rng):
    w = []
    for _ in range(rng.randrange(0, 7)):
        if rng.random() < 0.6:
            w += ([f"r{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(1, 7))] * 40)[: rng.randrange(1, 60)]
        else:
            w += [f"r{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(20))]
    return " \n".join(w)


def test_runs_match_brute_force(spark, edge, none):
    rng = random.Random(11)
    texts = [repetitive(rng) for _ in range(150)] + ["a " * 3000, "a b " * 500 + "c", words(rng, 900, 3), "", None, "x y x y x y x y", "a a a a a", "a a a a a a"]
    got = {r.doc_id: r for r in runs.runs(make(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = plain_runs(w)
        assert [tuple(x) for x in got[k].runs] == want and got[k].collapsed == collapsed(w, want) and got[k].n_words == len(w)
    rows = runs.digest(runs.runs(edge)).collect()
    assert len(rows) == len(EDGE) and runs.digest(runs.runs(none)).count() == 0
    longest = next(r for r in rows if r.length == 3000)
    assert (longest.n_runs, longest.start, longest.period, longest.exponent_milli) == (1, 0, 1, 3_000_000)
    assert all(r.start is None and r.exponent_milli is None for r in rows if not r.n_runs)


def test_other_lengths(spark):
    rng = random.Random(5)
    for least, times in ((3, 3), (10, 5)):
        w = [f"{rng.randrange(2)}" for _ in range(120)]
        want = {}
        for q in range(1, 60):
            i = 0
            while i + q < len(w):
                s = i
                while i + q < len(w) and w[i] == w[i + q]:
                    i += 1
                if i > s and i + q - s >= max(least, times * q):
                    want.setdefault((s, i + q), q)
                i = i if i > s else i + 1
        codes = np.array([int(x) for x in w])
        assert sorted(map(tuple, runs.find_runs(codes, np.zeros(len(w), np.int64), least, times).tolist())) == sorted((s, e, q) for (s, e), q in want.items())
    with pytest.raises(ValueError):
        runs.runs(make(spark, ["a"]), times=2)


def test_every_run_comes_from_one_last_square():
    codes = np.array([0, 1] * 10 + [2])
    ranks = runs.prefix_ranks(codes)
    sa = np.argsort(ranks[-1])
    lcp = runs.common_prefixes(ranks, sa)
    suffixes = [codes[i:].tolist() for i in sa]
    assert suffixes == sorted(suffixes)
    assert [0] + [next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x, y in zip(suffixes, suffixes[1:])] == lcp.tolist()
    start, period = runs.last_squares(sa, ranks[-1], runs.small_children(lcp, 10))
    assert sorted(zip(period.tolist(), start.tolist())) == [(2, 16), (4, 12), (6, 8), (8, 4), (10, 0)]


def test_planted_periods(spark):
    rng = random.Random(2)
    texts = [(k, words(rng, rng.randrange(0, 300), 50)) for k in range(-60, 120)] + [(None, "a b c"), (20, None)]
    for r, t in zip(sorted(runs.with_periods(make(spark, texts)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text)), sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))):
        w, h = WORD.findall(t[1] or ""), zlib.crc32(str(t[0]).encode())
        if t[0] is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.text.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        else:
            assert r.text == (t[1] or "")


# ---- 12 tokenizer alignment ----

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_alignment(texts):
    """By ends of tokens, text by text, with whole-text encoding."""
    known = alignment.tokens(*PATHS)
    out = []
    for t in texts:
        a = known.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = known.b.encode(t) if t else []
        x, y = [known.a_bytes[i].as_py() for i in a], [known.b_bytes[i].as_py() for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            out.append(([], "", 0, 0))
            continue
        spans = []
        for z in (x, y):
            end = np.cumsum([len(v) for v in z]).tolist()
            spans.append(list(zip([0, *end], end)))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, since = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, (s, f) in zip(ids, sp) if since <= s < e) for ids, sp in zip((a, b), spans)))
            since = e
        out.append((links, ";".join(groups), len(a), len(b)))
    return out


TOKENIZED = [
    "Hello, world! The naïve café", "  two  spaces\n\nand lines\t", "<|endoftext|> and <s> stay <0x41> text", "don't 12345 日本語 🙂🙂 é", "has ▁ inside", "", None, "   ", "a", "\x00\x1c odd", "Same text", "Same text",
    "übermäßig lange Wörter " * 40, "x" * 700, "日本" * 300,
]


def test_alignment_matches_brute_force(spark):
    rng = random.Random(12)
    pool = ["word", "Straße", "don't", "...", "\n", " ", "123", "ñandú", "🙂", "http://a.b/c?d=e", "the", "of"]
    texts = TOKENIZED + [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(60)]
    plain = plain_alignment(texts)
    docs = Counter(p for links, *_ in plain for p in set(links))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    for slice_rows in (2_000_000, 100):  # one slice, several slices
        got = {r.doc_id: r for r in alignment.scored(make(spark, texts), *PATHS, slice_rows=slice_rows).collect()}
        for k, (links, groups, n_a, n_b) in enumerate(plain):
            r = got[k]
            assert (r.n_a, r.n_b, r.n_links, r.n_groups) == (n_a, n_b, len(links), len(groups.split(";")) if groups else 0)
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            assert r.count_sum == sum(docs[p] for p in links) and r.n_best == sum(docs[p] == most[p[0]] for p in links)
    written = {r.doc_id: r.groups for r in alignment.align(make(spark, texts), *PATHS).collect()}
    assert [written[k] for k in range(len(texts))] == [g for _, g, *_ in plain]


def test_lanes_and_lockstep_give_one_merge():
    rng = random.Random(4)
    for lane in (1, 2, 5, 1000):
        docs = []
        for _ in range(20):
            n = rng.randrange(0, 80)
            docs.append([sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(n + 1)))}) if n else [] for _ in range(2)])
        base = np.cumsum([0] + [d[0][-1] if d[0] else 0 for d in docs])
        a, b = ([np.array(d[k], np.int64) + base[n] for n, d in enumerate(docs)] for k in (0, 1))
        a_from, b_from = (np.cumsum([0] + [len(x) for x in z]) for z in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        x, x_to, y, _ = alignment.lanes(a, b, a_from, b_from, lane)
        left, right, together = alignment.lockstep(a, b, x, x_to, y)
        a_start, b_start = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if a_start[i] < b[j] and b_start[j] < a[i]}
        assert len(left) == len(want) and set(zip(left.tolist(), right.tolist())) == want
        assert set(a[left[together]].tolist()) == set(a.tolist()) & set(b.tolist())
        assert lane > 1 or len(x) > 20


def test_alignment_edges(spark, edge, none):
    rows = alignment.scored(edge, *PATHS).collect()
    assert len(rows) == len(EDGE) and sum(r.doc_id == 7 for r in rows) >= 2
    assert alignment.scored(none, *PATHS).count() == 0
    assert all(r.groups_sha256 == "" and r.count_sum == 0 for r in rows if not r.n_a)


# ---- 13 exact dedup ----


def plain_dedup(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for key, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(key.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_matches_brute_force(spark, edge, none, monkeypatch):
    rng = random.Random(13)
    base = [words(rng, rng.randrange(1, 6), 12) for _ in range(400)]
    texts = [(k, rng.choice((t, t.replace(" ", "\n\t"), t + " ", t.replace(" ", "")))) for k, t in enumerate(base)]
    texts += [(1000 + k, "one hot text ") for k in range(300)] + [(None, "one hot text"), (None, "one hot text  "), (None, "one hot text  "), (5000, None), (5001, ""), (5002, " \n")]
    df = make(spark, texts, CLASH)
    monkeypatch.setattr(exact, "HEAVY", 50)
    for most in (exact.BROADCAST_ROWS, 20):
        got = exact.report(df, most=most).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_dedup(texts)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)
        left = exact.keep_longest(df, most=most)
        assert left.columns == df.columns
        assert sorted(str((r.doc_id, len(r.text or ""))) for r in left.collect()) == sorted(str((t[0], len(t[1] or ""))) for t in {g.text_sha256: next(x for x in texts if x[0] == g.doc_id and hashlib.sha256(re.sub(r"\s", "", x[1] or "").encode()).hexdigest() == g.text_sha256 and len(x[1] or "") == max(len(y[1] or "") for y in texts if y[0] == g.doc_id and re.sub(r"\s", "", y[1] or "") == re.sub(r"\s", "", x[1] or ""))) for g in got if g.kept}.values())
    assert exact.report(edge).count() == len(EDGE) and exact.report(none).count() == 0 and exact.keep_longest(none).count() == 0


def test_few_unique_rows_are_taken_for_repeats(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    n = 1 + 20_000 // exact.PER_WORD
    marked = rows.select(exact._word(F.col("d"), n).alias("word"), exact._bits(F.col("d")).alias("bits"))
    found = exact.repeated_bits(marked, n)
    share = marked.join(found, "word").where("twice & bits = bits").count() / 20_000
    assert share < 0.03
    twice = marked.unionByName(marked)  # no repeat is missed
    assert twice.join(exact.repeated_bits(twice, n), "word").where("twice & bits = bits").count() == 40_000


def test_nothing_but_expressions(spark):
    plan = exact.report(make(spark, ["a", "a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 3 names and numbers of more forms; 2 the risk's gradient ----

PLANTED = [
    "Mr. O'Brien", "Mr van der Berg", "M. Dupont", "Signor Rossi", "Name: John Smith", "Dr. Anne-Marie D’Arcy", "Frau von der Leyen", "ФИО: Иван Петров", "Nombre: Ana de la Cruz", "Señora García", "Mrs Smith-Jones",
    "030 1234567", "0221/9876543", "415.555.2671", "(212) 555-0100", "+1 415 555 2671", "a.b@mail.example.com", "10.20.30.40",
]


def test_planted_names_and_numbers_are_replaced(spark):
    from hirelake.llm import pii

    texts = [f"Please ask {p}, who was here. The rest of this sentence stays." for p in PLANTED]
    out = [r.text for r in pii.anonymize(make(spark, texts), b"key").orderBy("doc_id").collect()]
    left = [p for p, t in zip(PLANTED, out) if any(len(w) > 3 and w in t for w in re.findall(r"[^\W_]+(?:[’'][^\W_]+)?", p) if w.lower() not in ("name", "nombre", "frau", "señora", "signor", "mail", "example") and (w[0].isupper() or w[0].isdigit()))]
    assert len(left) <= len(PLANTED) / 10, left
    assert all(t.startswith("Please ask ") and t.endswith(", who was here. The rest of this sentence stays.") for t in out)
    clean = ["The Name of it: nothing", "Mr Smith's dog met Mr Smith", "version 1.2.3.4567 of 2024", "M street, de la nada", "0 1234567 rows"]
    got = [r.text for r in pii.anonymize(make(spark, clean), b"key").orderBy("doc_id").collect()]
    assert got[0] == clean[0] and got[2:] == clean[2:]
    first, second = re.match(r"Mr (\w+)'s dog met Mr (\w+)", got[1]).groups()
    assert first == second != "Smith"


def test_repeated_ids_drop_no_row_of_the_fit(spark):
    from hirelake.llm import toxicity

    texts = [(k, f"awful bad word{k % 7}" if k % 2 else f"nice good word{k % 7}") for k in range(600) for _ in range(3)]
    labels = spark.createDataFrame([(k, 1) for k in range(1, 500, 2)], "doc_id long, toxic int")
    rows = toxicity.scores(make(spark, texts), labels, positives=60, unlabelled=120).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id % 2, []).append(r.score)
    assert len(rows) == 1800 and min(by[1]) > max(by[0])
