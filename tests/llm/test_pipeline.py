"""corpus_pipeline.run on small tables against plain versions of its stages."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_operators import CLASH, plain_components, plain_line_dedup, plain_tiling, words


def plain_quality(rows, labels):
    """Texts pass with 50 words and few repeats; no cutoff is certified by the few labels of these tests."""
    kept = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(marked) <= 50 * len(w):
            kept.append(i)
    return [r for r in rows if r[0] in kept]


def plain_stages(rows, items):
    rows = plain_line_dedup(plain_quality(rows, None))
    comp = plain_components([r for r in rows if r[0] is not None], 5, 80)
    rows = [r for r in rows if r[0] is None or comp[r[0]] == r[0]]
    clean = []
    for i, t in rows:
        w = re.findall(r"\w+", t.lower())
        bad = False
        for x in items:
            p = re.findall(r"\w+", (x or "").lower())
            bad |= len(p) >= 5 and sum(n for _, _, n in plain_tiling(p, w, 5)) >= 0.6 * len(p)
        if not bad:
            clean.append((i, t))
    return clean


def tables(spark, path, rows, items):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[None] * 12) for i, t in rows], CLASH)
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:20] if i is not None] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_the_pipeline_matches_plain_stages(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rng = random.Random(21)
    items = [words(rng, 30, 10**6), words(rng, 25, 10**6), None, "tiny"]
    shared = "This line stands in many documents"
    rows = []
    for k in range(40):
        t = "\n".join(words(rng, 20, 10**6) for _ in range(4))
        if k % 4 == 0:
            t += "\n" + shared
        if k % 5 == 1:
            t = rows[-1][1].replace("w1", "w2", 1)  # near copies
        if k % 9 == 2:
            t += "\n" + items[k % 2].upper()
        if k % 11 == 3:
            t = "again and again " * 30
        rows.append((k, t))
    rows += [(100, None), (101, ""), (102, "short"), (None, words(rng, 60, 10**6)), (103, rows[0][1]), (104, "x" * 20_000)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, items)).collect()
    expected = plain_stages(rows, items)
    assert 10 < len(expected) < 40
    whole = Tokenizer.from_file(path)
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == {i for i, _ in expected}
    for i, t in expected:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0
