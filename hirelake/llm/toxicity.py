"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P, texts without a label the unlabelled set U. With the class prior p (the share of positives, from
the labelled training rows) the risk of a classifier g is estimated as

    p R+(g on P) + max(0, R-(g on U) - p R-(g on P)),

the second part being the risk on negatives, which cannot be negative; where a batch makes it so, its gradient is followed upwards instead. Linear
classifiers with logistic loss are trained so in numpy, several with different batches and parts of P, and their mean logit is used.

Features are the presence of hashed words, lower-cased and without punctuation around, and of their first 4 to 8 bytes (stems, in any language), of
those only which are in ``SHARE`` of the positives and more often there than in U, by ``Z`` standard errors.

The fit takes at most ``POSITIVES`` positives and ``UNLABELLED`` unlabelled texts, those with the least hash of their id (a bounded sample,
whose features go to the driver; of rows that share an id the least text); scoring covers all texts. Neither labels, lang, source nor id are inputs of a score.

The bias is set so that a score of 0.5 is the cutoff of least estimated risk on texts unseen by the classifiers. Defined cases: null or empty texts are scored as
texts without features; without any positive the score is 0 for all; a null label is none; if every text has a label, U are texts of the training folds,
their labels looked away from; repeated rows are scored each; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_or_empty

DIM, STEMS = 1 << 20, (4, 5, 6, 7, 8)
POSITIVES, UNLABELLED = 1_500, 4_500
SHARE, Z, MOST = 0.01, 6.0, 4096
FOLDS = 5
_AROUND = b".,;:!?\"'()[]{}*#$%&|<>~_-"


def features(text: str) -> np.ndarray:
    """The distinct positions below DIM of the text's words and stems."""
    words = {x.strip(_AROUND) for x in text.lower().encode().split()}
    stems = {b"^" + w[:n] for w in words for n in STEMS}
    return np.unique(np.fromiter(map(zlib.crc32, words | stems), np.int64, len(words) + len(stems)) % DIM).astype(np.int32)


def _feature_rows(chosen: np.ndarray | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(0)]
            rows = rows if chosen is None else [r[chosen[r]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["at"])

    return of


def held_out(id: str = "doc_id"):
    return F.crc32(F.col(id).cast("string")) % FOLDS == 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


class Rows:
    """Sets of features laid end to end."""

    def __init__(self, rows: list[np.ndarray], dim: int):
        self.rows, self.dim = rows, dim
        self.at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def __len__(self) -> int:
        return len(self.rows)

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, w[self.at], len(self.rows)) + bias

    def pull(self, g: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.at, g[self.row], self.dim), float(g.sum())

    def take(self, which: np.ndarray) -> Rows:
        return Rows([self.rows[k] for k in which], self.dim)


def fit_one(pos: Rows, unl: Rows, prior: float, seed: int, epochs: int = 30, batch: int = 1024, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Non-negative PU learning with Adam. Each batch holds unlabelled rows and a sample of the positives."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(pos.dim), 0.0
    m, s, mb, sb, t = np.zeros(pos.dim), np.zeros(pos.dim), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(order), batch):
            u = unl.take(order[at : at + batch])
            p = pos.take(rng.choice(len(pos), min(len(pos), batch // 2), replace=False))
            lp, lu = p.logits(w, bias), u.logits(w, bias)
            negative = np.logaddexp(0, lu).mean() - prior * np.logaddexp(0, lp).mean()
            gp, gu = -prior * sigmoid(-lp) / len(p), np.zeros(len(u))  # of p R+
            if negative >= 0:
                gp += -prior * sigmoid(lp) / len(p)
                gu += sigmoid(lu) / len(u)
            else:  # only upwards, against overfitting U
                gp = prior * sigmoid(lp) / len(p)
                gu = -sigmoid(lu) / len(u)
            (gw, gb), (hw, hb) = p.pull(gp), u.pull(gu)
            gw, gb, t = gw + hw + decay * w, gb + hb, t + 1
            m, mb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb
            s, sb = 0.999 * s + 0.001 * gw * gw, 0.999 * sb + 0.001 * gb * gb
            up = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= up * m / (np.sqrt(s) + 1e-8)
            bias -= up * mb / (np.sqrt(sb) + 1e-8)
    return w, bias


def fit(pos: Rows, unl: Rows, prior: float, models: int = 4) -> tuple[np.ndarray, float]:
    """The mean of ``models`` classifiers and the bias that puts the best cutoff at logit 0.

    Each classifier is trained without its part of P and of U. On these, unseen, every cutoff's risk of wrong decisions is estimated as the
    training does it, prior x missed positives + max(0, U above - prior x positives above); the bias is the middle of the cutoffs with the least."""
    ws, bs, high, low = [], [], [], []
    for k in range(models):
        parts = [np.arange(len(x)) % models == k if len(x) >= 3 * models else np.zeros(len(x), bool) for x in (pos, unl)]
        w, b = fit_one(*[x.take(np.flatnonzero(~y)) for x, y in zip((pos, unl), parts)], prior, k)
        ws.append(w)
        bs.append(b)
        for x, y, to in zip((pos, unl), parts, (high, low)):
            to.append((x.take(np.flatnonzero(y)) if y.any() else x).logits(w, b))
    p, u = np.sort(np.concatenate(high)), np.sort(np.concatenate(low))
    cutoffs = np.unique(np.concatenate([p, u]))
    middle = np.concatenate([cutoffs[:1] - 1, (cutoffs[1:] + cutoffs[:-1]) / 2])
    above = lambda x: 1 - np.searchsorted(x, middle, "right") / len(x)
    risk = prior * (1 - above(p)) + np.maximum(0, above(u) - prior * above(p))
    best = middle[risk <= risk.min() + 1e-9]
    return np.mean(ws, 0), float(np.mean(bs) - (best.min() + best.max()) / 2)


def select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """The features that mark positives: at most MOST, by the standard errors between their shares in both sets."""
    p, u = (np.bincount(np.concatenate([*x, np.empty(0, np.int32)]), minlength=DIM) / max(1, len(x)) for x in (pos, unl))
    mean = (p * len(pos) + u * len(unl)) / (len(pos) + len(unl))
    z = (p - u) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / len(pos) + 1 / len(unl)))
    z[p * len(pos) < max(3, SHARE * len(pos))] = 0
    best = np.argsort(-z, kind="stable")[:MOST]
    return np.sort(best[z[best] >= Z])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """A weight for each of DIM positions and a bias, from the training folds' labels and from unlabelled texts; None without positives."""
    known = cut(labels.where(F.col(id).isNotNull() & ~held_out(id)).groupBy(id).agg(F.max(label).alias("_y")))
    n, p = known.agg(F.count("_y"), F.sum("_y")).first()
    if not p:
        return None
    order = F.xxhash64(F.col(id), F.lit("fit"))
    any_label = labels.where(F.col(label).isNotNull() & ~held_out(id)).select(id).distinct()
    ids = docs.select(id).where(F.col(id).isNotNull() & ~held_out(id))  # unlabelled texts, too, are of the training folds only
    without = cut(ids.join(any_label, id, "left_anti").distinct().orderBy(order, id).limit(unlabelled))
    if not without.limit(1).count():
        without = ids.distinct().orderBy(order, id).limit(unlabelled)
    chosen = (known.where("_y = 1").select(id).orderBy(order, id).limit(positives), without)
    rows, mark = [], None
    for ids in chosen:
        ids = small(cut(ids.withColumnRenamed(id, "_chosen")))
        texts = docs.select(F.col(id), text_or_empty(text).alias("t")).join(ids, F.col(id) == F.col("_chosen"), "left_semi").groupBy(id).agg(F.min("t").alias("t")).select("t")
        got = texts.mapInArrow(_feature_rows(mark), "at binary").collect()  # one for each chosen id
        rows.append([np.frombuffer(r.at, np.int32) for r in got])
        if mark is None:  # of U only what the positives have often enough is asked for
            seen = np.bincount(np.concatenate([*rows[0], np.empty(0, np.int32)]), minlength=DIM)
            mark = seen >= max(3, SHARE * len(rows[0]))
    if not rows[0] or not rows[1]:
        return None
    chosen_at = select(*rows)
    place = np.full(DIM, -1, np.int64)
    place[chosen_at] = np.arange(len(chosen_at))
    sets = [Rows([q[q >= 0] for q in (place[r] for r in x)], max(1, len(chosen_at))) for x in rows]
    w, bias = fit(*sets, p / n)
    full = np.zeros(DIM, np.float32)
    full[chosen_at] = w[: len(chosen_at)]
    return full, bias


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", **options: int) -> DataFrame:
    """id, held_out, score, predicted for each row."""
    model = train(docs, labels, id, text, label, **options)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(held_out(id), F.lit(False)).alias("held_out"), text_or_empty(text).alias("t"))
    if model is None:
        done = rows.select("id", "held_out", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, bias = shared.value
            for b in batches:
                logits = np.array([float(w[features(t.as_py())].sum()) + bias for t in b.column(2)], np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sigmoid(logits), pa.float64())], ["id", "held_out", "score"])

        done = rows.mapInArrow(score, f"id {dict(docs.dtypes)[id]}, held_out boolean, score double")
    return done.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
