"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled web text train a small network by the non-negative
unbiased risk  pi R+(g) + max(0, Ru-(g) - pi R+-(g))  of Kiryo et al. (2017). No label but the positives is used. The class prior pi is
estimated from positives and unlabelled texts alone, by best bins (Garg et al., 2021): a first network tells one half of the positives
from one half of the unlabelled; on the other halves, over all cuts of its score, the share of unlabelled texts above the
cut divided by that of positives is never below pi but for chance, and closest to it at the cut of the least upper
confidence bound. Both halves take both parts and the mean counts.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither
their labels nor their texts are used. Training uses at most ``most_positive`` and ``most_unlabelled`` documents,
those of smallest seeded hash (so the sample is the same on a rerun; of an id's several texts the smallest); scores are for every row and
come from the whole text alone: label, language, source and id are no inputs.

Null texts count as empty and are scored like any other text; rows with null ids are scored but never learned
from; repeated rows get the same score; texts of any length are read in pieces. Without any positive label the score is 1 - exp(-words) / 2 for every
row, that is, all are kept. An empty table gives an empty one. Other columns play no part in ``score_documents`` and pass
unchanged in ``with_scores``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, map_batches, prepare

THRESHOLD = 0.3
STOP = frozenset("the of and to in a is that it was for on are as with be by at this have from or had not but what all were de la le les et des en un une du dans est que qui pour pas sur au aux par plus der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es el los las y del se con su para al lo como más".split())
_CLASSES = 16


def _class_table() -> np.ndarray:
    """Code point -> character class."""
    t = np.full(65536, 1, dtype=np.uint8)  # other letters and signs
    for cp in range(65536):
        c = chr(cp)
        if c.isupper():
            t[cp] = 2
        elif c.isalpha():
            t[cp] = 0 if cp < 128 else 3
        elif c.isdigit():
            t[cp] = 4
        elif c in " \t":
            t[cp] = 5
        elif c in "\n\r":
            t[cp] = 6
        elif cp < 32 or 127 <= cp < 160 or cp == 0xFFFD:
            t[cp] = 15
    for i, chars in enumerate((".", ",;:", "!?", "|", "#$%&*@^~+=", "<>{}[]\\/", "\"'()-_"), 7):
        for c in chars:
            t[ord(c)] = i
    return t


_TABLE: list[np.ndarray] = []


def class_counts(text: str, piece: int = 1 << 18) -> np.ndarray:
    """How many of a text's code points are in each class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    out = np.zeros(_CLASSES, dtype=np.int64)
    for at in range(0, len(text), piece):
        points = np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out += np.bincount(_TABLE[0][np.minimum(points, 65535)], minlength=_CLASSES)
    return out


def features(texts: list[str]) -> np.ndarray:
    """One row of features for each text; all are ratios or logarithms, so length itself weighs little."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.array([class_counts(t) for t in texts], dtype=np.int64).reshape(-1, _CLASSES)
    share = counts / np.maximum(lengths, 1)[:, None]
    rest = np.zeros((len(texts), 12))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            continue
        distinct = len(set(words))
        repeat = sum(a == b for a, b in zip(words, words[1:]))
        lines = t.split("\n")
        low = t.lower().split() if n < 4000 else [w.lower() for w in words]
        rest[i] = (
            np.log1p(n) / 10,
            distinct / n,
            np.log1p(n / distinct),
            repeat / n,
            min(lengths[i] / n, 40) / 10,
            sum(map(str.isalpha, words)) / n,
            sum(map(str.isupper, words)) / n,
            sum(w in STOP for w in low) / n,
            np.log1p(len(lines)) / 10,
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 5,
            n < 5,
        )
    return np.hstack((share, np.minimum(np.sqrt(share) * 2, 2), rest))


class Model:
    """Standardised features, one hidden layer, a logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, *, hidden: int = 24, steps: int = 700, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative PU risk with the logistic loss by Adam on the full sample; without a prior, tell the two samples apart."""
    both = np.vstack((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    par = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = par
        hp, hu = np.tanh(p @ w1 + b1), np.tanh(u @ w1 + b1)
        gp, gu = hp @ w2 + b2[0], hu @ w2 + b2[0]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        if prior is None:
            dp, du = (sp - 1) / len(p), su / len(u)
        elif np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() >= 0:  # d/dg of log(1+e^-g) is s-1, of log(1+e^g) is s
            dp, du = prior * ((sp - 1) - sp) / len(p), su / len(u)
        else:  # step back up the negative part alone
            dp, du = prior * sp / len(p), -su / len(u)
        grads = []
        for x, h, d in ((p, hp, dp), (u, hu, du)):
            inner = d[:, None] * w2 * (1 - h * h)
            grads.append([x.T @ inner, inner.sum(0), h.T @ d, np.array([d.sum()])])
        lr = rate * (1 - step / steps) + 1e-4
        for i, (a, b) in enumerate(zip(*grads)):
            g = a + b + decay * par[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            par[i] = par[i] - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, chance: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, by best bins on two halves."""
    found = []
    for i in range(2):
        model = fit(positive[i::2], unlabelled[i::2], None, steps=300)
        p, u = np.sort(model.score(positive[1 - i :: 2])), np.sort(model.score(unlabelled[1 - i :: 2]))
        if not len(p) or not len(u):
            continue
        cuts = np.unique(p)
        above_p = (len(p) - np.searchsorted(p, cuts)) / len(p)
        above_u = (len(u) - np.searchsorted(u, cuts)) / len(u)
        slack = np.sqrt(np.log(4 / chance) / (2 * len(p))) + np.sqrt(np.log(4 / chance) / (2 * len(u)))
        at = int(np.argmin((above_u + (1 + gamma) * slack) / above_p))
        found.append(above_u[at] / above_p[at])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", most_positive: int = 8000, most_unlabelled: int = 16000) -> Model | None:
    """None without positives. At most most_positive + most_unlabelled rows of features reach the driver."""
    spark = prepare(docs.sparkSession)
    known = labels.where("quality = 1").select(F.col(key).cast("long").alias("k")).where(F.col("k").isNotNull() & ~held_out(F.col("k")))
    seeded = F.xxhash64("k", F.lit(11))
    ids = docs.select(F.col(key).cast("long").alias("k")).where(F.col("k").isNotNull() & ~held_out(F.col("k")))
    good = known.distinct().orderBy(seeded, "k").limit(most_positive)
    some = ids.distinct().orderBy(seeded, "k").limit(most_unlabelled)
    wanted = {}
    for kind, rows in ((1, good.collect()), (0, some.collect())):  # at most the two bounds
        for r in rows:
            wanted[r["k"]] = wanted.get(r["k"], 0) | (1 << kind)
    if not any(kind & 2 for kind in wanted.values()):
        return None
    # from Arrow: a list of rows would go through Python workers of a kind of their own, which then stay on the executors
    chosen = spark.createDataFrame(pa.table({"k": pa.array(wanted.keys(), pa.int64()), "kind": pa.array(wanted.values(), pa.int32())}))
    src = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "k")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("t").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("kind"), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "kind", "x"])

    rows = map_batches(src.groupBy("k", "kind").agg(F.min("t").alias("t")), run, "k long, kind int, x binary").orderBy("k").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]) if rows else np.zeros((0, 1))
    kind = np.array([r["kind"] for r in rows], dtype=int)
    positive, unlabelled = x[kind & 2 > 0], x[kind & 1 > 0]
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def with_scores(docs: DataFrame, model: Model | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column, double in 0..1; all other columns pass unchanged."""
    prepare(docs.sparkSession)
    (own,) = fresh(docs.columns, "scored_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        import pandas as pd

        it = shared.value
        for s in texts:
            made = []
            for at in range(0, len(s), 256):
                part = [t or "" for t in s[at : at + 256]]
                made.append(it.score(features(part)) if it else np.array([1 - np.exp(-len(t.split())) / 2 for t in part]))
            yield pd.Series(np.round(np.concatenate(made), 9) if made else np.empty(0))

    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col(text)))


def score_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """key, held_out, score and predicted (score >= threshold) for each row of ``docs``."""
    model = train(docs, labels, key=key, text=text, **bounds)
    out = with_scores(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), model, text="t", name="score")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
