"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents of the training fold
are unlabelled text, toxic or not.  With ``p`` the share of toxic documents, a linear
classifier over the presence of hashed words minimises

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

where the second part is the risk on clean text; when a batch drives it below zero, the
step goes against that part alone, so the classifier cannot fit the unlabelled toxic
documents as clean ones by heart.  Scores depend on the text only.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, small

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
MAX_POSITIVES, MAX_UNLABELLED = 20_000, 40_000  # the bounds of the training sample


class _Buckets(dict):
    """Word -> its feature, by hash."""

    def __missing__(self, word):
        n = zlib.crc32(word.encode()) % BUCKETS
        if len(self) < 200_000:
            self[word] = n
        return n


def features(text: str, buckets: dict) -> np.ndarray:
    """The different features of a text."""
    words = set(WORD.findall(text.lower()))
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, len(words)))


def _share(column, n: int, bound: int):
    """True for about ``bound`` of ``n`` rows, by a hash."""
    return F.shiftrightunsigned(column, 32) < int(min(1.0, bound / max(1, n)) * (1 << 32))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable,
                    max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, seed: int = 11):
    """``(sample, prior)``: ``sample(positive, features)`` of at most about the two bounds, and the share of label 1.

    ``usable`` maps an id column to whether its row may be learnt from.  The share is
    counted over all usable labels; labels that are null or lack an id are left out.
    None if no document is labelled toxic.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(usable(F.col("id")) & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    total, positive = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not positive:
        return None
    chosen = known.filter((F.col("label") == 1) & _share(F.xxhash64("id", F.lit(seed)), positive, max_positives)).select("id")
    rows = picked(docs, id_col, text_col).filter(usable(F.col("id")))
    n = docs.count()
    # ids of confirmed documents: at most about max_positives
    marked = rows.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "id", "left")
    taken = marked.filter(F.col("positive") | _share(F.xxhash64("id", "text", F.lit(seed)), n, max_unlabelled))

    def job(batches):
        buckets = _Buckets()
        for b in small(batches):
            found = [features(t, buckets) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["positive", "features"])

    sample = taken.select("text", F.coalesce("positive", F.lit(False)).alias("positive")).mapInArrow(
        job, "positive boolean, features array<int>")
    return sample, positive / total


def _csr(rows: list[np.ndarray]):
    size = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([*rows, np.zeros(0, np.int32)]), size


def screen(positives: list[np.ndarray], unlabelled: list[np.ndarray], keep: int, min_docs: int, least: float) -> np.ndarray:
    """At most ``keep`` features whose share of documents differs most, by ``least`` standard errors or more, between the sets."""
    empty = np.zeros(0, np.int32)
    a = np.bincount(np.concatenate([*positives, empty]), minlength=BUCKETS)
    b = np.bincount(np.concatenate([*unlabelled, empty]), minlength=BUCKETS)
    n, m = max(1, len(positives)), max(1, len(unlabelled))
    share = (a + b + 1) / (n + m + 2)
    z = np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    z[a + b < min_docs] = -1
    best = np.argsort(-z, kind="stable")[:keep]
    return best[z[best] >= least]


def fit_nnpu(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, batch: int = 1024,
             rate: float = 0.05, decay: float = 0.002, keep: int = 2000, min_docs: int = 5, least: float = 4.0, seed: int = 3) -> np.ndarray:
    """Weights of the features, and the bias last: logistic loss, Adam steps, on the features that ``screen`` keeps."""
    rng = np.random.default_rng(seed)
    kept = np.zeros(BUCKETS, bool)
    kept[screen(positives, unlabelled, keep, min_docs, least)] = True
    positives, unlabelled = [[r[kept[r]] for r in rows] for rows in (positives, unlabelled)]
    w = np.zeros(BUCKETS + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    (pi, pn), steps, t = _csr(positives), max(1, -(-len(unlabelled) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for part in np.array_split(order, steps):
            ui, un = _csr([unlabelled[i] for i in part])
            gp = np.bincount(np.repeat(np.arange(len(pn)), pn), w[pi], len(pn)) + w[-1]
            gu = np.bincount(np.repeat(np.arange(len(un)), un), w[ui], len(un)) + w[-1]
            sp, su = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
            clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if clean >= 0:  # gradients of the losses by the scores
                dp, du = prior * (sp - 1 - sp) / len(sp), su / len(su)
            else:
                dp, du = prior * sp / len(sp), -su / len(su)
            grad = np.bincount(pi, np.repeat(dp, pn), BUCKETS + 1) + np.bincount(ui, np.repeat(du, un), BUCKETS + 1)
            grad[:-1] += decay * prior * w[:-1]
            grad[-1] = dp.sum() + du.sum()
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8))
    return w


def train(sample: DataFrame, prior: float, **options) -> np.ndarray | None:
    """Fit in one task: the sample is bounded.  The weights (2 MB) come to the driver; None if no toxic document is in the sample."""
    def job(batches):
        rows = ([], [])
        for b in batches:
            for positive, f in zip(b.column(0).to_pylist(), b.column(1)):
                rows[0 if positive else 1].append(f.values.to_numpy(zero_copy_only=False).astype(np.int32))
        if rows[0]:
            w = fit_nnpu(rows[0], rows[1], prior, **options)
            yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float64).tobytes()]})

    # a total order, so that the fit doesn't depend on how the rows arrive
    ordered = sample.repartition(1).sortWithinPartitions("positive", F.xxhash64("features"), F.size("features"))
    got = ordered.mapInArrow(job, "w binary").first()
    return None if got is None else np.frombuffer(got["w"], np.float64)


def scorer(weights: np.ndarray):
    """A column function: the score, 0 to 1, of a text column (null or empty: the bias alone)."""
    weights = weights.astype(np.float32)
    held = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        buckets = held.setdefault("b", _Buckets())
        total = np.array([float(weights[features(t.as_py(), buckets)].sum(dtype=np.float64)) if t.is_valid else 0.0 for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(total + weights[-1], -50, 50))), pa.float64())
    return score


def held_out(id_column):
    """Every fifth row by the CRC-32 of its id as text (a null id: not held out)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options):
    """Train on the rows that are not held out and return the scorer.

    Without any usable label nothing can be learnt: every text then scores 0.
    """
    found = training_sample(docs, labels, id_col, text_col, label_col, lambda c: c.isNotNull() & ~held_out(c))
    weights = None if found is None else train(*found, **options)
    return scorer(weights) if weights is not None else lambda text: F.lit(0.0)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", **options) -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``; repeated rows are scored alike, an empty table gives none."""
    score = classifier(docs, labels, id_col, text_col, label_col, **options)
    rows = picked(docs, id_col, text_col)
    out = rows.select("id", held_out(F.col("id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole of ``documents``, learnt from ``labels.toxic`` outside the held-out fold."""
    read = spark.read.parquet
    out = score_documents(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL = {}
