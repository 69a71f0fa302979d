"""Toxicity by a chain of linear classifiers.

Categories are learned one after the other: each logistic model sees a
document's hashed words, their first letters and the probabilities of the categories before it.
For training those probabilities come from models that have not seen the row
(out of fold), so a later model meets them as it will in use. Models are
fitted on a bounded sample of labelled rows; scoring is one narrow pass. Words
are chosen by each model's own rows, so a fold's labels do not reach the model
that judges it.

Defined results: null and empty texts have no words and get the models'
base rates; texts are read whole; repeated rows give repeated results and count
once in fitting (of several marks or texts of one id the least); ids are taken
in the order of their hash, ties by id; without
labels of both kinds a category's probability is its share (0 if unlabelled);
an empty table gives an empty table; other columns do not enter.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .wordhash import WordHasher

FIT_ROWS = 8_000   # labelled rows that the models are fitted on, at most
STEMS = (4, 5, 6, 7)  # first bytes of a word that are features too
FOLDS = 3
ROUNDS = 120
L2 = 2e-4
MIN_ROWS = 4        # a word must be in so many of the rows to count ...
MIN_CHI2 = 15.0     # ... and go with the category, or against it, so clearly


@dataclass
class Model:
    ids: np.ndarray     # 64-bit hashes of the words that tell, sorted
    words: np.ndarray   # their weights
    before: np.ndarray  # weight of each earlier category's probability
    bias: float


def _word_ids(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[np.ndarray]:
    texts = [t.encode("utf-8", "replace") if t else b"" for t in batch.column("text").to_pylist()]
    for h, _, _ in hasher.many(texts):
        yield np.unique(h).view(np.int64)


def _hasher() -> WordHasher:
    hasher = WordHasher(True, alphanumeric=True)
    hasher.stems = STEMS
    return hasher


def _word_sums(ids: np.ndarray, weights: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Per text, the sum of its words' weights."""
    if not len(ids):
        return np.zeros(len(words))
    out = []
    for w in words:
        at = np.minimum(np.searchsorted(ids, w), len(ids) - 1)
        out.append(weights[at[ids[at] == w]].sum())
    return np.array(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(row: np.ndarray, col: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by full-batch Adam; classes weigh alike in part."""
    k = earlier.shape[1]
    share = y.mean() if n else 0.0
    if n == 0 or share in (0.0, 1.0):
        return Model(np.empty(0, np.int64), np.empty(0), np.zeros(k), float(np.log((share * n + 0.01) / ((1 - share) * n + 0.01 + 1e-9))))
    used, local = np.unique(col, return_inverse=True)
    held, both = np.bincount(local), np.bincount(local, weights=y[row])
    tells = (held >= MIN_ROWS) & ((both - held * share) ** 2 >= MIN_CHI2 * held * share * (1 - share))
    row, used, local = row[tells[local]], used[tells], (np.cumsum(tells) - 1)[local[tells[local]]]
    weight = np.where(y > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    weight = weight / weight.sum()
    size = len(used)
    w = np.zeros(size + k + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[local], minlength=n) + earlier @ w[size:size + k] + w[-1]
        error = (_sigmoid(z) - y) * weight
        grad = np.concatenate((np.bincount(local, weights=error[row], minlength=size), earlier.T @ error, [error.sum()]))
        grad[:-1] += L2 * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Model(used, w[:size], w[size:size + k], float(w[-1]))


def sample_marks(marks: DataFrame, categories: list[str], limit: int = FIT_ROWS) -> DataFrame:
    """``id`` and categories of the labelled ids of least hash, at most ``limit``.

    Only ids and marks are read. A bound on the hash, from the number of rows,
    keeps what one task sorts near the limit, whatever the size of the table.
    """
    narrow = (marks.select("id", *[F.col(c).cast("double").alias(c) for c in categories])
              .filter(" AND ".join(f"{c} IS NOT NULL" for c in ("id", *categories)))
              .withColumn("_at", F.shiftrightunsigned(F.xxhash64("id"), 1)))
    n, share = narrow.count(), 1.0
    while n > 4 * limit:
        share = 2.0 * limit / n if share == 1.0 else min(1.0, 2 * share)
        near = narrow.filter(F.col("_at") < F.lit(int(share * (1 << 63)) - 1))
        if share == 1.0 or near.select("id").distinct().limit(limit).count() == limit:
            narrow = near
            break
    one = narrow.groupBy("id", "_at").agg(*[F.min(c).alias(c) for c in categories])
    return one.orderBy("_at", "id").limit(limit).drop("_at")


def fit_chain(docs: DataFrame, marks: DataFrame, categories: list[str], limit: int = FIT_ROWS) -> list[Model]:
    """One model per category, from ``id, text`` and ``id`` with 0/1 columns. At
    most ``limit`` labelled ids are chosen first; the words of their texts are
    hashed where they are scanned."""
    sample = sample_marks(marks, categories, limit)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "w": pa.array(list(_word_ids(batch, hasher)), pa.list_(pa.int64())),
                **{c: batch.column(c) for c in categories}})

    # at most ``limit`` narrow rows are broadcast
    texts = docs.select("id", "text").join(F.broadcast(stage(sample, "marks")), "id")
    hashed = texts.mapInArrow(words, "id bigint, w array<bigint>, " + ", ".join(f"{c} double" for c in categories))
    hashed = stage(hashed.groupBy("id").agg(F.min("w").alias("w"), *[F.min(c).alias(c) for c in categories])
                   .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")), "sample")
    # words that tell something about some category in the rows of some model are found in the
    # cluster; only they reach the driver, where each model judges them by its own rows again
    inside = [F.lit(True)] + [F.col("fold") != f for f in range(FOLDS)]
    sums = [F.sum(F.when(rows, F.lit(1.0)).otherwise(0.0)).alias(f"n{k}") for k, rows in enumerate(inside)] + [
        F.sum(F.when(rows, F.col(c)).otherwise(0.0)).alias(f"y{k}_{c}") for k, rows in enumerate(inside) for c in categories]
    total = hashed.agg(*sums).first().asDict()
    held = hashed.select(F.explode("w").alias("g"), "fold", *categories).groupBy("g").agg(*sums)
    tells = []
    for k in range(len(inside)):
        for c in categories:
            share = (total[f"y{k}_{c}"] or 0.0) / max(total[f"n{k}"] or 0.0, 1.0)
            tells.append(f"(n{k} >= {MIN_ROWS} AND pow(y{k}_{c} - n{k} * {share!r}D, 2) >= "
                         f"{MIN_CHI2}D * n{k} * {share * (1 - share)!r}D)")
    told = held.filter(" OR ".join(tells)).select("g").toPandas()["g"].to_numpy(np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(told))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(np.array(w, np.int64), shipped.value) for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "w": pa.array(kept, pa.list_(pa.int64())),
                                              **{c: batch.column(c) for c in categories}, "fold": batch.column("fold")})

    rows = hashed.mapInArrow(telling, hashed.schema).toPandas().sort_values("id", ignore_index=True)
    lists, n = rows["w"].tolist(), len(rows)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    col = np.concatenate([np.asarray(x, np.int64) for x in lists]) if n else np.empty(0, np.int64)
    fold, earlier, models = rows["fold"].to_numpy(), np.empty((n, 0)), []
    for c in categories:
        y = rows[c].to_numpy(float)
        models.append(fit_linear(row, col, n, earlier, y))
        if c != categories[-1]:
            unseen = np.zeros(n)
            for f in range(FOLDS):
                inside_f = fold != f
                at = np.cumsum(inside_f) - 1
                keep = inside_f[row]
                part = fit_linear(at[row[keep]], col[keep], int(inside_f.sum()), earlier[inside_f], y[inside_f])
                sums_f = _word_sums(part.ids, part.words, [np.asarray(x, np.int64) for x in lists])
                unseen[~inside_f] = _sigmoid(sums_f + earlier @ part.before + part.bias)[~inside_f]
            earlier = np.column_stack((earlier, unseen))
    return models


def score(docs: DataFrame, models: list[Model], categories: list[str]) -> DataFrame:
    """``id`` and ``p_<category>`` of every row of ``id, text``."""
    # plain arrays: a broadcast is unpickled without this package
    shipped = docs.sparkSession.sparkContext.broadcast([(m.ids, m.words, m.before, m.bias) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            words = list(_word_ids(batch, hasher))
            earlier = np.empty((len(words), 0))
            for ids, weights, before, bias in shipped.value:
                sums = _word_sums(ids, weights, words)
                earlier = np.column_stack((earlier, _sigmoid(sums + earlier @ before + bias)))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), **{f"p_{c}": pa.array(earlier[:, i]) for i, c in enumerate(categories)}})

    return docs.select("id", "text").mapInArrow(
        run, "id bigint, " + ", ".join(f"p_{c} double" for c in categories))


def toxicity_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, p_low_quality, p_toxic, toxic`` of every document; the chain
    goes from low quality to toxic."""
    chain = ["low_quality", "toxic"]
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    marks = labels.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("low_quality"), "toxic")
    models = fit_chain(rows, marks, chain)
    return score(rows, models, chain).withColumn("toxic", F.col("p_toxic") >= threshold).withColumnRenamed("id", "doc_id")
