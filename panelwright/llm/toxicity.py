"""Toxicity by classifier chains.

Categories are predicted one after another by linear models over the presence of words and
word beginnings; a category's model also gets the probabilities of those before it. For
training these are out-of-fold predictions, so that later models see earlier ones as they
are on unseen rows. They also give each category its threshold, the one with the best F1
on unseen rows. The chain is fitted on at most MAX_TRAIN labelled rows, chosen by their
id's hash, with a task for each fold; every document is scored where it is.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: Labelled rows the chain is fitted on, at most; features of a model; folds.
MAX_TRAIN = 12_000
FEATURES = 2_000
FOLDS = 5
#: Lengths of word beginnings, and rows a feature must be in.
STARTS = (4, 5)
LEAST_ROWS = 3
STEPS = 250
RIDGE = 1e-4
#: A feature in a smaller share of rows than this counts as in so many.
RAREST = 0.002
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    out = [zlib.crc32(word.encode())]
    return out + [zlib.crc32(f"{word[:k]}-".encode()) for k in STARTS if len(word) > k]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Linear:
    """Ridge logistic regression on the features that tell the classes apart best, and on earlier probabilities."""

    def __init__(self, owner: np.ndarray, feature: np.ndarray, rows: int, earlier: np.ndarray, y: np.ndarray):
        """owner and feature: a pair for each feature of each row; earlier: rows by categories before."""
        names, at = np.unique(feature, return_inverse=True)
        seen = np.bincount(at, minlength=len(names))
        hits = np.bincount(at, weights=y[owner], minlength=len(names))
        rate = y.mean()
        z = np.abs(hits - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
        z[seen < LEAST_ROWS] = 0
        best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
        best = best[z[best] > 2]
        place = np.full(len(names), -1)
        place[best] = np.arange(len(best))
        self.names = names[best]
        owner, column = owner[place[at] >= 0], place[at][place[at] >= 0]
        self.weights, self.earlier, self.bias = np.zeros(len(best)), np.zeros(earlier.shape[1]), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        # a rare feature counts for more, as it has few rows to learn from
        self.worth = 1 / np.sqrt(np.maximum(seen[best] / rows, RAREST))
        worth = self.worth[column]
        # accelerated gradient steps; the step fits the rows' size
        size = np.bincount(owner, weights=worth**2, minlength=rows)
        step = 4.0 / (1 + (size.mean() if rows else 0.0))
        was = [np.zeros(len(best)), np.zeros(earlier.shape[1]), 0.0]
        for _ in range(STEPS):
            p = self._p(np.bincount(owner, weights=self.weights[column] * worth, minlength=rows), earlier)
            off = (p - y) / rows
            grads = [np.bincount(column, weights=off[owner] * worth, minlength=len(best)) + RIDGE * self.weights, earlier.T @ off, off.sum()]
            was = [0.9 * w - step * g for w, g in zip(was, grads, strict=True)]
            self.weights, self.earlier, self.bias = self.weights + was[0], self.earlier + was[1], self.bias + was[2]

    def _p(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums + earlier @ self.earlier + self.bias, -30, 30)))

    def predict(self, owner: np.ndarray, feature: np.ndarray, rows: int, earlier: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, feature)
        hit = (at < len(self.names)) & (self.names[np.minimum(at, max(len(self.names) - 1, 0))] == feature) if len(self.names) else np.zeros(len(feature), bool)
        return self._p(np.bincount(owner[hit], weights=(self.weights * self.worth)[at[hit]], minlength=rows), earlier)


def _part(owner: np.ndarray, feature: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the chosen rows, which are numbered anew."""
    new = np.cumsum(chosen) - 1
    keep = chosen[owner]
    return new[owner[keep]], feature[keep]


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold in hundredths with the best F1, the middle of those that do equally well."""
    limits = np.arange(5, 96) / 100
    hits = np.array([(p[y == 1] >= t).sum() for t in limits])
    scores = 2 * hits / np.array([max(1, (p >= t).sum() + (y == 1).sum()) for t in limits])
    best = limits[scores >= scores.max() - 1e-12]
    return float(best[len(best) // 2])


def fit_chain(spark: SparkSession, owner: np.ndarray, feature: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[Linear | None]:
    """One model for each column of y (0, 1 or nan, which leaves a row out), in order; None without labels of both kinds.

    A category's folds, and its fit on all rows, are tasks; the rows reach them as a
    broadcast, which MAX_TRAIN bounds.
    """
    rows, earlier, models = len(y), np.zeros((len(y), 0)), []
    sample = spark.sparkContext.broadcast((owner, feature, y, fold))
    for c in range(y.shape[1]):
        known = ~np.isnan(y[:, c])
        if {0.0, 1.0} != set(y[known, c]):
            models.append(None)
            continue
        before = spark.sparkContext.broadcast(earlier)

        def fit_one(batches, c=c, before=before):
            owner, feature, y, fold = sample.value
            known, earlier = ~np.isnan(y[:, c]), before.value
            for batch in batches:
                for f in batch.column(0).to_pylist():
                    train, rest = known & (fold != f), fold == f
                    if not train.any() or (f < FOLDS and not rest.any()):
                        continue
                    model = Linear(*_part(owner, feature, train), int(train.sum()), earlier[train], y[train, c])
                    p = model.predict(*_part(owner, feature, rest), int(rest.sum()), earlier[rest]) if f < FOLDS else np.empty(0)
                    done = (f, model if f == FOLDS else None, p)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(done)], pa.binary())], names=["done"])

        out = np.full(rows, y[known, c].mean())
        fits = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit_one, "done binary").collect()  # a fold's probabilities, or a model
        for f, model, p in (pickle.loads(r[0]) for r in fits):
            if f == FOLDS:
                models.append(model)
            else:
                out[fold == f] = p
        models[-1].limit = best_limit(out[known], y[known, c])
        earlier = np.column_stack([earlier, out])
    return models


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, F.Column], id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, Linear | None]]:
    """The chain for categories (name -> 0/1 column of labels), in their order.

    A null label leaves its row out of that category; a category without labels of both
    kinds has no model. Of labels that repeat an id, the least stays in each category, and of
    documents that do, the one whose text has the least hash. So MAX_TRAIN rows at most come
    to the driver, as feature hashes.
    """
    prepare(docs.sparkSession)
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("fit"))
    picked = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), order.alias("k"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    picked = picked.groupBy("__id").agg(F.min("k").alias("k"), *[F.min(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    total = picked.count()
    if total > MAX_TRAIN:  # a share by hash first, so that the sort that follows is small
        picked = picked.where(F.pmod("k", F.lit(1 << 20)) < int((1 << 20) * 1.2 * MAX_TRAIN / total)).orderBy("k").limit(MAX_TRAIN)
    own = docs.select(F.col(id_col).alias("__own"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(picked), F.col("__own") == F.col("__id"))
    kept = [F.first("k").alias("k"), *[F.first(f"y{i}").alias(f"y{i}") for i in range(len(categories))]]
    rows = rows.groupBy("__id").agg(*kept, F.min_by("text", F.xxhash64("text")).alias("text")).drop("__id")

    def count(batches):
        for batch in batches:
            found = [np.unique(np.array([f for w in words(t) for f in features(w)], dtype="<u4")).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "features"])

    schema = "k long, " + ", ".join(f"y{i} double" for i in range(len(categories))) + ", features binary"
    sample = sorted((tuple(r) for r in rows.mapInArrow(count, schema).collect()), key=lambda r: (r[0], r[-1]))
    names = list(categories)
    if not sample:
        return [(n, None) for n in names]
    feature = np.concatenate([np.frombuffer(r[-1], "<u4") for r in sample])
    owner = np.repeat(np.arange(len(sample)), [len(r[-1]) // 4 for r in sample])
    # features of fewer rows than a model takes are left out before the rows are sent to the tasks
    seen = np.unique(feature, return_inverse=True, return_counts=True)
    often = seen[2][seen[1]] >= LEAST_ROWS
    owner, feature = owner[often].astype(np.int32), feature[often]
    y = np.array([[np.nan if v is None else v for v in r[1:-1]] for r in sample])
    fold = np.array([(r[0] >> 24) % FOLDS for r in sample])
    return list(zip(names, fit_chain(docs.sparkSession, owner, feature, y, fold), strict=True))


def score(docs: DataFrame, chain: list[tuple[str, Linear | None]], id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """Per row of docs: id, and for each category p_<category> and <category> (p at or above the threshold, by default the model's own).

    A category without a model has a null p and is never predicted. A null or empty text has no words and gets what the models' constants give. Texts are
    read whole; repeated rows and null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    model = spark.sparkContext.broadcast(chain)
    memo: dict[str, tuple[int, ...]] = {}

    def judge(batches):
        chain = model.value
        used = {int(f) for _, m in chain if m for f in m.names}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, feature = [], []
            for k, text in enumerate(texts):
                found = set()
                for w in words(text):
                    own = memo.get(w)
                    if own is None:
                        own = tuple(f for f in features(w) if f in used)
                        if len(memo) < MEMO_WORDS:
                            memo[w] = own
                    if own:
                        found.update(own)
                owner += [k] * len(found)
                feature += found
            owner, feature = np.array(owner, dtype=np.int64), np.array(feature, dtype=np.uint32)
            earlier, out = np.zeros((len(texts), 0)), []
            for _, m in chain:
                if m is None:
                    out += [pa.nulls(len(texts), pa.float64()), pa.array(np.zeros(len(texts), bool))]
                    continue
                p = m.predict(owner, feature, len(texts), earlier)
                earlier = np.column_stack([earlier, p])
                out += [pa.array(p), pa.array(p >= (m.limit if threshold is None else threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[id_col, *[x for n, _ in chain for x in (f"p_{n}", n)]])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"`{id_col}` {kind}", *[f"p_{n} double, {n} boolean" for n, _ in chain]])
    return rows.mapInArrow(judge, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities and verdicts for low_quality, then toxic, by a chain fitted on labels."""
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score(docs, chain)
