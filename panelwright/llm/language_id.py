"""Language ID by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte 2- and 3-grams (letters lower-cased,
ASCII characters other than letters as one space). Each language has several centroids,
found by spherical k-means; the language of the nearest one by cosine is predicted. A text
is rejected if it is much further from its centroid than nearly all texts of its language
are from centroids that were found without them. The cosine of a short text is smaller, in
proportion to the root of its grams, and so is its bound. The model is fitted on at most MAX_PER_LANG labelled texts a language, chosen by their id's
hash; predictions are made where the rows are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, stage, table

DIMENSIONS = 8192
CENTROIDS = 4
ROUNDS = 12
#: Share of a language's rows that a centroid must be the nearest of.
LEAST_CLUSTER = 0.03
#: Labelled texts of a language that the model is fitted on, at most.
MAX_PER_LANG = 600
#: A text is rejected below this share of the similarity that all but REJECT_QUANTILE of its
#: language's training texts have to centroids of the FOLDS that they are not in.
REJECT_SHARE = 0.7
REJECT_QUANTILE = 0.02
FOLDS = 5
#: Distinct grams from which on a text's length doesn't matter for its bound.
FULL_GRAMS = 64

_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of a text's bytes."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", dtype=np.uint8)
    gap = raw == 32
    raw = raw[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint32)
    two = (raw[:-1] << np.uint32(8)) | raw[1:]
    three = (two[:-1] << np.uint32(8)) | raw[2:]
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(19)
    return np.bincount(np.concatenate([spread(two), spread(three ^ np.uint32(0x5BD1E995))]), minlength=DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit rows, without those that very few rows are near.

    A seed is a row further from the seeds before than nine in ten are, not the furthest:
    that may be mislabelled, and a centroid of its own would make its language known here.
    """
    seeds = [int(np.argmax(rows @ rows.mean(axis=0)))]
    near = rows @ rows[seeds[0]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argsort(near, kind="stable")[len(rows) // 10]))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    found = rows[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ found.T, axis=1)
        means = np.stack([rows[own == c].mean(axis=0) if (own == c).any() else found[c] for c in range(len(found))])
        found = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    sizes = np.bincount(np.argmax(rows @ found.T, axis=1), minlength=len(found))
    return found[sizes >= min(sizes.max(), LEAST_CLUSTER * len(rows))]


def length_factor(counts: np.ndarray) -> np.ndarray:
    """What a text's bound is multiplied by: the root of its distinct grams' share of FULL_GRAMS, 1 at most."""
    return np.sqrt(np.minimum(1.0, (counts > 0).sum(axis=-1) / FULL_GRAMS))


def unseen_similarity(rows: np.ndarray) -> np.ndarray:
    """Each unit row's similarity to the nearest centroid of the folds that it is not in; a single row's to itself."""
    if len(rows) < 2:
        return np.ones(len(rows))
    fold, out = np.arange(len(rows)) % FOLDS, np.empty(len(rows))
    for k in range(min(FOLDS, len(rows))):
        out[fold == k] = (rows[fold == k] @ spherical_kmeans(rows[fold != k], CENTROIDS).T).max(axis=1)
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model from labelled rows: idf, centroids, their languages and rejection bounds.

    Rows with a null language, null text or no letter are left out. A language's fit, on
    MAX_PER_LANG rows at most, is a task; the driver gets its centroids alone.
    """
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    if not sizes:
        return {"langs": []}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.2 * MAX_PER_LANG / n))])
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("fit"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("k"))
    rows = rows.where(F.pmod("k", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k", F.xxhash64("text")))).where(F.col("n") <= MAX_PER_LANG)

    def count(batches):
        for batch in batches:
            found = [gram_counts(t) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i4").tobytes() for c, a in zip(found, at, strict=True)], pa.binary())],
                names=["lang", "at", "counts"],
            )

    sample = stage(rows.select("lang", "text").mapInArrow(count, "lang string, at binary, counts binary"), "language-sample")

    def documents(batches):
        """How many of a task's texts have each gram: a row a task."""
        n, found = 0, np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            n += len(batch)
            for at in batch.column(0).to_pylist():
                found[np.frombuffer(at, "<i4")] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([found.tobytes()], pa.binary())], names=["n", "found"])

    parts = sample.select("at").mapInArrow(documents, "n long, found binary").collect()
    n, seen = sum(r.n for r in parts), sum((np.frombuffer(r.found, np.int64) for r in parts), np.zeros(DIMENSIONS, dtype=np.int64))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def one_language(group: pa.Table) -> pa.Table:
        """A language's centroids and how far from them its texts may be; MAX_PER_LANG rows at most."""
        mine = sorted(zip(group["at"].to_pylist(), group["counts"].to_pylist(), strict=True))
        counts = np.zeros((len(mine), DIMENSIONS), dtype=np.float32)
        for row, (at, times) in zip(counts, mine, strict=True):
            row[np.frombuffer(at, "<i4")] = np.frombuffer(times, "<i4")
        own = vectors(counts, idf)
        found = spherical_kmeans(own, CENTROIDS)
        least = np.quantile(unseen_similarity(own) / length_factor(counts), REJECT_QUANTILE)
        return pa.table({"lang": group["lang"][:1], "centroids": pa.array([found.astype("<f4").tobytes()], pa.binary()), "bound": pa.array([float(least) * REJECT_SHARE])})

    fitted = sample.groupBy("lang").applyInArrow(one_language, "lang string, centroids binary, bound double").collect()  # CENTROIDS vectors a language
    langs, centroids, bounds = [], [], []
    for lang, found, bound in sorted(tuple(r) for r in fitted):
        found = np.frombuffer(found, "<f4").reshape(-1, DIMENSIONS)
        langs += [lang] * len(found)
        centroids.append(found)
        bounds += [bound] * len(found)
    if not langs:
        return {"langs": []}
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids), "bounds": np.array(bounds)}


def judge(texts: list[str | None], m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its nearest centroid (-1 for none), their cosine, and whether it is rejected."""
    near, score, rejected = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    known = [k for k, t in enumerate(texts) if m["langs"] and t and any(map(str.isalpha, t))]
    if known:
        counts = np.stack([gram_counts(texts[k]) for k in known])
        cos = vectors(counts, m["idf"]) @ m["centroids"].T
        best = cos.argmax(axis=1)
        near[known], score[known] = best, np.clip(cos[np.arange(len(known)), best], 0, 1)
        rejected[known] = score[known] < m["bounds"][best] * length_factor(counts)
    return near, score, rejected


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, lang_pred, score (cosine, 0 to 1), rejected.

    A text that is null, empty or has no letter gets `und`, 0 and is rejected; so does
    every text if no language was learned. Other texts get a learned language even if
    rejected; of equally near centroids the first language in order is taken. Texts are
    read whole; repeated rows and null ids are kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    model = spark.sparkContext.broadcast(model)

    def guess(batches):
        m = model.value
        for batch in batches:
            near, score, rejected = judge(batch.column(1).to_pylist(), m)
            langs = [m["langs"][b] if b >= 0 else "und" for b in near.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(guess, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that the registered query doesn't learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep_known(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without the rows that predict rejects, all columns as they were; a row is judged by its own text."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        return pd.Series(~judge(texts.tolist(), model.value)[2])

    return docs.where(known(F.col(text_col).cast("string")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the rows that aren't held out: held_out, lang_pred, score, rejected."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
