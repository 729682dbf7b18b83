"""Hard-negative mining by angular triangle filtering.

Each row is stored with its norm and its angles to a few reference directions. The angle
between two rows is at least the difference of their angles to any reference, and at most
their sum (or what that leaves of a full turn). So the references give an interval of
cosines, and times the norms an interval of scores, widened by what rounding can do. Only
rows whose interval reaches the window that is asked for are scored, with integers.

Anchors are a stated part of the rows, so there are more of them in a larger table: they
come in blocks of bounded size, and each block meets all rows in one scan for its positives
and one for its negatives. A task keeps the best few for each question and passes on these
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_path, prepare, stage, table

#: References, and the rows (by a hash of their ids) that they are picked from.
REFERENCES, SAMPLE_ROWS = 16, 2_048
#: Anchors of a block, and bytes of its vectors.
BLOCK_ROWS, BLOCK_BYTES = 1_024, 32 << 20
#: Rows that meet a block at a time.
STEP_ROWS = 2_048
#: What rounding may do to a score of norm 1.
SCORE_SLACK = 1e-9
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
LONG = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def to_integers(vectors: list[list[float] | None]) -> list[np.ndarray]:
    """floor(SCALE * x) of each component; beyond what a double holds exactly, as Python's integers."""
    out = []
    for v in vectors:
        scaled = np.floor(np.array(v, dtype=np.float64) * SCALE)
        exact = not len(scaled) or np.abs(scaled).max() < 2.0**53
        out.append(scaled.astype(np.int64) if exact else np.array([int(x) for x in scaled], dtype=object))
    return out


def stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros."""
    width = max(map(len, vectors), default=0)
    kind = object if any(v.dtype == object for v in vectors) else np.int64
    out = np.zeros((len(vectors), width), dtype=kind)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.hstack([m, np.zeros((len(m), width - m.shape[1]), dtype=m.dtype)])


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, norms) as doubles; a vector of zeros has the direction 0."""
    m = m.astype(np.float64)
    most = np.abs(m).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    m = m / safe[:, None]  # squares of large components would overflow
    norms = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norms > 0, norms, 1.0)[:, None], norms * safe * (most > 0)


def angles(m: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to the references, a row each."""
    width = max(m.shape[1], references.shape[1])
    directions, _ = unit(widened(m, width))
    return np.arccos(np.clip(directions @ widened(references, width).T, -1.0, 1.0))


def angle_slack(width: int) -> float:
    """What rounding may do to two angles: a cosine is off by a few units in the last place for each component, an arc cosine near 0 and a half turn by the square root of twice that."""
    return 2 * float(np.sqrt(2 * (2 * width + 16) * 2.0**-52))


def score_bounds(mine: np.ndarray, others: np.ndarray, n_mine: np.ndarray, n_others: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) scores of each of mine with each of others, from angles to the references and norms; widened by what rounding can do."""
    near = np.zeros((len(mine), len(others)))
    far = np.full((len(mine), len(others)), np.pi)
    for r in range(mine.shape[1]):
        a, b = mine[:, r, None], others[None, :, r]
        np.maximum(near, np.abs(a - b), out=near)
        both = a + b
        np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
    near, far = np.clip(near - angle_slack(width), 0, np.pi), np.clip(far + angle_slack(width), 0, np.pi)
    norms = n_mine[:, None] * n_others[None, :]
    slack = SCORE_SLACK * norms
    return norms * np.cos(far) - slack, norms * np.cos(near) + slack


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of a with the same rows of b; past a long's range they end there."""
    if not a.size:
        return np.zeros(len(a), dtype=np.int64)
    most = int(abs(a).max()) * int(abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if most <= LONG:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    exact = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
    return np.array([min(max(x, -LONG - 1), LONG) for x in exact], dtype=np.int64)


def pick_references(sample: np.ndarray) -> np.ndarray:
    """Directions far from each other: each next one has the greatest angle to those before."""
    directions, norms = unit(sample)
    directions = directions[norms > 0]
    if not len(directions):
        return np.zeros((0, sample.shape[1]))
    picked = [0]
    nearest = directions @ directions[0]
    while len(picked) < min(REFERENCES, len(directions)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, directions @ directions[picked[-1]])
    return directions[picked]


class Rows:
    """Rows of a batch, or a block of anchors, as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.row = np.array(batch.column("row").to_pylist(), dtype=np.int64)
        ids = batch.column("id").to_pylist()
        self.ids = np.array([LONG if i is None else i for i in ids], dtype=np.int64)
        self.labels = np.array(batch.column("label").to_pylist(), dtype=np.int64)
        self.vectors = stacked(to_integers(batch.column("vector").to_pylist()))
        self.norms = np.array(batch.column("norm").to_pylist(), dtype=np.float64)
        self.angles = np.array(batch.column("angles").to_pylist(), dtype=np.float64)

    def __len__(self) -> int:
        return len(self.row)


class Best:
    """For each of n questions, the first k answers: higher scores first, then smaller ids and rows."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.held = np.empty((0, 4), dtype=np.int64)  # question, score, id, row
        self.floor = np.full(n, -LONG - 1, dtype=np.int64)  # the k-th score
        self.waiting: list[np.ndarray] = []

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        self.waiting.append(np.stack([question, score, ids, row], axis=1))
        if sum(map(len, self.waiting)) > 4 * self.n * self.k + (1 << 14):
            self.settle()

    def settle(self) -> np.ndarray:
        every = np.concatenate([self.held, *self.waiting])
        every = every[np.lexsort((every[:, 3], every[:, 2], ~every[:, 1], every[:, 0]))]
        first = np.concatenate([[0], np.cumsum(np.bincount(every[:, 0], minlength=self.n))])
        place = np.arange(len(every)) - first[every[:, 0]]
        last = every[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]
        self.held, self.waiting = every[place < self.k], []
        return self.held


def _bounds(block: Rows, mine: Rows) -> tuple[np.ndarray, np.ndarray]:
    width = max(block.vectors.shape[1], mine.vectors.shape[1])
    return score_bounds(block.angles, mine.angles, block.norms, mine.norms, width)


def _meet(block: Rows, mine: Rows, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, other, score) of the pairs that ask marks, scored with integers."""
    a, b = np.nonzero(ask)
    width = max(block.vectors.shape[1], mine.vectors.shape[1])
    left, right = widened(block.vectors, width), widened(mine.vectors, width)
    parts = [integer_scores(left[a[k : k + (1 << 16)]], right[b[k : k + (1 << 16)]]) for k in range(0, len(a), 1 << 16)]
    return a, b, np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _kth(values: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """In each row, the k-th greatest of the values that are sure; without as many, no bound."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(sure, values, -np.inf), -k, axis=1)[:, -k]


def positives_of(block: Rows, steps: Iterator[Rows], k: int = POSITIVES) -> np.ndarray:
    """(anchor's place, score, id, row): the first k rows of each anchor's label, but for itself."""
    best = Best(len(block), k)
    for mine in steps:
        ask = (block.labels[:, None] == mine.labels[None, :]) & (block.row[:, None] != mine.row[None, :])
        least, greatest = _bounds(block, mine)
        # k rows reach this for sure; what can't is not asked
        floor = np.maximum(_kth(least, ask, k), best.floor)
        a, b, score = _meet(block, mine, ask & (greatest >= floor[:, None]))
        best.add(a, score, mine.ids[b], mine.row[b])
        best.settle()
    return best.settle()


def negatives_of(block: Rows, steps: Iterator[Rows], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int = NEGATIVES) -> np.ndarray:
    """(question, score, id, row): for each window from low to high of an anchor (ascending), the first k rows of other labels in it."""
    best = Best(len(anchor), k)
    first = np.searchsorted(anchor, np.arange(len(block)))
    count = np.bincount(anchor, minlength=len(block))
    for mine in steps:
        other = block.labels[:, None] != mine.labels[None, :]
        least, greatest = _bounds(block, mine)
        ask = np.zeros(other.shape, dtype=bool)
        for j in range(int(count.max(initial=0))):  # the j-th window of each anchor
            has = np.nonzero(count > j)[0]
            q = first[has] + j
            lo, hi, up, down = low[q, None], high[q, None], greatest[has], least[has]
            overlap = other[has] & (up >= lo) & (down <= hi) & (lo <= hi)
            floor = np.maximum(_kth(down, overlap & (down >= lo) & (up <= hi), k), best.floor[q])
            ask[has] |= overlap & (up >= floor[:, None])
        a, b, score = _meet(block, mine, ask)
        for j in range(int(count.max(initial=0))):
            mine_too = count[a] > j
            q, of, s = first[a[mine_too]] + j, b[mine_too], score[mine_too]
            fits = (s >= low[q]) & (s <= high[q]) & (s >= best.floor[q])
            best.add(q[fits], s[fits], mine.ids[of[fits]], mine.row[of[fits]])
        best.settle()
    return best.settle()


def _windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores s with LOW * p <= 100 * s <= HIGH * p, as (least, greatest); empty where p < 0."""
    low = [-(-LOW * int(p) // 100) for p in scores]
    high = [HIGH * int(p) // 100 for p in scores]
    return np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: F.Column) -> DataFrame:
    """(row, id, label, vector) of the rows that take part: with a label and a vector whose components are all finite."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("row", F.monotonically_increasing_id())


def hard_negatives(vectors: DataFrame, anchors: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", label: F.Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each anchor's hard negatives.

    Components become floor(256 * x), a score is the integer inner product, higher scores
    come first and ties by the smaller id (null ids last). An anchor is a row for which
    anchors (of the column id) holds; its positives are its first 5 other rows of the same
    label. For each, the first 10 rows of other labels with 30 * positive_score <= 100 *
    negative_score <= 90 * positive_score. Rows with a null label, a null vector or a
    component that is null or not finite take no part. Repeated rows and ids are rows of
    their own; of vectors that differ in length the shorter end in zeros; a score past a
    long's range ends there. Empty tables and anchors without partners give no rows; other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stage(usable(vectors, id_col, vector_col, F.col("label") if label is None else label), "hard-rows")
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE_ROWS).select("vector").toArrow().column(0).to_pylist()
    references = spark.sparkContext.broadcast(pick_references(stacked(to_integers(sample))))

    def measured(batches):
        for batch in batches:
            m = stacked(to_integers(batch.column("vector").to_pylist()))
            seen = angles(m, references.value)
            made = [pa.array(unit(m)[1]), pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * seen.shape[1], pa.array(seen.ravel()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "vector")), *made], names=["row", "id", "label", "vector", "norm", "angles"])

    shape = "row long, id long, label long, vector array<double>, norm double, angles array<double>"
    known = stage(rows.select("row", "id", "label", "vector").mapInArrow(measured, shape), "hard-angles")
    discard(rows)
    asked = stage(known.where(F.coalesce(anchors, F.lit(False))), "hard-anchors")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (width + REFERENCES + 4))))
    blocks = -(-n // size)
    if blocks > 1:  # blocks by the anchors' row numbers, so that each is read by itself
        asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(2 * blocks)))
    else:
        asked = asked.withColumn("block", F.lit(0))
    path = new_path(spark, "hard-found")
    empty = spark.createDataFrame([], RESULT)
    empty.write.parquet(path)
    for b in range(2 * blocks if blocks > 1 else blocks):
        own = asked.where(F.col("block") == b).orderBy("row").toArrow()  # a block's rows and bytes are bounded
        if len(own):
            _of_block(known, own).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def _in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= STEP_ROWS:
            yield Rows(pa.Table.from_batches(held))
            held = []
    if held:
        yield Rows(pa.Table.from_batches(held))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k answers of what tasks have found, ranked."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id"), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_block(known: DataFrame, anchors: pa.Table) -> DataFrame:
    """The result of one block of anchors."""
    spark = known.sparkSession
    block = spark.sparkContext.broadcast(anchors)

    def near(batches):
        own = Rows(block.value)
        best = positives_of(own, _in_steps(batches))
        yield pa.RecordBatch.from_arrays([pa.array(own.row[best[:, 0]]), *(pa.array(best[:, k]) for k in (1, 2, 3))], names=["anchor", "score", "id", "row"])

    near_rows = _first(known.mapInArrow(near, "anchor long, score long, id long, row long"), ["anchor"], POSITIVES)
    pairs = near_rows.orderBy("anchor", "rank").toArrow()  # POSITIVES rows an anchor
    positives = spark.sparkContext.broadcast(pairs)

    def hard(batches):
        own = Rows(block.value)
        given = positives.value
        scores = given["score"].to_numpy()
        low, high = _windows(scores)
        best = negatives_of(own, _in_steps(batches), np.searchsorted(own.row, given["anchor"].to_numpy()), low, high)
        yield pa.RecordBatch.from_arrays([pa.array(best[:, k]) for k in range(4)], names=["question", "score", "id", "row"])

    hard_rows = _first(known.mapInArrow(hard, "question long, score long, id long, row long"), ["question"], NEGATIVES)
    ids = dict(zip(anchors["row"].to_pylist(), anchors["id"].to_pylist(), strict=True))
    listed = [(q, ids[a], p, s) for q, (a, p, s) in enumerate(zip(*(pairs[c].to_pylist() for c in ("anchor", "id", "score")), strict=True))]
    questions = spark.createDataFrame(listed, "question long, anchor_id long, positive long, positive_score long")
    real = lambda c: F.when(F.col(c) != LONG, F.col(c))
    return hard_rows.join(F.broadcast(questions), "question").select(
        "anchor_id", real("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, against all rows."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), neg AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM neg WHERE rank <= 10
"""
