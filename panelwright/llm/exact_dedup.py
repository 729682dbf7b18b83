"""Exact dedup by content sort.

Sampled splitters range-partition the rows by normalised content, an external sort inside
each partition places equal texts side by side, and neighbouring full comparisons find
the runs. A run that a splitter cuts is joined up again from its pieces, as is a run of very
many rows, of which a task never holds more than a batch. The order is that of the
normalised bytes in their first characters; after these come a hash and the id. So the
driver's sample stays small however long texts are, and a text that many rows share spreads
over several partitions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import prepare, small, stage, table, unused

#: Characters of a text that its splitters look at.
LEAD = 48
#: Rows of an output batch, and of a piece of a run.
OUT_ROWS = 8_192


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Single spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Equal are texts with the same normalised bytes; null counts as empty, and empty texts
    equal each other. The smallest id stays, a null id only if its group has no other; of
    rows with that id, one stays. Long texts are compared whole. An empty table gives no
    rows; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.select("id", "text", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("h"))
    last = F.col("id").asc_nulls_last()
    rows = rows.repartitionByRange("lead", "h", last).sortWithinPartitions("lead", "h", "text", last)
    fields = f"id {kind}, keep {kind}, n long, head boolean, edge boolean, piece long, sha string"
    arrow = to_arrow_schema(_parse_datatype_string(fields))

    def runs(batches):
        """Rows of each piece of a run; edge: the run may go on in another piece, as it is long or has the partition's first or last hash."""
        part, first, pieces = TaskContext.get().partitionId(), None, 0
        ready, held, open_runs = [], 0, []  # a run: ids of its last piece, text, hash, whether it is cut

        def close(run, edge):
            nonlocal held, pieces
            ready.append((run[0], run[1], edge, (part << 33) + pieces))
            held, pieces = held + len(run[0]), pieces + 1

        def table_of(closed):
            n = [len(ids) for ids, *_ in closed]
            spread = lambda values: [v for v, k in zip(values, n, strict=True) for _ in range(k)]
            columns = [
                [i for ids, *_ in closed for i in ids],
                spread(ids[0] for ids, *_ in closed),
                spread(n),
                [at == 0 for k in n for at in range(k)],
                spread(edge for _, _, edge, _ in closed),
                spread(piece for *_, piece in closed),
                spread(hashlib.sha256(text).hexdigest() for _, text, _, _ in closed),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, text, h in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                first = h if first is None else first
                if not open_runs or h != open_runs[-1][2]:
                    for run in open_runs:
                        close(run, run[3] or run[2] == first)
                    open_runs = [[[i], text, h, False]]
                elif text != open_runs[-1][1]:
                    open_runs.append([[i], text, h, False])
                else:
                    run = open_runs[-1]
                    if len(run[0]) >= OUT_ROWS:
                        close(run, True)
                        run[0], run[3] = [], True
                    run[0].append(i)
                if held >= OUT_ROWS:
                    yield table_of(ready)
                    ready, held = [], 0
        for run in open_runs:
            close(run, True)
        if ready:
            yield table_of(ready)

    local = rows.select("id", "text", "h").mapInArrow(runs, fields)
    local = stage(local, "exact-runs")
    # a few pieces a partition, and one for each OUT_ROWS of a long run
    cut = local.where("edge AND head").groupBy("sha").agg(
        F.min(F.struct(F.col("keep").isNull().alias("z"), F.col("keep"), F.col("piece"))).alias("first"), F.sum("n").alias("total")
    )
    cut = stage(cut.select("sha", F.lit(True).alias("edge"), F.col("first.keep").alias("whole_keep"), F.col("first.piece").alias("whole_piece"), "total"), "exact-cut")
    found = local.join(small(cut), ["sha", "edge"], "left")
    whole = F.col("total").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(whole, F.col("whole_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(whole, F.col("total")).otherwise(F.col("n")).alias("group_size"),
        (F.col("head") & F.when(whole, F.col("piece") == F.col("whole_piece")).otherwise(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they were.

    Of rows repeated with the id that stays, the one whose columns come first as JSON does.
    """
    groups = exact_groups(docs, id_col, text_col)
    i, of, own, same, order = (unused(docs, x) for x in ("gone_id", "gone_sha", "own_sha", "gone_same", "row_order"))
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias(i), F.col("text_sha256").alias(of), F.col(id_col).eqNullSafe(F.col("keep_id")).alias(same))
    gone = stage(gone.distinct(), "exact-gone")
    marked = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    key = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(of))
    kept = marked.join(small(gone.where(~F.col(same)).drop(same)), key, "left_anti")
    repeated = gone.where(F.col(same)).drop(same)
    if repeated.count() == 0:
        return kept.drop(own)
    # rows repeated with their id: one of each stays
    repeated = small(repeated)
    once = marked.join(repeated, key, "left_semi").withColumn(order, F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))))
    return kept.join(repeated, key, "left_anti").unionByName(once.where(F.col(order) == 1).drop(order)).drop(own)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
