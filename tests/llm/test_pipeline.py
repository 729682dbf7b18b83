"""The pipeline's stages, each against brute force on what the one before kept."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import SPACES, docs_of, near_rows, odd_rows, plain_components, plain_contamination

ITEM = " ".join(f"w{100 + k}" for k in range(20))


def test_stages(spark, tmp_path):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    rows = list(dict(rows).items()) + [(1000 + i, t) for i, t in near_rows()] + [(5000, f"some words {ITEM} more"), (5001, "other words " * 300 + ITEM), (5002, "123 ..")]
    rows += [(5003, "Minä olen suomalainen ja asun pienessä kaupungissa"), (5004, "漢字仮名")]
    docs = docs_of(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 5000, "xx"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, columns = f"file://{tmp_path}", docs.columns
    left = {i: t or "" for i, t in rows}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{k}")
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language ID":
            # without a letter, or in letters and words that no labelled text is near
            assert {0, 1, 2, 43, 5002, 5003, 5004} == set(left) - got
        elif name == "exact dedup":
            least = {}
            for i in sorted(left):
                least.setdefault(re.sub(SPACES, " ", left[i]), i)
            assert got == set(least.values())
        elif name == "n-gram Jaccard join":
            assert got == {c for _, _, c in plain_components(list(left.items()), 80, 100, 5)}
        elif name == "benchmark decontamination":
            assert got == {r[0] for r in plain_contamination(list(left.items()), [(1, ITEM)]) if not r[5]}
            assert 5000 not in got and 5001 in got
        else:
            assert got == set(left) and docs.where("NOT round_trip").count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        left = {i: t for i, t in left.items() if i in got}


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Rows stand or fall by themselves: ids may be null or repeat, whole rows may repeat, and one text is very long."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    a, b, c, long = text(80), text(80), text(80), text(20_000)
    rows = [(7, a), (7, near(a)), (None, b), (None, near(b)), (8, c), (8, c), (None, None), (None, ""), (None, "12"), (9, long), (9, text(90)), (None, text(70))]
    rows += [(100 + k, text(60)) for k in range(40)]
    docs = docs_of(spark, rows).withColumn("lang", F.lit("xx"))
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, f"file://{tmp_path}").write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{k}")
        counts.append(docs.count())
    # without a letter: three rows; repeated: one; near copies: two
    assert counts == [len(rows) - 3, len(rows) - 4, len(rows) - 6, len(rows) - 6, len(rows) - 6]
    kept = sorted(str(r.doc_id) for r in docs.where("doc_id IS NULL OR doc_id < 100").collect())
    assert kept == ["7", "8", "9", "9", "None", "None"] and docs.where(F.length("text") > 50_000).count() == 1
    assert docs.where("NOT round_trip").count() == 0
