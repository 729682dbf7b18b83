"""What operators hold in one place is bounded, whatever repeats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import jaccard_join, language_id, sharding, toxicity

from .test_operators import docs_of


def test_a_repeated_id_does_not_widen_the_toxicity_sample(spark, monkeypatch):
    """One id 3,000 times over: MAX_TRAIN rows at most reach the fit."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 50)
    rng = random.Random(1)
    rows = [(7, f"some words {rng.random()}") for _ in range(3_000)] + [(100 + k, f"text number {k}") for k in range(90)]
    labels = spark.createDataFrame([(7, 1)] * 3 + [(100 + k, k % 2) for k in range(90)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda spark, owner, feature, y, fold: seen.append(len(y)) or [None])
    toxicity.fit(docs_of(spark, rows), labels, {"toxic": F.col("toxic")})
    assert seen and seen[0] <= 50


def test_language_fit_by_language_is_the_dense_one(spark):
    """Centroids and bounds are those of plain dense loops over each language's rows."""
    rng = random.Random(2)
    pools = {"x": "abcdef", "y": "uvwxyz", "z": "klmnop"}
    rows = [(k, lang, " ".join("".join(rng.choice(pools[lang]) for _ in range(4)) for _ in range(30))) for k, lang in enumerate(rng.choice("xyz") for _ in range(90))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5))
    counts = np.array([language_id.gram_counts(t) for _, _, t in rows], dtype=np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    assert np.allclose(model["idf"], idf) and sorted(set(model["langs"])) == ["x", "y", "z"]
    unit = language_id.vectors(counts, idf)
    for lang in "xyz":
        mine = np.array([r[1] == lang for r in rows])
        centroids = model["centroids"][[k for k, own in enumerate(model["langs"]) if own == lang]]
        near = [max(sum(float(a) * float(b) for a, b in zip(v, c, strict=True)) for c in centroids) for v in unit[mine][:5]]
        far = [max(sum(float(a) * float(b) for a, b in zip(v, c, strict=True)) for c in centroids) for v in unit[~mine][:5]]
        assert min(near) > max(far) and np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("limit", [300, 5_000, 1 << 30])
def test_shards_of_several_depths(spark, limit):
    """Each row is in the shortest prefix that fits, whether leaves are shallow or deep."""
    rng = random.Random(3)
    rows = [(k, "x" * rng.choice([1, 10, 90, 280])) for k in range(400)] + [(900, "y" * 4_000), (901, None)]
    found = {r.doc_id: r for r in sharding.assign_shards(docs_of(spark, rows), limit).collect()}
    hashes = {r[0]: format(r[1], "060b") for r in spark.createDataFrame(rows, "i long, t string").select("i", sharding.hash60(F.col("i").cast("string"))).collect()}
    sizes = {i: len(t or "") for i, t in rows}
    for i in sizes:
        for depth in range(61):
            own = [j for j in sizes if hashes[j][:depth] == hashes[i][:depth]]
            if sum(sizes[j] for j in own) <= limit or len(own) == 1:
                break
        assert (found[i].shard, found[i].depth, found[i].shard_rows) == (hashes[i][:depth] or "-", depth, len(own))
    assert len({r.depth for r in found.values()}) > (2 if limit < 10_000 else 0)


@pytest.mark.parametrize("num,n,pool,most", [(80, 300, 1200, 50), (80, 3000, 12000, 300), (90, 3000, 1500, 5)])
def test_common_shingles_bring_few_rows_together(num, n, pool, most):
    """A sixth of each row's shingles is dealt from a few common ones: single ones are no keys, so hardly any rows meet."""
    rng, seen = np.random.default_rng(5), {}
    common = rng.integers(0, 2**64, pool, dtype=np.uint64)
    for k in range(300):
        own = np.unique(np.concatenate([rng.choice(common, n // 6, replace=False), rng.integers(0, 2**64, n - n // 6, dtype=np.uint64)]))
        for key in jaccard_join.part_keys(own, num, 100).tolist():
            seen.setdefault(key, set()).add(k)
    assert sum(len(s) > 1 for s in seen.values()) < most


def test_counts_that_stand_out_are_all_rows(spark, monkeypatch):
    """Counts come in blocks from each task and are summed up; a shingle of all rows stands out, and few others do."""
    monkeypatch.setattr(jaccard_join, "PLACES", 1 << 16)
    rows = [(k, f"the same few words {' '.join(f'w{k}x{j}' for j in range(200))}") for k in range(300)]
    hot = jaccard_join.stands_out(docs_of(spark, rows, 7).select("text"), 3)
    at = int(jaccard_join.shingle_set(b"the same few", 3)[0] & np.uint64(jaccard_join.PLACES - 1))
    bits = np.unpackbits(hot)
    assert len(bits) == jaccard_join.PLACES and bits[at] == 1 and bits.sum() <= 10


def test_shards_are_read_a_group_at_a_time(spark, monkeypatch, tmp_path):
    """The driver never plans a read of more than a group's folders, and the query gives what assign_shards does, whatever ids repeat."""
    monkeypatch.setattr(sharding, "READ_SHARDS", 16)
    monkeypatch.setattr(sharding, "QUERY_BYTES", 2_000)
    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(900)) for k in range(400)] + [(None, None), (None, "y" * 300)]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held, was = [], sharding.read_shards
    monkeypatch.setattr(sharding, "read_shards", lambda *a: held.append(out := was(*a)) or out)
    key = lambda found: sorted((str(tuple(r)) for r in found.collect()))
    found = sharding.op2_extendible_shards(spark, f"file://{tmp_path}")
    assert key(found) == key(sharding.assign_shards(docs, 2_000)) and len(key(found)) == 402
    folders = [{f.rsplit("/", 2)[1] for f in x.inputFiles()} for x in held]
    assert len(folders) > 4 and max(map(len, folders)) <= 40 and sum(map(len, folders)) == found.select("shard").distinct().count()
    again = [(7, "z" * 500)] * 30 + rows[:40]
    path = str(tmp_path / "again")
    name, shards = sharding._write(docs_of(spark, again), path, 2_000)
    names = [r.shard for r in shards.collect()]
    assert len(names) == len(set(names)) and any("." in n for n in names)
    assert was(spark, path, docs, name, names).count() == was(spark, path, docs, name).count() == 70
