"""Hard negatives against plain loops, and score bounds against scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import hard_negatives as hn

from .test_operators import INSIDE


def plain(rows, every=100):
    """rows of (id, vector, label): the contract by plain loops; rows that repeat are rows of their own."""
    known = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((k, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for k, i, v, label in known:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m, other) for m, j, w, other in known if m != k]
        for ps, pid, _, _ in sorted((r for r in scored if r[3] == label), key=order)[:5]:
            fits = sorted((r for r in scored if r[3] != label and 30 * ps <= 100 * r[0] <= 90 * ps), key=order)[:10]
            out += [(i, pid, n, r[1], ps, r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=str)


def mine(spark, rows, every=100, parts=3):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    found = hn.hard_negatives(table, F.col("id") % every == 0)
    return sorted(map(tuple, found.collect()), key=str)


def many_rows(n=500, width=12, seed=1):
    rng, rows = np.random.default_rng(seed), []
    centres = rng.normal(size=(4, width))
    for k in range(n):
        v = centres[k % 4] * rng.random() + rng.normal(size=width) * rng.choice([0.05, 0.5, 1.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    return rows


def odd_rows():
    rows = many_rows(140)
    rows += [(1_000, [0.0] * 12, 1), (1_001, None, 1), (1_002, rows[3][1], None), (1_003, [None, *rows[3][1][1:]], 2), (1_004, [float("nan")] * 12, 2), (1_005, [float("inf")] * 12, 2)]
    rows += [(1_100, [], 1), (1_101, rows[5][1][:7], 3), (1_200, rows[8][1] + [1.0] * 4, 0), (None, rows[9][1], 2), (None, rows[9][1], 2)]
    return rows + [(2_000 + k, rows[0][1], k % 3) for k in range(60)]  # one vector many times


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 64):
        m = rng.normal(size=(300, width)) * rng.choice([1e-3, 1.0, 1e4], size=(300, 1))
        m = np.floor(256 * np.vstack([m, m[:50] * 3, -m[:50], m[:50], np.zeros((2, width))])).astype(np.int64)
        references = hn.pick_references(m[rng.permutation(len(m))])
        norms, seen = hn.unit(m)[1], hn.angles(m, references)
        least, greatest = hn.score_bounds(seen, seen, norms, norms, width)
        exact = m.astype(object) @ m.T.astype(object)
        assert (least <= exact).all() and (exact <= greatest).all()


def test_bounds_leave_most_of_what_is_far():
    rows = many_rows(400)
    m = hn.stacked(hn.to_integers([v for _, v, _ in rows]))
    seen, norms = hn.angles(m, hn.pick_references(m)), hn.unit(m)[1]
    least, greatest = hn.score_bounds(seen, seen, norms, norms, 12)
    scores = m @ m.T
    assert (greatest < np.quantile(scores, 0.97, axis=1)[:, None]).mean() > 0.2


def test_integer_scores_beyond_doubles():
    big = [float(np.float32(x)) for x in (3e38, -2e38, 1.0)]
    m = hn.stacked(hn.to_integers([big, [1.0, 1.0, 0.5]]))
    assert m.dtype == object and hn.integer_scores(m[:1], m[1:]).tolist() == [hn.LONG]
    mid = hn.stacked([np.array([1 << 30, 3]), np.array([(1 << 30) + 1, 5])])
    assert hn.integer_scores(mid[:1], mid[1:]).tolist() == [(1 << 30) * ((1 << 30) + 1) + 15]


@pytest.mark.parametrize("block,step", [(1_024, 2_048), (3, 17)])
def test_hard_negatives(spark, monkeypatch, block, step):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)  # small blocks make several rounds
    monkeypatch.setattr(hn, "STEP_ROWS", step)
    assert mine(spark, many_rows(), 50) == plain(many_rows(), 50)
    assert mine(spark, odd_rows(), 20) == plain(odd_rows(), 20)


def test_few_rows(spark):
    assert mine(spark, [(0, [1.0], 1)]) == [] == mine(spark, [])
    rows = [(0, [1.0], 1), (1, [2.0], 1), (2, [0.5], 2), (3, [1.5], 2), (4, [-1.0], 2)]
    assert mine(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_columns_with_the_names_used_inside(spark):
    rows = many_rows(60)
    rng = random.Random(3)
    names = [n for n in INSIDE if n not in ("label",)] + ["anchor", "vector", "norm", "angles", "question", "positive"]
    names = list(dict.fromkeys(names))
    wide = spark.createDataFrame([(*r, *[f"v{rng.random()}" for _ in names]) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(map(tuple, hn.hard_negatives(wide, F.col("id") % 30 == 0).collect()), key=str) == plain(rows, 30)
