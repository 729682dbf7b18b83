"""SetSketch near-dedup: registers, likelihood and groups against plain sets."""

import numpy as np
import pytest

from panelwright.llm import jaccard_join, set_sketch

from .test_operators import clashing, docs_of, near_rows, odd_rows, plain_components


def two_sets(rng, n, similarity):
    both = round(2 * n * similarity / (1 + similarity))
    a = rng.integers(0, 2**64, n, dtype=np.uint64)
    return np.unique(a), np.unique(np.concatenate([a[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)]))


def test_sketches_merge_and_count():
    rng = np.random.default_rng(1)
    a, b = two_sets(rng, 70_000, 0.4)  # more than a piece
    ra, rb, both, none = set_sketch.registers([a, b, np.union1d(a, b), a[:0]])
    assert (set_sketch.merged(ra, rb) == both).all() and not none.any()
    for n in (1, 30, 4_000, 70_000):
        assert set_sketch.cardinality(set_sketch.registers([a[:n]])[0]) == pytest.approx(n, rel=0.2)


def test_registers_do_not_depend_on_what_is_sketched_beside():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (3, 0, 40_000, 1, 500, 33_000, 7)]
    together = set_sketch.registers(sets)
    assert all((set_sketch.registers([s])[0] == r).all() for s, r in zip(sets, together, strict=True))


def test_likelihood_says_the_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.1, 0.5, 0.85, 0.97):
        found = []
        for _ in range(20):
            a, b = two_sets(rng, 600, similarity)
            ra, rb = set_sketch.registers([a, b]).astype(int)
            counts = [np.array([float((d > 0).sum())]) for d in (ra - rb, rb - ra)]
            equal = np.array([float((ra == rb).sum())])
            best = set_sketch.most_likely(np.array([len(a) / (len(a) + len(b))]), *counts, equal)
            grid = np.linspace(0.001, 0.999, 999)
            plain = set_sketch.log_likelihood(grid, np.full(999, len(a) / (len(a) + len(b))), *counts, equal)
            assert best[0] == pytest.approx(grid[plain.argmax()], abs=0.003)
            found.append(best[0])
        assert np.mean(found) == pytest.approx(similarity, abs=0.03)


def test_bands_and_bound_pass_every_link():
    rng = np.random.default_rng(4)
    for n in [*range(7, 40), 100, 1_000, 9_000]:
        for _ in range(6):
            a, b = two_sets(rng, n, 0.85 + 0.15 * rng.random())
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            both = set_sketch.registers([a, b])
            assert (set_sketch.band_keys(both)[0] == set_sketch.band_keys(both)[1]).any()
            passes = set_sketch.sketch_bound([a, b], [r.tobytes() for r in both], 85, 100)
            assert passes(0, np.array([1])).tolist() == [1]


def test_bound_leaves_what_is_far():
    rng = np.random.default_rng(5)
    sets = [s for _ in range(20) for s in two_sets(rng, 300, 0.4)]
    passes = set_sketch.sketch_bound(sets, [r.tobytes() for r in set_sketch.registers(sets)], 85, 100)
    assert sum(len(passes(k, np.arange(k + 1, len(sets)))) for k in range(len(sets) - 1)) == 0


@pytest.mark.parametrize("num,size,tile,links", [(85, 5, 1 << 18, False), (85, 5, 600, False), (90, 3, 600, True)])
def test_sketch_groups(spark, monkeypatch, num, size, tile, links):
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", tile)
    long = [f"l{k}" for k in range(50_000)]
    every = near_rows() + [(None if i is None else i + 1000, t) for i, t in odd_rows()] + [(2000, " ".join(long)), (2001, " ".join(["other", *long[:-20]]))]
    found = set_sketch.sketch_groups(docs_of(spark, every), num, 100, size, with_links=links).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(every, num, 100, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert {r.component_id for r in found if r.doc_id in (2000, 2001)} == {2000}


def test_sketch_groups_of_odd_tables(spark):
    rows = [(1, "the first text of a few words here"), (2, "the first text of a few words here"), (2, "another"), (None, None), (3, "")]
    key = lambda found: sorted(map(str, found.select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert key(set_sketch.sketch_groups(clashing(spark, rows))) == key(set_sketch.sketch_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set_sketch.sketch_groups(docs_of(spark, rows).limit(0)).count() == 0
