"""Centroid clustering against plain rounds, its bounds, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from rewardloom.llm import centroids as C

COLUMNS = "vec_id long, embedding array<float>, label int, cluster int, distance string"


def whole(x):
    if x is None or len(x) != C.SIZE or any(c is None or not math.isfinite(c) for c in x):
        return None
    return [math.floor(C.SCALE * c) for c in x]


def expected(rows, clusters=C.CLUSTERS, rounds=C.ROUNDS):
    kept = [(i, whole(x)) for i, x in rows]
    kept = [(i, v) for i, v in kept if v]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        at = [min((d2(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if k < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr), centres


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(C.SIZE)] for _ in range(9)]
    out = [(i, [m + rng.gauss(0, 0.15) for m in middles[i % 9]], 1, 7, "x") for i in range(500)]
    # A third of all vectors are one vector.
    out += [(1000 + i, out[3][1], 1, 7, "x") for i in range(250)]
    out += [out[5], out[5], (None, out[6][1], None, None, None), (None, out[7][1], None, None, None)]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [math.nan] + [0.5] * 63, [math.inf] + [0.5] * 63]
    return out + [(2000 + i, x, 1, 7, "x") for i, x in enumerate(bad)]


def test_against_plain_rounds(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    state, centres = C.clustered(C.whole_vectors(df))
    read = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, want_centres = expected(read)
    got = state.select("id", "cluster", "distance", "scans").collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == want
    assert centres.tolist() == want_centres
    # Four passes, the first of which scans all; here many centroids start within one cluster and move far.
    assert sum(r["scans"] for r in got) < 3 * len(got)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, rows, n):
    df = spark.createDataFrame(rows[:n], COLUMNS)
    state, centres = C.clustered(C.whole_vectors(df))
    want, want_centres = expected([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert sorted((tuple(r) for r in state.select("id", "cluster", "distance").collect()), key=repr) == want
    assert centres.tolist() == want_centres


def test_query_columns_on_an_empty_table(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = C.centroid_clusters(spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.count() == 0


def test_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e7] * C.SIZE, 1, 1, "")], COLUMNS)
    with pytest.raises(Exception, match="a component is beyond"):
        C.clustered(C.whole_vectors(df))


def test_drift_bounds_hold_and_are_tighter():
    """No point of a cluster's sphere gains more than the bound; bounds are at most the drift, and mostly under it."""
    rng = np.random.default_rng(1)
    under = 0
    for _ in range(200):
        dims = int(rng.integers(1, 6))
        old = rng.normal(size=(4, dims)) * 4
        new = old + rng.normal(size=old.shape) * rng.choice([0, 0.1, 1, 5])
        radius = rng.uniform(0, 4, size=4) * rng.choice([0, 0.2, 1])
        bounds = C.drift_bounds(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        for i in range(4):
            others = [j for j in range(4) if j != i]
            assert bounds[i] <= drift[others].max() + 1e-9
            under += bounds[i] < 0.9 * drift[others].max()
            x = rng.normal(size=(300, dims))
            x = old[i] + x / np.sqrt((x**2).sum(axis=1, keepdims=True)) * radius[i] * rng.uniform(0, 1, size=(300, 1)) ** 0.3
            for j in others:
                gain = np.sqrt(((x - old[j]) ** 2).sum(axis=1)) - np.sqrt(((x - new[j]) ** 2).sum(axis=1))
                assert (gain <= bounds[i] + 1e-9).all()
    assert under > 200
