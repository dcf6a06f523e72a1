import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import elkan


def brute(rows, k=16, rounds=3):
    """rows: (vec_id, components); (vec_id, cluster, distance) of kept ones and the centroids, by all distances."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(str((i, c, d)) for (i, _), (d, c) in zip(kept, place())), centroids


def as_floats(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def vectors(seed, n, spread=1.0, ids=range(10**6)):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(i, as_floats([m + rng.gauss(0, spread) for m in rng.choice(middles)])) for i, _ in zip(ids, range(n))]


def odd_vectors():
    base = vectors(3, 60)
    odd = [(100, None), (101, []), (102, base[0][1][:63]), (103, base[0][1] + [0.0]), (104, [None] + base[0][1][1:]), (105, [math.nan] + base[0][1][1:]), (106, [math.inf] + base[0][1][1:]), (107, [-math.inf] * 64)]
    return base + odd + [(5, base[7][1]), (5, base[8][1]), (None, base[9][1]), (None, base[10][1])] + base[:3]


def framed(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def check(spark, rows, k=16, rounds=3):
    state, centroids = elkan.cluster_vectors(framed(spark, rows), k=k, rounds=rounds)
    want, last = brute(rows, k, rounds)
    assert sorted(str((r.vec_id, r.cluster, r.distance)) for r in state.collect()) == want and centroids == last


def test_against_brute_force(spark):
    check(spark, vectors(1, 400))
    check(spark, vectors(2, 300, spread=0.05), rounds=6)
    check(spark, odd_vectors())


def test_ties_and_few(spark):
    """Vectors on a small grid tie all the time; fewer vectors than centroids; all vectors alike."""
    rng = random.Random(4)
    grid = [(i, [rng.choice([0.0, 1 / 64, -1 / 64]) if j < 3 else 0.0 for j in range(64)]) for i in range(300)]
    check(spark, grid, rounds=5)
    check(spark, vectors(5, 3))
    check(spark, [(i, [0.5] * 64) for i in range(50)])
    assert elkan.cluster_vectors(framed(spark, []))[0].count() == 0


def test_bounds_hold_and_skip():
    """Bounds stay on the safe side of exact distances over rounds, and leave most distances out."""
    rng = np.random.default_rng(1)
    v = np.floor(64 * (rng.normal(size=(9, 64))[rng.integers(0, 9, 3000)] + 0.1 * rng.normal(size=(3000, 64)))).astype(np.int64)
    now, before = v[:16], None
    cluster, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros((3000, 16), np.float32)
    for turn in range(6):
        if before is not None:
            upper, lower = elkan.moved_bounds(cluster, upper, lower, before, now)
        exact = ((v[:, None] - now[None]) ** 2).sum(axis=2)
        if before is not None:
            assert (upper.astype(float) ** 2 >= exact[np.arange(3000), cluster]).all() and (lower.astype(float) ** 2 <= exact).all()
        cluster, d, upper, lower, looked = elkan.assign(v, cluster, upper, lower, now)
        assert (cluster == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
        assert (upper.astype(float) ** 2 >= d).all() and (lower.astype(float) ** 2 <= exact).all()
        before, now = now, np.array([v[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else now[j] for j in range(16)])
    assert looked < 3000 * 16 / 4


def test_large_components(spark):
    """Exact up to the bound; what is beyond is left out, whatever its size."""
    big = elkan.MOST / 64
    rows = vectors(6, 40) + [(200, [big] * 64), (201, [-big] * 64), (202, [big * 2] + [0.0] * 63), (203, [3e38] * 64)]
    state, _ = elkan.cluster_vectors(framed(spark, rows))
    want, _ = brute(rows[:-2])
    assert sorted(str((r.vec_id, r.cluster, r.distance)) for r in state.collect()) == want


def test_query(spark, tmp_path):
    rows = odd_vectors()
    framed(spark, rows).withColumn("v", F.lit("x")).withColumn("cluster", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = elkan.op13_centroid_clusters(spark, str(tmp_path)).collect()
    want, centroids = brute(rows)
    assert sorted(str((r.vec_id, r.cluster, r.distance)) for r in got) == want
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) and r.inertia == sum(x.distance for x in got)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
