import hashlib

import numpy as np
import pytest

from tessera.llm import centroids, queries
from tests.conftest import SMALL
from tests.oracle import same_rows


def slow(rows, clusters=40, rounds=5):
    """All distances in every round."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c, x = np.array([v for _, v in order[:clusters]]), np.array([v for _, v in kept])
    for at in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        for k in range(len(c) if at < rounds else 0):
            if (own == k).any():
                c[k] = x[own == k].sum(0) // (own == k).sum()
    least = d[np.arange(len(x)), own]
    return sorted(((kept[i][0], int(own[i]), int(least[i]), int(least[own == own[i]].sum()), int(least.sum()), hashlib.sha256(",".join(map(str, c[own[i]])).encode()).hexdigest()) for i in range(len(x))), key=repr)


def ran(df):
    return sorted((tuple(r) for r in centroids.clustered(df).collect()), key=repr)


def test_query_equals_sql(spark):
    assert same_rows(spark, queries.QUERIES["op13_centroids"], queries.ORACLES["op13_centroids"], SMALL) == 500


@pytest.mark.parametrize("vector", [lambda i, j: ((i * 7 + j * i) % 3) / 256, lambda i, j: ((i * 7919 + j * i) % 1000) * 50.0, lambda i, j: (i % 5) * 1.0], ids=["ties", "large", "copies"])
def test_clusters_equal_loops(spark, vector):
    rows = [(i, [float(vector(i, j)) for j in range(64)]) for i in range(200)]
    assert ran(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)) == slow(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 9 - 4)] * 64) for i in range(20)] + [(3, [0.5] * 64)] * 2 + [(None, [0.25] * 64)]
    bad = [(30, None), (31, []), (32, [1.0] * 63), (33, [1.0] * 65), (34, [nan] + [0.0] * 63), (35, [-inf] + [0.0] * 63), (36, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "c", 7) for i, v in rows + bad], "vec_id long, embedding array<float>, cluster string, sums int")
    assert ran(df) == slow(rows)
    assert centroids.clustered(df.limit(0)).count() == 0 and centroids.clustered(df.where("vec_id >= 30")).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_bounds_hold_and_save_distances():
    """Bounds are on their side of the true distances in every round, and skip most of them."""
    rnd = np.random.default_rng(5)
    hubs = rnd.integers(-400, 400, (12, 64))
    x = hubs[rnd.integers(0, 12, 1500)] + rnd.integers(-20, 20, (1500, 64))
    c, before = x[:12].copy(), None
    cluster = upper = lower = np.empty(0)
    for at in range(6):
        cluster, upper, lower, counted = centroids.Round(c, before).assign(x, cluster, upper, centroids._narrow(lower).astype(float) if at else lower)
        d = centroids.squared(x, c)
        assert (cluster == d.argmin(1)).all() and (lower**2 <= d).all() and (upper**2 >= d.min(1)).all()
        if at:
            assert counted.sum() < 0.5 * d.size
        before, c = c, c.copy()
        for k in np.unique(cluster):
            c[k] = x[cluster == k].sum(0) // (cluster == k).sum()
