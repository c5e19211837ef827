import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import topk
from quern.llm.topk import BallTree, exact_top_k, scaled_vectors


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("SHARD_ROWS", 50), ("FIRST_ROWS", 20), ("BLOCK_QUERIES", 3)):
            monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    data += [(300 + i, data[4][1]) for i in range(40)] + [(500, [1.0, 2.0]), (501, [])]
    odd = [(900, None), (905, [1.7e308] * 6), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [0.5] * 6), (904, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data + odd], "vec_id long, v array<double>, id string")
    vectors = scaled_vectors(df, "vec_id", "v")
    whole = [(r.id, r.v) for r in vectors.collect()]
    assert len(whole) == len(data) + 1
    queries = vectors.filter(F.col("id") % 30 == 0)
    got = sorted(map(tuple, exact_top_k(vectors, queries, 5).collect()))
    assert got == brute(whole, [(i, v) for i, v in whole if i % 30 == 0], 5)


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, v array<double>")
    v = scaled_vectors(df, "id", "v")
    assert sorted(map(tuple, exact_top_k(v, v.filter("id = 0"), 10).collect())) == [(0, 1, 1, 1024 * 2048)]
    assert exact_top_k(v.limit(0), v.limit(0), 10).count() == 0


def test_tree_prunes_far_balls():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(0, 20, (500, 8)), rng.integers(900, 1000, (500, 8))]).astype(np.int64)
    tree = BallTree(np.arange(1000), rows, 50)
    kth = [float("-inf")] * 2
    found = tree.search(rows[[3, 990]], np.array([-1, -1]), 3, kth)
    want = np.sort(rows[[3, 990]] @ rows.T, axis=1)[:, ::-1][:, :3]
    assert [s.tolist() for s, _ in found] == want.tolist()


def test_components_of_any_size(spark):
    rows = [(1, [40000.0, 0.0]), (2, [50000.0, 0.0]), (3, [1e9, -1e9]), (4, [1e9, -1e9 + 1]), (5, [-4e12, 4e12]), (6, [2.0**40, 2.0**40]), (7, [-(2.0**60), 2.0**60]), (8, [1e-300, 0.25])]
    asked = [(100, [1.0, 0.0]), (101, [2.0**45, 2.0**45]), (102, [0.5, 0.5])]
    v = scaled_vectors(spark.createDataFrame(rows + asked, "id long, v array<double>"), "id", "v")
    whole = [(r.id, [int(c) for c in r.v]) for r in v.collect()]
    got = exact_top_k(v.filter("id < 100"), v.filter("id in (100, 102)"), 5).collect()
    assert sorted(map(tuple, got)) == brute([r for r in whole if r[0] < 100], [r for r in whole if r[0] in (100, 102)], 5)
    assert next(r.vec_id for r in exact_top_k(v.filter("id in (1, 2)"), v.filter("id = 100"), 1).collect()) == 2
    # Intermediate products pass 64 bits, the sums do not.
    got = exact_top_k(v.filter("id in (3, 5, 7)"), v.filter("id = 101"), 2).collect()
    assert sorted(map(tuple, got)) == brute([r for r in whole if r[0] in (3, 5, 7)], [r for r in whole if r[0] == 101], 2)
    with pytest.raises(Exception, match="64 bits"):
        exact_top_k(v.filter("id < 100"), v.filter("id = 101"), 2).collect()
    with pytest.raises(Exception, match="64 bits"):
        low = scaled_vectors(spark.createDataFrame([(1, [-(2.0**60)])], "id long, v array<double>"), "id", "v")
        exact_top_k(low, v.filter("id = 101"), 2).collect()


def test_groups_that_cannot_hold_an_answer_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 20
    data = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.1]) for i in range(600)]
    v = scaled_vectors(spark.createDataFrame(data, "id long, v array<double>"), "id", "v")
    whole = [(r.id, r.v) for r in v.collect()]
    groups = topk._Groups(v, 600, 8)
    asked = v.filter("id < 6").select(F.lit(0).alias("block"), "id", F.lit(None).cast("long").alias("kth"), "v")
    top = {q: s for q, r, _, s in brute(whole, whole[:6], 3) if r == 3}
    kth = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])[F.col("id")]
    assert groups.live(asked.withColumn("kth", kth)).count() < groups.live(asked).count() / 2
    assert sorted(map(tuple, exact_top_k(v, v.filter("id < 6"), 3).collect())) == brute(whole, whole[:6], 3)
