import re

import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import apply_mix, mix, source_targets, word_count

SCHEMA = "doc_id long, text string, source string, size string, key string"


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **got}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, "c": 900, None: 50}, {"x": 5}, {"é": 1, "z": 1000, "Z": 30, "a": 3, None: 0}])
def test_targets_equal_the_iterated_rule(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_word_count(spark):
    texts = ["", None, "one", " two\twords ", "ww w", "a\x0bb\x0cc\rd", "nbsp\xa0joins", "\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(word_count(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), "hot" if i % 3 == 0 else f"s{i % 7}", "x", "y") for i in range(4000)]
    rows += [(None, None, None, None, None), (5, "", "s1", None, None), (5, "", "s1", None, None), (7, "big " * 20000, "s2", None, None), (7, "big " * 20000, "s2", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = mix(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 3 for r in got)
    largest = {}
    for r in got:
        t = largest.setdefault((r.target, r.source_size), [0, 0])
        t[0], t[1] = t[0] + r.size * r.copies, max(t[1], r.size)
    assert all(abs(taken - target) <= most for (target, _), (taken, most) in largest.items())


def test_reruns_agree_however_rows_are_dealt(spark):
    df = spark.createDataFrame([(i % 1501, "w " * (1 + i * 7919 % 300), f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    once = sorted((r.doc_id, r.size, r.copies) for r in mix(df).collect())
    again = sorted((r.doc_id, r.size, r.copies) for r in mix(df.repartition(3)).collect())
    assert once == again


def test_expected_copies_follow_the_fraction(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "a" if i % 2 else "b") for i in range(3000)], "doc_id long, text string, source string")
    seen = {}
    for seed in range(4):
        for r in mix(df, seed=seed).collect():
            seen.setdefault(r.target, []).append((r.copies, r.target / r.source_size))
    for pairs in seen.values():
        assert sum(c for c, _ in pairs) / len(pairs) == pytest.approx(pairs[0][1], abs=0.05)


def test_apply_mix_repeats_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i} " * (i % 9 + 1), f"s{i % 3}", "a", "b") for i in range(200)] + [(3, "t3 " * 4, "s0", "a", "b")], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    want = sum(r.copies for r in mix(df).collect())
    got = apply_mix(df)
    assert got.columns == df.columns and got.count() == want
    assert apply_mix(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0


def test_rows_that_share_id_and_text_are_items_of_their_own(spark):
    rows = [(1, "x y z", s, "a", "b") for s in ("s0", "s1", "s2")] + [(None, "x y z", "s0", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = [(r.doc_id, r.source) for r in apply_mix(df, weights=(1,)).collect()]
    assert {s for _, s in taken} == {"s0", "s1", "s2"} and len(taken) == 4


def fold(items, uniform):
    """One reducer's items in order: what :func:`quern.llm.mixing._pivot` settles, with the numbers that it draws."""
    held, done = None, {}
    for key, size, mass in items:
        if held is None:
            held = (key, size, mass)
            continue
        hkey, hsize, hmass = held
        up, down = min(hmass, size - mass), min(mass, hsize - hmass)  # words that the held item can give, and take
        if uniform(hkey, key, len(done)) * (up + down) < down:
            a, b = hmass - up, mass + up
        else:
            a, b = hmass + down, mass - down
        if abs(a) < 1e-9 or abs(a - hsize) < 1e-9:
            done[hkey], held = a > hsize / 2, (key, size, b)
        else:
            done[key], held = b > size / 2, (hkey, hsize, a)
    return done, held


def test_rounding_equals_a_fold_in_plain_python(spark):
    from quern.llm.mixing import _uniform, pivotal_rounding

    rows = [("g", (i, i * 31, 0, i), float(1 + i * 37 % 11), 0.0) for i in range(30)]
    rows = [(g, k, s, s * (0.1 + 0.8 * ((k[0] * 7) % 10) / 10)) for g, k, s, _ in rows]
    items = spark.createDataFrame(rows, "grp string, key struct<id:long,h:long,salt:long,row:long>, size double, mass double")
    got = {r.key.id: r.extra for r in pivotal_rounding(items, seed=7, fan_in=100).collect()}
    order = F.xxhash64(F.lit(8), "key.id", "key.h", "key.salt")
    ordered = [(r.key, r.size, r.mass) for r in items.orderBy(order).collect()]
    n = spark.createDataFrame([(a, b, d) for a, *_ in ordered for b, *_ in ordered for d in range(30)], "a struct<id:long,h:long,salt:long,row:long>, b struct<id:long,h:long,salt:long,row:long>, d int")
    drawn = {(r.i, r.j, r.d): r.u for r in n.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), "d", _uniform(F.lit(7), F.lit(0), "a.id", "a.h", "a.salt", "b.id", "b.h", "b.salt", "d").alias("u")).collect()}
    done, (last, size, mass) = fold(ordered, lambda a, b, d: drawn[a.id, b.id, d])
    u = items.filter(F.col("key.id") == last.id).select(_uniform(F.lit(7), F.lit(-1), "key.id", "key.h", "key.salt")).first()[0]
    assert got == {k.id: x for k, x in done.items()} | {last.id: u * size < mass}
    assert abs(sum(s * got[k.id] for k, s, _ in ordered) - sum(m for *_, m in ordered)) < max(s for _, s, _ in ordered)
