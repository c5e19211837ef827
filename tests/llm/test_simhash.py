import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import connected_components
from quern.llm.simhash import Rule, fingerprint, keep_one_of_each, near_duplicate_components


def brute_fingerprint(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, group)), key=str)


def make_rows(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.25:
            text = rng.choice(rows)[1] or ""
        elif rows and kind < 0.6:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 2, 3, 40, 150])))
        rows.append((i, text))
    return rows + [(None, "no id here at all"), (None, None), (n + 1, None), (n + 1, None), (n + 2, " \t\n"), (n + 3, "Ä B\x0bC d"), (3, rows[3][1])]


@pytest.mark.parametrize("tile", [4, 8192])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_LEFT", tile)
    monkeypatch.setattr(simhash, "TILE_RIGHT", tile)
    rows = make_rows(5, 250)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = near_duplicate_components(df, 3, Rule(2)).collect()
    assert sorted(((r.id, r.word & (1 << 64) - 1, r.component_id) for r in got), key=str) == brute_components(rows)
    assert near_duplicate_components(df.limit(0), 3, Rule(2)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = fingerprint(text.encode(), 3, 256)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert fingerprint(text.encode(), 3, 256) == whole and int.from_bytes(whole[0][:8], "little") == brute_fingerprint(text)


def test_every_population_neighbour_is_met():
    rng = np.random.default_rng(0)
    ids = np.arange(400)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sig = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    sides = (ids, sig[:, None], np.ones(400))
    u, v = simhash.tile_links(sides, sides, Rule(2))
    assert len(u) < 400  # a forest
    near = np.bitwise_count(sig[:, None] ^ sig[None, :]) <= 2
    label = list(range(400))
    for a, b in zip(u, v):
        x, y = label[a], label[b]
        label = [min(x, y) if g in (x, y) else g for g in label]
    reach = near.astype(int)
    for _ in range(9):
        reach = ((reach @ reach) > 0).astype(int)
    assert all((label[a] == label[b]) == bool(reach[a, b]) for a in range(400) for b in range(400))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 100), (-5, 39)]])
def test_components(spark, edges):
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_keep_one_of_each(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(fresh(200)), "clean") for i in range(60)]
    for i in range(10):
        words = rows[i][1].split()
        words[50] = "changed"
        rows += [(100 + i, " ".join(words), "near"), (200 + i, rows[i][1], "copy")]
    rows += [(0, rows[0][1], "clean"), (None, "a b c", None), (None, "a b c", None), (300, None, None), (301, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*range(60), None, 300], key=str)
    assert keep_one_of_each(df.limit(0)).count() == 0


def test_repeated_passages_do_not_hide_a_near_copy(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[:60])), (3, " ".join(f"x{i}" for i in range(100)))]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("block", [3, 1024])
def test_near_dedup_decides_by_true_overlap(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    # Cutting the end of a text of n shingles leaves c of them: an overlap of c / n.
    for n, c in [(5, 4), (7, 6), (10, 8), (100, 80), (400, 320), (5, 3), (7, 5), (100, 79), (100, 78), (400, 319), (400, 310)] * 12:
        words, i = fresh(n + 4), len(rows)
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[: c + 4]))]
        want |= {i} if c * 5 >= n * 4 else {i, i + 1}
    common = fresh(150)
    first = len(rows)
    rows += [(first + i, " ".join([*common, f"end{i}"])) for i in range(40)]
    want.add(first)
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id for r in got.collect()} == want
