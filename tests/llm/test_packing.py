import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm.packing import best_fit, bin_completion, fillings, lower_bound, pack, sequences

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def holds(plan, counts, capacity):
    total = {}
    for filling, bins in plan:
        assert bins > 0 and sum(s * k for s, k in filling) <= capacity
        for s, k in filling:
            total[s] = total.get(s, 0) + k * bins
    assert total == {s: n for s, n in counts.items() if n}
    return sum(n for _, n in plan)


def fewest_bins(items, capacity):
    """By trying every bin for every item."""
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[i]:
                put(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        put(i + 1, rooms + [capacity - items[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_small_cases_reach_the_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(2, 14) for _ in range(10)), reverse=True)
    counts = {s: items.count(s) for s in items}
    plan = bin_completion(counts, 20)
    got, fewest = holds(plan, counts, 20), fewest_bins(items, 20)
    assert lower_bound(counts, 20) <= fewest and got == fewest


def test_beats_best_fit_where_it_can():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # total 40
    counts = {s * 10 + d: n for (s, n), d in zip(counts.items(), (1, -1, 1, -1, 0))}
    assert holds(bin_completion(counts, 100), counts, 100) <= holds(best_fit(counts, 100), counts, 100)
    assert fillings([3, 4, 7], {3: 1, 4: 1, 7: 1}, 7) == [[7]]


@pytest.mark.parametrize("scale", [1, 10**9])
def test_large_histograms(scale):
    rng = np.random.default_rng(scale)
    counts = {int(s): int(n) * scale for s, n in zip(*np.unique(np.minimum(rng.lognormal(5.8, 1.1, 20000).astype(int) % 1024 + 1, 1024), return_counts=True))}
    plan = bin_completion(counts, 1024)
    assert holds(plan, counts, 1024) <= lower_bound(counts, 1024) * 1.002 + 1 and len(plan) < 5000
    assert bin_completion({}, 1024) == []


def test_pack(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, "word text more " * rng.choice([0, 1, 5, 20, 40]), "x") for i in range(150)]
    rows += [(None, None, None), (3, "again " * 200, None), (3, "again " * 200, None), (900, "very long " * 700, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string").repartition(6)
    packed = pack(df, PATH, 128, with_ids=True)
    got = packed.collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    whole = [(d, ids(t)) for d, t, _ in rows]
    want = []
    for d, x in whole:
        first = (len(x) - 1) % 128 + 1
        cuts = [0, *range(first, len(x) + 1, 128)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= -(-sum(w[3] for w in want) // 128) + 1
    built = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    assert all(built[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids) for r in got)
    assert pack(df.limit(0), PATH).count() == 0
