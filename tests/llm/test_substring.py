import hashlib
import random

import numpy as np
import pytest

from quern.llm import substring
from quern.llm.substring import drop_repeats, run_hashes, run_minima


def brute(rows, k):
    least = {}
    split = [(t or "").encode().split() for _, t in rows]
    rank = [(d is None, d or 0) for d, _ in rows]
    for r, words in zip(rank, split):
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            least[w] = min(least.get(w, r), r)
    out = []
    for (d, _), r, words in zip(rows, rank, split):
        gone = set()
        for i in range(len(words) - k + 1):
            if least[tuple(words[i : i + k])] < r:
                gone |= set(range(i, i + k))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make_rows(seed, n):
    rng = random.Random(seed)
    passage = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passage) if rng.random() < 0.5 else [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(i + n, rows[i][1]) for i in range(0, n, 9)] + [(None, rows[1][1]), (None, rows[1][1]), (None, "a b c d e f g"), (n * 3, None), (n * 3, ""), (2, rows[5][1]), (2, rows[5][1])]
    rows += [((1 << 63) - 1, rows[3][1]), ((1 << 63) - 1, "q r s t u v w x"), (None, "q r s t u v w x"), (-5, "o p q r s t u")]
    rows.append((n * 4, "same " * 5000))
    rows.append((n * 4 + 1, "same " * 300))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("batch,base", [(8 << 20, None), (600, None), (600, 0)])
def test_equals_brute_force(spark, monkeypatch, batch, base):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    monkeypatch.setattr(substring, "RUN_WINDOWS", 7)
    if base is not None:  # every window has one hash: the words decide
        monkeypatch.setattr(substring, "_BASE", 0)
    rows = make_rows(3, 120)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = drop_repeats(df, 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5)
    assert drop_repeats(df.limit(0), 5).count() == 0


def test_hot_minimisers_are_dealt_by_window(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"u{rng.randrange(10**6)}"
    shared = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(15)] + shared + [word() for _ in range(15)])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size, hot = substring._sizes(substring._rows(df, "doc_id", "text"), 13, 8)
    assert hot and size >= sum(len(t) for _, t in rows)
    assert sorted(map(tuple, drop_repeats(df, 13).collect()), key=str) == brute(rows, 13)
    kept = {r.doc_id: r.kept for r in drop_repeats(df, 13, with_text=True).collect()}
    assert len(kept[0].split()) == 60 and all(len(kept[i].split()) == 30 for i in range(1, 200))


def test_sliding_helpers():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    for k in (1, 2, 3, 5, 11, 13):
        assert run_minima(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]
        h = run_hashes(x, k)
        spelt = [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
        assert len(h) == len(spelt) and len(set(h.tolist())) == len(set(spelt)) == len(set(zip(h.tolist(), spelt)))
    assert len(run_hashes(x[:3], 5)) == len(run_minima(x[:3], 5)) == 0
