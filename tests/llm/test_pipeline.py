import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.session import materialise

SF = os.environ.get("QUERN_TEST_DATA", "/root/testdata") + "/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingles(text, width=5):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_classifier_drops_bad_labels_and_keeps_good(spark, steps):
    kept = {d for d, _ in rows(steps[1])}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    assert sum(good) / len(good) > 0.95


def test_exact_dedup_equals_brute_force(steps):
    last = {}
    for d, t in rows(steps[1]):
        last[t] = max(last.get(t, -1), d)
    assert sorted(rows(steps[2])) == sorted((d, t) for t, d in last.items())


def test_near_dedup_against_jaccard(steps):
    before, after = dict(rows(steps[2])), dict(rows(steps[3]))
    sets = {d: shingles(t) for d, t in before.items()}
    ids = sorted(before)
    overlap = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    best = {d: max((overlap(d, e) for e in ids if e < d), default=0) for d in ids}
    assert all(d not in after for d in ids if best[d] >= 0.9)
    assert all(d in after for d in ids if best[d] < 0.55 and not any(overlap(d, e) >= 0.55 for e in ids if e != d))


def test_mix_meets_targets(steps):
    size = lambda t: len((t or "").encode().split())
    before = [(r.doc_id, r.source, size(r.text)) for r in steps[3].collect()]
    taken = Counter(r.doc_id for r in steps[4].collect())
    assert max(taken.values()) <= 3
    sizes, got, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, s, n in before:
        sizes[s] += n
        got[s] += n * taken[d]
        most[s] = max(most[s], n)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        target = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    assert all(abs(got[s] - {**target, **fixed}[s]) <= most[s] for s in sizes)


def test_packing_holds_every_copy(steps):
    pieces = steps[5].collect()
    want = Counter(r.doc_id for r in steps[4].collect())
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = [o + n for o, n in sorted(held)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(held)] and ends[-1] <= 1024
    assert len(bins) <= sum(r.length for r in pieces) / 1024 * 1.02 + 2


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == steps[5].agg(F.sum("length")).first()
