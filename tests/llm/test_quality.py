import random
import zlib

import numpy as np
import pytest

from quern.llm.quality import NAMES, QualityModel, held_out, isotonic, keep_good, quality_scores, statistics


def text(rng, good):
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 120))]
    if not good:
        words = [w + rng.choice(["###", "$$$", "***"]) if rng.random() < 0.6 else w.upper() for w in words]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 5 != 1), "en", "s", "x") for i in range(600)]
    odd = [(None, "null id text", None, None, None), (700, None, None, None, None), (701, "", None, None, None), (701, "", None, None, None), (702, "w " * 100000, None, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 5 != 1), 0) for i in range(600)] + [(3, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark, tables):
    docs, labels = tables
    got = quality_scores(docs, labels).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.id is None else str(r.id)).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out and r.id is not None and r.id < 600]
    assert np.mean([(r.score >= 0.5) == (r.id % 5 != 1) for r in unseen]) > 0.95
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(600) if (i in ids) == (i % 5 != 1)]) > 570


def test_labels_of_held_out_rows_teach_nothing(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    wrong = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {(r.id, r.k0): round(r.score, 9) for r in quality_scores(docs, x, carry=("text",)).collect()}
    assert score(labels) == score(wrong)


def test_no_rows_and_no_labels(spark, tables):
    docs, labels = tables
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert keep_good(docs.limit(0), labels).count() == 0


def test_statistics():
    assert statistics(b"") == [0.0] * len(NAMES)
    got = dict(zip(NAMES, statistics(b"Some words!!\nSOME $$$ more words")))
    assert got["log_words"] == pytest.approx(np.log(7)) and got["sign_!"] == pytest.approx(2 / 6) and got["shout_words"] == pytest.approx(1 / 6)


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, size = 4000, 5
    model = QualityModel(np.zeros(size), np.ones(size), rng.normal(size=(size, d)) / 2, rng.uniform(0, 2 * np.pi, d), np.zeros(d + 1), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(20, size))
    z = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_isotonic_pools_violators():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.ones(4), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]
