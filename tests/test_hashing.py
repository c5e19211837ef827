"""Hash features and vectors: equal to the plain form, in memory that does not grow with Arrow's batches."""

import math
import random
import tracemalloc
from collections import Counter
from hashlib import blake2b

import numpy as np

from quern.functions import text
from quern.functions.stem import stem_word
from quern.operators import hashing


def plain_features(tokens):
    stops, stems = set(text.STOP_WORDS), [stem_word(t) for t in tokens]
    found = [("s:" if t in stops else "w:") + s for t, s in zip(tokens, stems)]
    found += [f"b:{a} {b}" for a, b in zip(stems, stems[1:])]
    for t in [t for t in tokens if len(t) >= 5 and t not in stops][:400]:
        found += ["c:" + f"^{t}$"[i : i + 4] for i in range(len(t) - 1)]
    return Counter(found)


def plain_vector(counts, dim):
    cells = np.zeros(dim)
    for f, n in counts.items():
        d = int.from_bytes(blake2b(f.encode(), key=hashing.KEY, digest_size=8).digest(), "little")
        w = hashing.WEIGHTS[f[0]] * (1 + math.log(n))
        cells[(d >> 1) % dim] += -w if d & 1 else w
    norm = np.sqrt((cells**2).sum())
    return (cells / norm if norm else cells).astype(np.float32).tolist()


def texts_of(n, sizes, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(4000)] + text.STOP_WORDS[:20]
    return [" ".join(r.choices(words, k=r.choice(sizes))) for _ in range(n)]


def test_features_equal_the_plain_form(spark):
    rows = [*enumerate(texts_of(600, [0, 1, 2, 30, 200, 700])), (900, None), (901, ""), (902, "naïve über"), (903, "ещё одно слово"), (904, "same words, same words"), (904, "same words, same words")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    tokens = df.select("id", text.tokens("text").alias("t")).collect()
    want = Counter((r.id, f, n) for r in tokens for f, n in plain_features(r.t).items())
    assert Counter(map(tuple, hashing.hash_features(df, "id", "text").collect())) == want


def peak_of(monkeypatch, make, df):
    """MB that Python and Arrow hold at most above the start, when all rows of ``df`` come in one batch."""
    import pyarrow as pa

    got = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: got.append((self, f)))
    make(df)
    ((rows, run),) = got
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    held = 0
    base = pa.total_allocated_bytes()
    tracemalloc.start()
    for _ in run(iter([batch])):
        held = max(held, pa.total_allocated_bytes() - base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return (peak + held) / 1e6


def test_features_of_a_large_batch_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hashing, "TOKENS_AT_ONCE", 5000, raising=False)
    df = spark.createDataFrame([*enumerate(texts_of(1500, [200]))], "id int, text string")
    assert peak_of(monkeypatch, lambda df: hashing.hash_features(df, "id", "text"), df) < 80


def test_vectors_equal_the_plain_form(spark):
    rows = [*enumerate(texts_of(600, [0, 1, 2, 30, 200, 700])), (900, None), (901, ""), (902, "naïve über")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    tokens = {r.id: r.t for r in df.select("id", text.tokens("text").alias("t")).collect()}
    got = {r.id: r.vector for r in hashing.hash_embed(df, "id", "text", 64).collect()}
    assert got == {i: plain_vector(plain_features(t), 64) for i, t in tokens.items()}


def test_vectors_of_a_large_batch_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hashing, "CELLS_AT_ONCE", 1 << 16, raising=False)
    df = spark.createDataFrame([*enumerate(texts_of(5000, [3]))], "id int, text string")
    assert peak_of(monkeypatch, lambda df: hashing.hash_embed(df, "id", "text"), df) < 20


LONG = [(1, " ".join(f"{a}{b}{c}words" for a in "abcdefgh" for b in "klmnopqr" for c in "stuvwxyz") + " ending" * 3), (2, "few words stay"), (3, None)]


def whole_features(tokens):
    """The plain form with the runs of all long words."""
    runs = Counter("c:" + f"^{t}$"[i : i + 4] for t in tokens if len(t) >= 5 and t not in text.STOP_WORDS for i in range(len(t) - 1))
    return Counter({f: n for f, n in plain_features(tokens).items() if f[0] != "c"}) + runs


def test_hash_features_takes_the_whole_text(spark, tmp_path):
    from compare import connect, differences

    from quern.plans.oracle import SQL
    from quern.plans.queries import QUERIES

    spark.createDataFrame(LONG, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = connect(tmp_path)
    db.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, db, QUERIES["hash_features"], SQL["hash_features"], str(tmp_path)) == ""
    runs = {i: [n for f, n in whole_features((t or "").split()).items() if f[0] == "c"] for i, t in LONG}
    got = {r.doc_id: (r.n_distinct, r.n) for r in QUERIES["hash_features"](spark, str(tmp_path)).collect() if r.family == "c"}
    assert got == {i: (len(n), sum(n)) for i, n in runs.items() if n}


def test_hash_embed_takes_the_whole_text(spark, tmp_path):
    from quern.plans.queries import QUERIES

    spark.createDataFrame(LONG, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: np.count_nonzero(plain_vector(whole_features((t or "").split()), hashing.DIM)) for i, t in LONG}
    assert {r.doc_id: r.n_cells for r in QUERIES["hash_embed"](spark, str(tmp_path)).collect()} == want
    df = spark.createDataFrame(LONG, "id long, text string")
    got = {r.id: np.array(r.vector) for r in hashing.hash_embed(df, "id", "text", 64, most_gram_tokens=None).collect()}
    assert all(np.allclose(got[i], plain_vector(whole_features((t or "").split()), 64), atol=1e-6) for i, t in LONG)
