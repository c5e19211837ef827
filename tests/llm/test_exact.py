import hashlib

from pyspark.sql import functions as F

from quern.llm.exact import KEYS, dedup_stream, drop_exact_copies, exact_groups, latest_groups, sha256

SCHEMA = "doc_id long, text string, kept string"
ROWS = [(i, f"text {i % 7}", "x") for i in range(40)] + [(None, "text 3", None), (100, None, None), (101, "", None), (None, "lone", None), (5, "same id", None), (5, "same id", None), (6, "Text 3", None), (7, "text 3 ", None), (8, "long " * 50000, None), (9, "long " * 50000, None)]


def brute(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda d: (d is not None, d or 0))
        n_kept = 0
        for d in ids:
            kept = d == keep and not n_kept
            n_kept += kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    _, v = exact_groups(df, **options)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in v.collect()), key=str)


def test_equals_brute_force_in_one_batch_or_many(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(6)
    assert result(df) == brute(ROWS)
    df.write.parquet(str(tmp_path / "docs"))
    plain = spark.read.parquet(str(tmp_path / "docs"))
    assert result(plain, files_per_batch=1) == brute(ROWS)
    assert result(plain.filter("doc_id > 3")) == brute([r for r in ROWS if r[0] is not None and r[0] > 3])


def test_clashing_digests_are_settled_by_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    weak = lambda text: F.substring(sha256(text), 1, 1)
    got = [(d, k, n, kept) for d, k, n, kept, _ in result(df, digest=weak)]
    assert sorted(got, key=str) == sorted(((d, k, n, kept) for d, k, n, kept, _ in brute(ROWS)), key=str)


def test_state_outlives_the_query(spark, tmp_path):
    landed, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    for k in range(3):
        spark.createDataFrame([("a", k, "f", k), (f"b{k}", k, "f", k)], KEYS).write.mode("append").parquet(landed)
        dedup_stream(spark.readStream.schema(KEYS).parquet(landed), state, out).awaitTermination()
    got = {r.digest: (r.keep.doc_id, r.group_size) for r in latest_groups(spark, out).collect()}
    assert got == {"a": (2, 3), "b0": (0, 1), "b1": (1, 1), "b2": (2, 1)}


def test_drop_exact_copies(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    want = sorted((d for d, _, _, kept, _ in brute(ROWS) if kept), key=str)
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        got = drop_exact_copies(docs)
        assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=str) == want
    assert drop_exact_copies(df.limit(0)).count() == 0 and result(df.limit(0)) == []
