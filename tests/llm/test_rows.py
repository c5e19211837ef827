"""Stages return their input's rows, whatever columns these have and however the rows came about."""

import pytest
from pyspark.sql import functions as F

from quern.llm.exact import drop_exact_copies, exact_groups
from quern.llm.mixing import apply_mix
from quern.llm.quality import keep_good
from quern.llm.rows import is_plain_scan, located
from quern.llm.simhash import keep_one_of_each

CLASH = ["_h0", "_i", "_h", "_n", "_k", "_file", "_place", "_copies", "_copy", "_metadata", "file", "place", "text_", "score", "root", "node"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, f"text number {i % 6} of some {i % 6} words", f"s{i % 2}") for i in range(12)] + [(None, None, None), (None, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASH])
    path = str(tmp_path_factory.mktemp("rows") / "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def whole(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("plain", [True, False])
def test_clashing_columns_are_handed_on(spark, docs, plain):
    df = docs if plain else docs.repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    given = set(whole(df))
    for stage in (drop_exact_copies, keep_one_of_each, apply_mix, lambda d: keep_good(d, labels)):
        got = stage(df)
        assert got.columns == df.columns and set(whole(got)) <= given
    assert sorted(r.doc_id for r in drop_exact_copies(df).collect() if r.doc_id is not None) == [6, 7, 8, 9, 10, 11]
    assert sorted(r.doc_id for r in keep_one_of_each(df).collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5]


def test_what_names_a_row_for_good(spark, docs, tmp_path):
    doubled = docs.select("doc_id", F.explode(F.array("text", "text")).alias("text"))
    path = str(tmp_path / "one")
    docs.write.parquet(path)
    frames = [(docs, True), (docs.filter("doc_id > 3"), True), (docs.select("doc_id", "text"), True), (doubled, False), (docs.union(docs), False), (docs.filter(F.rand() < 2), False), (spark.read.parquet(path, path), False), (docs.limit(3), False)]
    for df, plain in frames:
        rows, file, place = located(df)
        assert is_plain_scan(df) == plain
        assert rows.select(file, place).distinct().count() == rows.count() == df.count()


def test_rows_that_an_explode_repeats(spark, docs):
    doubled = docs.select("doc_id", F.explode(F.array("text", "text")).alias("text"))
    assert drop_exact_copies(doubled).count() == 7
    _, verdicts = exact_groups(doubled)
    assert verdicts.filter("kept").count() == 7 and verdicts.count() == 28
    assert keep_one_of_each(doubled).count() == 7
