"""Searches that read their texts once: equal to those over an index and over vectors, with one worker a task for both steps."""

from quern.functions import text
from quern.operators import dense, hashing, keyword, scan

ODD = ["", None, "  ", "ſtraße Kelvin K2 3.14.15 a_b __c", "ещё одно слово", "naïve über ﬁne × “quoted” 1⁄2 …", "The OF and", "ΑΒΓ ÀÉ", "x" * 5000, "soft­hyphen zero​width", "a", "İstanbul I İ"]


def rows(spark, n=400):
    words = ["river", "rivers", "bridge", "bridges", "steel", "stone", "walking", "walked", "Über", "naïve", "snake_case", "1.2.3", "the", "of", "copper", "copies"]
    made = [" ".join(words[(i * j + j * j) % len(words)] for j in range(1, 2 + i % 37)) for i in range(n)]
    return spark.createDataFrame([*enumerate(made + ODD)], "id int, text string").repartition(3)


def listed(df):
    return sorted(map(tuple, df.select("qid", "id", "score", "rank").collect()))


def asked(spark):
    return spark.createDataFrame([(1, "walking over stone bridges"), (2, "naïve copper"), (3, "the of"), (4, ""), (5, "snake_case 1.2.3 steel Kelvin"), (6, "zebra"), (6, "river river")], "qid int, question string")


def test_tokens_are_found_alike_in_python(spark):
    df = rows(spark)
    raw = spark.createDataFrame([(bytearray(b"ab \xff\xfe Cd"),)], "b binary").selectExpr("10000 id", "cast(b as string) text")
    df = df.union(raw)
    table = df.select("id", *text.unsplit("text")).toArrow().combine_chunks()
    found = {}
    for start, lists in text.split_few(table.column("_split_text").chunk(0), table.column("_split_tokens").chunk(0), 50, 300):
        found |= dict(zip(table.column("id").to_pylist()[start : start + len(lists)], lists.to_pylist()))
    assert found == {r.id: r.t for r in df.select("id", text.tokens("text").alias("t")).collect()}


def test_keyword_search_equals_the_index(spark, monkeypatch):
    df, q = rows(spark), asked(spark)
    want = listed(keyword.search(keyword.build_index(df), q, 7))
    assert len(want) > 20
    monkeypatch.setattr(scan, "BLOCK_CELLS", 300)
    assert listed(scan.keyword_search(df, "id", "text", q, 7)) == want
    twice = df.union(df.filter("id % 5 = 0"))
    assert listed(scan.keyword_search(twice, "id", "text", q, 7)) == listed(keyword.search(keyword.build_index(twice), q, 7))
    monkeypatch.setattr(scan, "HANDED_TERMS", 2)
    assert listed(scan.keyword_search(df, "id", "text", q, 7)) == want
    assert listed(scan.keyword_search(df, "id", "text", q.limit(0), 7)) == listed(scan.keyword_search(df.limit(0), "id", "text", q, 7)) == []


def test_embed_search_equals_the_vectors_in_one_worker(spark, monkeypatch):
    df, q = rows(spark), hashing.hash_embed(asked(spark), "qid", "question").withColumnRenamed("vector", "v")
    made = hashing.hash_embed(df, "id", "text").withColumnRenamed("vector", "v")
    want = listed(dense._search(made, q, 7, None, dense._all_rows))
    found = scan.embed_search(df, "id", "text", q, 7)
    assert listed(found) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(dense, "HANDED_CELLS", 1)
    assert listed(scan.embed_search(df, "id", "text", q, 7)) == want
