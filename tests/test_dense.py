"""Exact search hands the queries to the rows; vectors are neither counted nor dealt out first."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import dense


def tables(spark, n=700, width=40):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=width)]) for i in range(n)]
    odd = [(9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan")] * width), (9005, [float("inf")] * width), (9006, [0.0] * width), (9007, [0.5] * (width - 3)), (9008, rows[3][1])]
    v = spark.createDataFrame(rows + odd, "id int, v array<float>").repartition(3)
    return v, v.filter("id % 50 = 0 or id > 9000").withColumnRenamed("id", "qid")


def test_both_ways_agree(spark, monkeypatch):
    v, q = tables(spark)
    monkeypatch.setattr(dense, "BLOCK_CELLS", 3000, raising=False)
    found = lambda df: sorted(map(tuple, df.collect()))
    for allowed in (None, v.filter("id % 2 = 0").select("id"), v.limit(0).select("id")):
        handed = found(dense.exact_search(v, q, 10, allowed))
        assert handed == found(dense._search(v, q, 10, allowed, dense._all_rows))
        assert bool(handed) == (allowed is None or allowed.count() > 0)
    assert found(dense.exact_search(v, q.limit(0), 10)) == []


def test_rows_are_read_once(spark):
    v, q = tables(spark)
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = v.mapInArrow(pass_on, v.schema)
    assert dense.exact_search(counted, q, 5).select(F.count("*")).first()[0] > 0
    assert read.value == v.count()
