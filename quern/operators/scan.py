"""Searches that read their texts once and keep no index: for one batch of queries, where an index would be built for it alone.

The queries are handed to all tasks, and each task keeps the best of its blocks of rows. Both equal the search over an index or over vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.operators import dense, hashing, keyword

#: Terms of all queries together that tasks are handed, at most, and cells of what they make of them; cells of a block of rows by terms.
HANDED_TERMS, HANDED_CELLS, BLOCK_CELLS = 1 << 16, 1 << 22, 1 << 21


def embed_search(rows: DataFrame, id_column: str, text_column: str, queries: DataFrame, k: int = 24, dim: int = hashing.DIM, key: bytes = hashing.KEY) -> DataFrame:
    """(qid, id, score, rank) of queries (qid, v), equal to ``dense.exact_search`` over the vectors that ``hashing.hash_embed`` makes of rows.

    One worker makes vectors and searches them: a second one for each task would double what Python holds, and no vector goes back to the JVM.
    """
    handed = dense.handed(queries)
    if handed is None:
        return dense.exact_search(hashing.hash_embed(rows.select(F.col(id_column).alias("id"), text_column), "id", text_column, dim, key).withColumnRenamed("vector", "v"), queries, k)
    make, search = hashing.few(hashing.vectors("id", dim, key), hashing.rows_of(dim)), dense.handed_search(handed, k)
    texts = rows.select(F.col(id_column).cast("string").alias("id"), *text.unsplit(text_column))
    return keyword.ranked(texts.mapInArrow(lambda batches: search(make(batches)), dense.FOUND), k)


def keyword_search(chunks: DataFrame, id_column: str, text_column: str, queries: DataFrame, k: int = 24) -> DataFrame:
    """(qid, id, score, rank) of queries (qid, question), equal to ``keyword.search`` over ``keyword.build_index``.

    Of each text its length and the terms that some query has are kept, which is all that BM25 takes.
    """
    asked = keyword.asked_terms(queries)
    pairs = asked.select("qid", "term").limit(HANDED_TERMS + 1).collect()
    qids, terms = sorted({r.qid for r in pairs}), sorted({r.term for r in pairs})
    if len(pairs) > HANDED_TERMS or len(qids) * len(terms) > HANDED_CELLS:
        return keyword.search(keyword.build_index(chunks, id_column, text_column), queries, k)
    counted = keyword.count_terms(chunks, id_column, text_column, wanted=frozenset(terms))
    if keyword.repeats(counted.select("id")):
        return keyword.search(keyword.index_of(counted), queries, k)
    weights = np.zeros((len(terms), len(qids)))
    mean = 1.0
    at, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(qids)}
    for r in keyword.weighed(asked, keyword.frequencies(counted), counted).collect():
        weights[at[r.term], place[r.qid]], mean = r.idf, r.mean
    handed = queries.sparkSession.sparkContext.broadcast((qids, pa.array(terms, pa.string()), weights, mean))

    def search(batches):
        qids, terms, weights, mean = handed.value
        step = max(1, BLOCK_CELLS // max(1, len(terms)))
        for batch in batches:
            for start in range(0, batch.num_rows if len(terms) else 0, step):
                yield _best(batch.slice(start, step), qids, terms, weights, mean, k)

    return keyword.ranked(counted.mapInArrow(search, dense.FOUND), k)


def _best(part: pa.RecordBatch, qids: list, terms: pa.Array, weights: np.ndarray, mean: float, k: int) -> pa.RecordBatch:
    """The best ``k`` of some rows (id, dl, terms) with any term of the query, for each query."""
    names, dl, lists = np.array(part.column(0).to_pylist()), np.asarray(part.column(1)).astype(np.float64), part.column(2)
    row, cells = np.repeat(np.arange(len(names)), np.asarray(lists.value_lengths())), lists.flatten()
    tf = np.asarray(cells.field(1)).astype(np.float64)
    damped = tf * (scores.K1 + 1) / (tf + scores.K1 * (1 - scores.B + scores.B * dl[row] / mean))
    held = np.zeros((len(names), len(terms)))
    held[row, np.asarray(pc.index_in(cells.field(0), value_set=terms))] = damped
    qid, rid, score = [], [], []
    for q, found in zip(qids, (held @ weights).T):
        any_term = np.flatnonzero(found > 0)
        rounded = np.round(found[any_term], 6)
        near = dense.nearest(names[any_term], rounded, k)
        qid += [q] * len(near)
        rid += names[any_term[near]].tolist()
        score += rounded[near].tolist()
    return pa.RecordBatch.from_pydict(dense.as_hits(qid, rid, score))
