"""Nearest neighbours by cosine for batches of queries.

Exact search multiplies the queries with blocks of rows in Arrow functions; each task keeps the best of its block, and a
window over those few picks each query's best. Queries go to the rows where these are read; only if there are too many of
them for that, both are dealt out by blocks. The form with random hyperplanes scores the rows that share
a bucket first, then all others that a bound from the signs does not exclude: it finds what the exact search finds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.keyword import ranked

#: Rows of a block and queries of a block, about.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 1024
#: Components of a block of rows, and of the queries that all tasks are handed, at most.
BLOCK_CELLS, HANDED_CELLS = 1 << 21, 1 << 22
#: Queries that meet a block's rows, or its signs, at a time.
QUERIES_AT_ONCE = 128
PROBES_AT_ONCE = 64
FOUND = "qid string, id string, score double"


def nearest(names: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to the smaller name."""
    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2
    near = np.flatnonzero(row >= least)
    return near[np.lexsort((names[near], -row[near]))][:k]


def _all_rows(asked: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int):
    """(positions, scores) of the best rows for each query, from all products."""
    for start in range(0, len(asked), QUERIES_AT_ONCE):
        for row in np.round(np.clip(asked[start : start + QUERIES_AT_ONCE] @ rows.T, -1, 1), 6):
            near = nearest(names, row, k)
            yield near, row[near]


def _probes(tables: int, bits: int, seed: int):
    """Like :func:`_all_rows`, by ``tables`` hashes of ``bits`` signs against orthonormal planes.

    A unit row on the other side than the query q of planes p in S has a cosine of sqrt(1 - sum over S of (q . p)^2) at most. Rows
    that share a bucket in any table are scored first; then those whose bound in every table reaches the kth score.
    """

    def search(asked: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int):
        size = rows.shape[1]
        planes = np.random.default_rng(seed).normal(size=(tables, size, min(bits, size)))
        planes = np.linalg.qr(planes)[0]
        sides = [rows @ p > 0 for p in planes]
        for start in range(0, len(asked), PROBES_AT_ONCE):
            block = asked[start : start + PROBES_AT_ONCE]
            shared, lost = np.zeros((len(block), len(rows)), dtype=bool), np.zeros((len(block), len(rows)))
            for p, side in zip(planes, sides):
                c = block @ p
                own = c > 0
                differ = lambda w: (w * own).sum(axis=1)[:, None] + (w * (1 - 2 * own)) @ side.T.astype(float)
                shared |= differ(np.ones_like(c)) < 0.5
                np.maximum(lost, differ(c**2), out=lost)
            bound = np.sqrt(np.maximum(0, 1 - lost)) + 2e-6  # scores are rounded to six places
            for q, first, most in zip(block, shared, bound):
                score = np.full(len(rows), -2.0)
                product = lambda at: np.round(np.clip(rows[at] @ q, -1, 1), 6)
                score[first] = product(first)
                kth = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -2
                rest = ~first & (most >= kth)
                score[rest] = product(rest)
                near = nearest(names, score, k)
                yield near, score[near]

    return search


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of ``width`` or the longest's, zeros behind; null numbers are NaN."""
    lengths = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(lists), max(width, lengths.max(initial=0))))
    flat = np.asarray(pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")))
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _unit(whole: np.ndarray) -> np.ndarray:
    length = np.sqrt((whole**2).sum(axis=1, keepdims=True))
    return np.divide(whole, length, out=np.zeros_like(whole), where=length > 0)


def as_hits(qid: list, rid: list, score: list) -> dict:
    return {"qid": pa.array(qid, pa.string()), "id": pa.array(rid, pa.string()), "score": pa.array(score, pa.float64())}


def _hits(qids: list, asked: np.ndarray, ids: list, rows: np.ndarray, k: int, best) -> dict:
    """The best ``k`` of some rows for each query."""
    qid, rid, score = [], [], []
    names = np.array(ids)
    for q, (near, found) in zip(qids, best(asked, rows, names, k)):
        qid += [q] * len(near)
        rid += names[near].tolist()
        score += found.tolist()
    return as_hits(qid, rid, score)


def _block_search(k: int, best):
    def search(table):
        part = np.asarray(table.column("part"))
        ids = table.column("id").to_pylist()
        q, r = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        if not (len(q) and len(r)):
            return pa.table(as_hits([], [], []))
        whole = _unit(_matrix(table.column("v").combine_chunks()))
        return pa.table(_hits([ids[i] for i in q], whole[q], [ids[i] for i in r], whole[r], k, best))

    return search


def handed(queries: DataFrame):
    """What all tasks are handed of queries (qid, v), as a broadcast: names and vectors. None if there are too many of them for that."""
    asked = _good(queries.select(F.col("qid").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")))
    if asked.agg(F.coalesce(F.count(F.lit(1)) * F.max(F.size("v")), F.lit(0))).first()[0] > HANDED_CELLS:
        return None
    table = asked.toArrow()
    return queries.sparkSession.sparkContext.broadcast((table.column("id").to_pylist(), _matrix(table.column("v").combine_chunks())))


def handed_search(handed, k: int):
    """Of batches (id, v), the best ``k`` of each block of rows for each query."""

    def blocks(batches, width: int):
        """Batches cut where they are too large, and gathered where they are small."""
        held, cells = [], 0
        for batch in batches:
            widest = max(1, width, np.asarray(batch.column(1).value_lengths()).max(initial=0))
            step = max(1, BLOCK_CELLS // widest)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                if held and cells + part.num_rows * widest > BLOCK_CELLS:
                    yield held
                    held, cells = [], 0
                held.append(part)
                cells += part.num_rows * widest
        if held:
            yield held

    def search(batches):
        qids, queries = handed.value
        if not qids:
            return
        for held in blocks(batches, queries.shape[1]):
            part = pa.Table.from_batches(held).combine_chunks()
            rows = _matrix(part.column(1).chunk(0), queries.shape[1])
            good = np.flatnonzero(np.isfinite(rows).all(axis=1))
            if len(good):
                asked = np.pad(queries, ((0, 0), (0, rows.shape[1] - queries.shape[1])))
                yield pa.RecordBatch.from_pydict(_hits(qids, _unit(asked), part.column(0).take(pa.array(good)).to_pylist(), _unit(rows[good]), k, _all_rows))

    return search


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 24, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` rows of highest cosine for queries (qid, v) against vectors (id, v).

    Negative scores count; ties go to the smaller id as text. Rows without a vector or with null or non-finite
    components are left out. ``allowed`` (id), if given, restricts the rows: an empty one finds nothing.
    """
    held = handed(queries)
    if held is None:
        return _search(vectors, queries, k, allowed, _all_rows)
    single = vectors.schema["v"].dataType.simpleString() in ("array<float>", "array<double>")
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("v") if single else F.col("v").cast("array<double>").alias("v")).filter("v is not null")
    return ranked(_allowed(rows, allowed).mapInArrow(handed_search(held, k), FOUND), k)


def _good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _allowed(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return rows if allowed is None else rows.join(allowed.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")


def _search(vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None, best) -> DataFrame:
    rows = _allowed(_good(vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v"))), allowed)
    asked = _good(queries.select(F.col("qid").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")))
    n_rows, n_cells, n_asked = *rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first(), asked.count()
    shards, blocks = max(1, -(-n_rows // BLOCK_ROWS), -(-n_cells // BLOCK_CELLS)), max(1, -(-n_asked // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.lit(0).alias("part"), "id", "v", deal(blocks).alias("block"), every(shards).alias("shard"))
    right = rows.select(F.lit(1).alias("part"), "id", "v", every(blocks).alias("block"), deal(shards).alias("shard"))
    found = left.unionByName(right).groupBy("block", "shard").applyInArrow(_block_search(k, best), FOUND)
    return ranked(found, k)


def hyperplane_search(vectors: DataFrame, queries: DataFrame, k: int = 24, tables: int = 24, bits: int = 7, seed: int = 5) -> DataFrame:
    """(qid, id, score, rank), equal to :func:`exact_search`, by ``tables`` hashes of ``bits`` signs of random hyperplanes.

    Rows that share no bucket with the query are left out only where their signs prove that they score below the kth. Where
    neighbours are far (a kth cosine of 0.3, say) no signs can prove that, and all rows are scored.
    """
    return _search(vectors, queries, k, None, _probes(tables, bits, seed))
