"""Exact inner-product search by ball trees, one to a shard, with branch and bound.

Rows are grouped around pivots and groups cut into shards; queries come in blocks. A task meets one block with one shard, both of
bounded size. Blocks meet only groups whose ball can hold a score that one of their queries still needs: a small sample
gives each query a kth score to start from, the group of its highest bound raises it, and the others are searched last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise

#: Rows of a shard, rows of the first sample, queries of a block and rows of a leaf, about; groups at most.
SHARD_ROWS, FIRST_ROWS, BLOCK_QUERIES, LEAF_ROWS, MOST_GROUPS = 8192, 2048, 1024, 128, 512
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def scaled_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int = 1024) -> DataFrame:
    """(id, v array<double>) with v = floor(scale * x) of each component as double: whole numbers of any size, exactly.

    Vectors that are null or hold null or non-finite components (also once they are scaled) are left out, as are null ids.
    """
    x = F.transform(F.col(vector_column), lambda c: c.cast("double") * scale)
    good = F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2**52 on every double is whole.
    units = F.transform(x, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c))
    return table.filter(good).select(F.col(id_column).cast("long").alias("id"), units.alias("v"))


def _float(x) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def _best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def upper_bounds(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius) -> np.ndarray:
    """At least the largest inner product of each query with a point of the ball; rounding and overflow only raise it."""
    with np.errstate(all="ignore"):
        upper = queries @ centre + norms * (radius * (1 + 1e-9)) + 1e-3 + 1e-9 * norms * np.abs(centre).sum(axis=0)
    return np.where(np.isnan(upper), np.inf, upper)


def _norms(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt((vectors**2).sum(axis=1))


class BallTree:
    """Balls over the rows of one shard, halved along their widest spread until ``leaf`` rows are left."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, int, int, np.ndarray | None]] = []
        if len(ids):
            with np.errstate(all="ignore"):
                self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
        radius = float("inf") if np.isnan(radius) else radius
        at = len(self.nodes)
        self.nodes.append((centre, radius, -1, -1, rows))
        if len(rows) > leaf and radius > 0:
            axis = int(points.var(axis=0).argmax())
            order = np.argsort(points[:, axis], kind="stable")
            half = len(rows) // 2
            left = self._build(np.sort(rows[order[:half]]), leaf)
            right = self._build(np.sort(rows[order[half:]]), leaf)
            self.nodes[at] = (centre, radius, left, right, None)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of at most k rows for each query, best first; ``kth`` holds scores that k rows reach (-inf for none) and is raised.

        A node is left for a query if its upper bound is below the query's kth score; equal bounds are searched, as ties
        go to smaller ids.
        """
        n = len(queries)
        queries = queries.astype(np.float64)
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in range(n)]
        if not self.nodes or not n:
            return best
        norms, floor = _norms(queries), np.array([_float(x) for x in kth])
        bounds = lambda node, active: upper_bounds(queries[active], norms[active], self.nodes[node][0], self.nodes[node][1])
        everyone = np.arange(n)
        stack = [(0, everyone, bounds(0, everyone))]
        while stack:
            node, active, upper = stack.pop()
            active = active[upper >= floor[active]]
            if not len(active):
                continue
            _, _, left, right, rows = self.nodes[node]
            if rows is None:
                a, b = bounds(left, active), bounds(right, active)
                # The child that promises more over all goes on top.
                near, far = ((left, a), (right, b)) if a.sum() >= b.sum() else ((right, b), (left, a))
                stack += [(far[0], active, far[1]), (near[0], active, near[1])]
                continue
            scores = exact_products(queries[active], self.vectors[rows])
            for i, row in zip(active, scores):
                keep = np.flatnonzero((row >= kth[i]) & (self.ids[rows] != own[i]))
                if len(keep):
                    s, d = np.concatenate([best[i][0], row[keep]]), np.concatenate([best[i][1], self.ids[rows[keep]]])
                    order = _best_of(s, d, k)
                    best[i] = s[order], d[order]
                    if len(order) == k and best[i][0][-1] > kth[i]:
                        kth[i] = int(best[i][0][-1])
                        floor[i] = _float(kth[i])
        return best


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in floating point or 64 bits where they are exact there, else in integers without bound."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    with np.errstate(all="ignore"):
        bound = np.abs(a).max() * np.abs(b).max(axis=1) * a.shape[1]
    if (bound < 2.0**53).all():
        return (a @ b.T).astype(np.int64)
    if (bound < 2.0**62).all():
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.empty((len(a), len(b)), dtype=object)
    wide = ~(bound < 2.0**62)
    if not wide.all():
        out[:, ~wide] = a.astype(np.int64) @ b[~wide].astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object)
    out[:, wide] = whole(a) @ whole(b[wide]).T
    return out


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of an Arrow column of lists as one array; shorter ones go on with zeros."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    whole = np.zeros((len(lengths), max(width, int(lengths.max()) if len(lengths) else 0)))
    whole[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return whole


_PAIR = "query_id bigint, score bigint, vec_id bigint"


def _meet(k: int):
    """Search one shard for one block: rows (part, id, kth, v), part 0 the queries and 1 the shard's rows.

    A score below 64 bits reads null; one above cannot be given and raises.
    """

    def search(key, table):
        import pyarrow as pa

        part, ids = table.column("part").to_numpy(), table.column("id").to_numpy()
        whole = _matrix(table.column("v"))
        q = np.flatnonzero(part == 0)
        kth = [float("-inf") if x is None else x for x in table.column("kth").take(pa.array(q)).to_pylist()]
        found = BallTree(ids[part == 1], whole[part == 1]).search(whole[q], ids[q], k, kth)
        scores = [int(x) for s, _ in found for x in s]
        if scores and max(scores) > _HIGH:
            raise OverflowError("a score does not fit into 64 bits")
        names = np.concatenate([d for _, d in found]) if found else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": pa.array(np.repeat(ids[q], [len(s) for s, _ in found]), pa.int64()), "score": pa.array([x if x >= _LOW else None for x in scores], pa.int64()), "vec_id": pa.array(names, pa.int64())})

    return search


def _order():
    return [F.col("score").desc_nulls_last(), F.col("vec_id").asc()]


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))).filter(F.col("rank") <= k)


def _kth(best: DataFrame, k: int) -> DataFrame:
    """(query_id, kth) of queries that have k scores."""
    full = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("score").alias("n"))
    return full.filter(F.col("n") >= k).select("query_id", "kth")


def _deal(n) -> F.Column:
    """Deals rows out by id and vector, so that rows of one id do not meet in one shard unless they are equal."""
    return F.pmod(F.xxhash64("id", "v"), n).cast("int")


class _Groups:
    """Pivots, and for each the radius of its rows and the shards that they are cut into; at most ``MOST_GROUPS``."""

    def __init__(self, rows: DataFrame, n_rows: int, width: int):
        wanted = min(MOST_GROUPS, max(1, -(-n_rows // SHARD_ROWS)))
        picked = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
        self.pivots = np.zeros((len(picked), width))
        for i, r in enumerate(picked):
            self.pivots[i, : len(r.v)] = r.v
        self.pivots = np.unique(self.pivots, axis=0)
        self.rows = materialise(self.nearest(rows), "grouped")
        self.radius, self.shards = np.zeros(len(self.pivots)), np.ones(len(self.pivots), dtype=int)
        for r in self.rows.groupBy("grp").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
            self.radius[r.grp], self.shards[r.grp] = r.far, -(-r.n // SHARD_ROWS)

    def nearest(self, table: DataFrame) -> DataFrame:
        """Rows (id, v, ...) with their nearest pivot and how far it is."""
        pivots, names = self.pivots, table.columns

        def assign(batches):
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column("v"), pivots.shape[1])
                with np.errstate(all="ignore"):
                    near = np.nan_to_num((pivots**2).sum(axis=1) - 2 * (x @ pivots.T), nan=np.inf).argmin(axis=1) if len(x) else np.zeros(0, dtype=int)
                    far = _norms(x - pivots[near])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(np.where(np.isnan(far), np.inf, far), pa.float64())], names=[*names, "grp", "far"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
        return table.mapInArrow(assign, kinds + ", grp int, far double")

    def live(self, asked: DataFrame) -> DataFrame:
        """Queries (block, id, kth, v) with every group (target) whose bound reaches their kth score, and its place among them."""
        pivots, radius = self.pivots, self.radius

        def route(batches):
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column("v"), pivots.shape[1])
                upper = upper_bounds(x, _norms(x)[:, None], pivots.T, radius[None, :])
                floor = np.array([float("-inf") if s is None else float(s) for s in batch.column("kth").to_pylist()])
                place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
                at, target = np.nonzero(upper >= floor[:, None])
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(target, pa.int32()), pa.array(place[at, target], pa.int32())], names=[*batch.schema.names, "target", "place"])

        return asked.select("block", "id", "kth", "v").mapInArrow(route, "block int, id bigint, kth bigint, v array<double>, target int, place int")

    def search(self, routed: DataFrame, k: int) -> DataFrame:
        """Best k of each meeting of a block with a shard of a group that one of its queries is routed to."""
        shards = F.element_at(F.array(*[F.lit(int(n)) for n in self.shards]), F.col("target") + 1)
        left = routed.select(F.lit(0).alias("part"), "id", "kth", "v", "block", "target", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
        wanted = routed.groupBy("target").agg(F.collect_set("block").alias("blocks"))
        right = self.rows.join(wanted, F.col("grp") == F.col("target"))
        right = right.select(F.lit(1).alias("part"), "id", F.lit(None).cast("long").alias("kth"), "v", F.explode("blocks").alias("block"), "target", _deal(shards).alias("shard"))
        return left.unionByName(right).groupBy("block", "target", "shard").applyInArrow(_meet(k), _PAIR)


def _blocks(queries: DataFrame) -> DataFrame:
    """Queries with a block of about BLOCK_QUERIES; those of neighbouring groups share one, large groups have several."""
    start, block_of, many = 0, [], []
    for r in sorted(queries.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.grp):  # MOST_GROUPS rows
        own = max(1, r.n // BLOCK_QUERIES)
        block_of += [F.lit(r.grp), F.lit(start // BLOCK_QUERIES)]
        many += [F.lit(r.grp), F.lit(own)]
        start += r.n
    if not block_of:
        return queries.withColumn("block", F.lit(0))
    block = F.create_map(*block_of)[F.col("grp")] + _deal(F.create_map(*many)[F.col("grp")])
    return queries.withColumn("block", block.cast("int"))


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of highest inner product, ties to the smaller id.

    Both tables are (id long, v array<double> of whole numbers), as of :func:`scaled_vectors`. A row whose id is the query's own is not a
    candidate; a query with fewer candidates gets all. Products are exact for components of any size; an answer whose score does
    not fit into 64 bits raises. Vectors of unequal length meet as if the shorter went on with zeros. Repeated
    rows are candidates each; repeated query rows share their id's answer only if their vectors agree. Empty tables give an empty result.
    """
    plain = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    rows, queries = materialise(plain(rows), "vectors"), materialise(plain(queries).distinct(), "queries")
    n_rows, n_queries = rows.count(), queries.count()
    if not n_rows or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = rows.select(F.max(F.size("v"))).union(queries.select(F.max(F.size("v")))).agg(F.max("max(size(v))")).first()[0]
    groups = _Groups(rows, n_rows, width)
    asked = materialise(_blocks(materialise(groups.nearest(queries), "near-queries")).select("id", "v", "block"), "blocks")
    # A sample that all queries meet gives them a kth score to start from.
    sampled = rows.filter(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(max(1, n_rows // FIRST_ROWS))) == 0)
    none = F.lit(None).cast("long").alias("kth")
    every = F.explode(F.sequence(F.lit(0), F.lit(asked.agg(F.max("block")).first()[0]))).alias("block")
    opening = asked.select(F.lit(0).alias("part"), "id", none, "v", "block").unionByName(sampled.select(F.lit(1).alias("part"), "id", none, "v", every))
    kth = _kth(_best(opening.groupBy("block").applyInArrow(_meet(k), _PAIR), k), k)
    found = None
    # Then the group of the highest bound, then all others that can still hold an answer.
    for place in ("place = 0", "place > 0"):
        kth = materialise(kth, "kth")
        started = asked.join(kth, F.col("id") == F.col("query_id"), "left")
        routed = materialise(groups.live(started).filter(place), "routed")
        part = materialise(groups.search(routed, k), "found")
        found = part if found is None else found.unionByName(part)
        kth = _kth(_best(found, k), k)
    answer = _best(found, k)
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score does not fit into 64 bits")).cast("long")).otherwise(F.col("score"))
    return answer.select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))
