"""Fusing ranked lists: reciprocal ranks, weighted scores, caps by document, and hybrid retrieval with its diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.keyword import ranked

# Defaults of hybrid retrieval.
RRF_K, LIMIT = 60, 40
WEIGHTS = {"dense": 0.65, "keyword": 0.35}
MODES, FUSIONS = ("hybrid", "dense", "keyword"), ("rrf", "weighted")


def stack(lists: dict[str, DataFrame]) -> DataFrame:
    """(retriever, qid, id, score, rank) of all lists."""
    parts = [df.select(F.lit(name).alias("retriever"), F.col("qid").cast("string").alias("qid"), F.col("id").cast("string").alias("id"), "score", "rank") for name, df in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def _weight(weights: dict[str, float] | None):
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        out = F.when(F.col("retriever") == name, float(w)).otherwise(out)
    return out


def _fused(parts: DataFrame, limit: int | None) -> DataFrame:
    contribution = F.struct("retriever", "rank", "score", "normalised")
    fused = parts.groupBy("qid", "id").agg(F.sum("part").alias("fused"), F.sort_array(F.collect_list(contribution)).alias("contributions"))
    return ranked(fused.withColumnRenamed("fused", "score"), limit)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """(qid, id, score, contributions, rank): the sum of weight / (k + rank) over the lists that hold an id."""
    share = _weight(weights) / (k + F.col("rank"))
    return _fused(stack(lists).withColumn("normalised", share).withColumn("part", share), limit)


def min_max(scores: DataFrame) -> DataFrame:
    """Add ``normalised``: scores of a list between 0 and 1; 1 if they are all equal."""
    w = Window.partitionBy("retriever", "qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("normalised", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def weighted_fusion(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """(qid, id, score, contributions, rank): the weighted sum of min-max scores."""
    return _fused(min_max(stack(lists)).withColumn("part", _weight(weights) * F.col("normalised")), limit)


def fuse(method: str, lists: dict[str, DataFrame], weights: dict[str, float] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """By name; an unknown method raises."""
    if method not in FUSIONS:
        raise ValueError(f"unknown fusion {method!r}; known: {', '.join(FUSIONS)}")
    return reciprocal_rank_fusion(lists, weights=weights, limit=limit) if method == "rrf" else weighted_fusion(lists, weights, limit)


def cap_by_document(hits: DataFrame, most: int, document: str = "document_id") -> DataFrame:
    """Keep the first ``most`` hits of each document in a query's order; 0 or less keeps all. Ranks close up."""
    if most <= 0:
        return hits
    w = Window.partitionBy("qid", document).orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def hybrid(dense: DataFrame | None, keyword: DataFrame | None, mode: str = "hybrid", fusion: str = "rrf", weights: dict[str, float] | None = None, limit: int = LIMIT) -> DataFrame:
    """Fused hits of the lists that the mode asks for; hybrid goes on with one list, another mode without its list raises."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    lists = {name: df for name, df in (("dense", dense), ("keyword", keyword)) if df is not None and mode in ("hybrid", name)}
    if not lists:
        raise ValueError(f"mode {mode!r} has no index to search")
    return fuse(fusion, lists, weights or WEIGHTS, limit)


def contribution_of(name: str, field: str):
    """A retriever's rank or score in a fused hit, null if it has none."""
    return F.get(F.filter("contributions", lambda c: c["retriever"] == name), F.lit(0))[field]


def matched_terms(lists: dict[str, DataFrame]) -> DataFrame:
    """(qid, id, terms): the words by which the lists (qid, id, matched) found an id, each once, in the order of lists and words."""
    parts = [df.select(F.lit(i).alias("at"), F.col("qid").cast("string").alias("qid"), F.col("id").cast("string").alias("id"), F.split("matched", " ").alias("words")) for i, df in enumerate(lists.values())]
    rows = reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    return rows.select("qid", "id", F.array_distinct(F.flatten(F.transform("w", lambda x: x["words"]))).alias("terms"))


def top_dense_score(fused: DataFrame) -> DataFrame:
    """(qid, top_score): the highest cosine among the fused hits; null if no hit came from the dense list."""
    return fused.groupBy("qid").agg(F.max(contribution_of("dense", "score")).alias("top_score"))


def documents_in_order(hits: DataFrame, document: str = "document_id") -> DataFrame:
    """(qid, document, first_rank), each document once."""
    return hits.groupBy("qid", document).agg(F.min("rank").alias("first_rank"))


def diagnostics(lists: dict[str, DataFrame], fused: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, candidates by list..., n_fused, note) for every query."""
    counts = stack(lists).groupBy("qid").agg(*[F.count_if(F.col("retriever") == name).alias(f"n_{name}") for name in lists])
    kept = fused.groupBy("qid").agg(F.count(F.lit(1)).alias("n_fused"))
    base = queries.select(F.col("qid").cast("string").alias("qid"), "question").join(counts, "qid", "left").join(kept, "qid", "left").na.fill(0)
    note = F.when(F.trim("question") == "", "blank query").when(F.col("n_fused") == 0, "no candidates").otherwise("")
    return base.select("qid", *[f"n_{name}" for name in lists], "n_fused", note.alias("note"))


def evidence_gate(queries: DataFrame, hits: DataFrame, minimum_score: float = 0.16, minimum_hits: int = 1) -> DataFrame:
    """(qid, n_hits, top_score, status) for every query; hits (qid, id, dense_score or null).

    no_passages without hits, too_few_passages below the minimum, weak_match if the best dense score is below the minimum, else ok. A null
    best score is not held against the query.
    """
    seen = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"), F.max("dense_score").alias("top_score"))
    out = queries.select("qid").distinct().join(seen, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    status = F.when(F.col("n_hits") == 0, "no_passages").when(F.col("n_hits") < minimum_hits, "too_few_passages").when(F.col("top_score") < minimum_score, "weak_match").otherwise("ok")
    return out.select("qid", "n_hits", "top_score", status.alias("status"))
