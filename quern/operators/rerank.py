"""Reranking of retrieved passages: explainable lexical signals, or a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.functions.stem import stem_list
from quern.operators.terms import query_terms
from quern.session import materialise

MOST_CHARS = 4000


def hydrate(hits: DataFrame, chunks: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """Hits with the text (and other columns) of their chunks; chunks that are gone or blank drop out."""
    known = chunks.filter(F.trim(F.col(text_column)) != "").withColumn(id_column, F.col(id_column).cast("string"))
    return hits.join(known, id_column)


def heading_or_path(heading: Column, path: Column) -> Column:
    """The label of a passage: its heading, or its section path where that is missing or empty."""
    return F.coalesce(F.nullif(heading, F.lit("")), F.array_join(path, " > "), F.lit(""))


def _reorder(scored: DataFrame, top_n: int | None) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col("rank").asc(), F.col("id").asc())
    out = scored.withColumn("new_rank", F.row_number().over(w)).withColumn("movement", F.col("rank") - F.col("new_rank"))
    return out if top_n is None else out.filter(F.col("new_rank") <= top_n)


def signals(queries: DataFrame, candidates: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """Candidates (qid, id, rank, text, heading) with coverage, proximity, phrase, heading_overlap and prior."""
    found = materialise(candidates, "candidates")
    found = found.withColumn("p_terms", stem_list(text.content_tokens(F.substring("text", 1, most_chars)))).withColumn("h_terms", stem_list(text.tokens("heading")))
    joined = found.join(query_terms(queries).withColumnRenamed("terms", "q_terms"), "qid")
    q, p = F.col("q_terms"), F.col("p_terms")
    return joined.select(
        *candidates.columns, scores.term_coverage(q, p).alias("coverage"), scores.proximity(q, p).alias("proximity"), scores.phrase_overlap(q, p).alias("phrase"),
        F.bround(scores.containment(q, F.col("h_terms")), 4).alias("heading_overlap"), scores.rank_prior(F.col("rank")).alias("prior"),
    )


def heuristic_rerank(queries: DataFrame, candidates: DataFrame, top_n: int | None = 6, weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates with their signals, rerank_score, new_rank and movement; a blank question keeps the prior order.

    The score is the weighted sum of the signals to six places; ties go to the better prior rank.
    """
    w = weights or scores.RERANK_WEIGHTS
    scored = signals(queries, candidates)
    blank = queries.select(F.col("qid").alias("_q"), (F.trim("question") == "").alias("_blank"))
    total = w["coverage"] * F.col("coverage") + w["proximity"] * F.col("proximity") + w["phrase"] * F.col("phrase") + w["heading"] * F.col("heading_overlap") + w["prior"] * F.col("prior")
    scored = scored.join(blank, F.col("qid") == F.col("_q")).withColumn("rerank_score", F.when(F.col("_blank"), F.col("prior")).otherwise(F.bround(total, 6)))
    return _reorder(scored.drop("_q", "_blank"), top_n)


def keep_order(candidates: DataFrame, top_n: int | None = 6) -> DataFrame:
    """No reranking."""
    return _reorder(candidates.withColumn("rerank_score", scores.rank_prior(F.col("rank"))), top_n)


def model_rerank(queries: DataFrame, candidates: DataFrame, predict: Callable[[Sequence[tuple[str, str]]], Sequence[float]], top_n: int | None = 6, most_chars: int = 1600) -> DataFrame:
    """Order by ``predict(pairs of question and passage)``, a cross-encoder of the caller's, called on Arrow batches."""
    pairs = candidates.join(queries.select("qid", "question"), "qid").withColumn("_p", F.substring("text", 1, most_chars))

    import pandas as pd

    def run(q, p):
        return pd.Series([float(x) for x in predict(list(zip(q, p)))])

    score = F.pandas_udf(run, "double")
    return _reorder(pairs.withColumn("rerank_score", score("question", "_p")).drop("question", "_p"), top_n)


def rated_rerank(candidates: DataFrame, ratings: DataFrame, top_n: int | None = 6) -> DataFrame:
    """Order by ratings (qid, id, rating 0 to 10) of an outside judge; missing ones get their query's mean, and a query with
    fewer than half of its candidates rated keeps its order."""
    w = Window.partitionBy("qid")
    joined = candidates.join(ratings.select("qid", "id", "rating"), ["qid", "id"], "left")
    rated = F.count("rating").over(w) * 2 >= F.count(F.lit(1)).over(w)
    score = F.when(rated, F.coalesce("rating", F.avg("rating").over(w))).otherwise(scores.rank_prior(F.col("rank")))
    return _reorder(joined.withColumn("rerank_score", score).drop("rating"), top_n)


def parse_ratings(replies: DataFrame) -> DataFrame:
    """(qid, label, rating) from replies (qid, reply): a JSON object of label to number, else "label: number" lines; held to 0..10."""
    as_map = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "map<string,string>")
    lines = F.map_from_entries(F.array_distinct(F.transform(F.regexp_extract_all("reply", F.lit(r"(?m)^\s*\[?(\d+)\]?\s*[:=-]\s*(-?\d+(?:\.\d+)?)"), 0), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).alias("key"), F.regexp_extract(x, r"[:=-]\s*(-?\d+(?:\.\d+)?)\s*$", 1).alias("value")))))
    found = F.when(as_map.isNotNull() & (F.size(as_map) > 0), as_map).otherwise(lines)
    return replies.select("qid", F.explode(found).alias("label", "_r")).select("qid", "label", F.expr("try_cast(_r as double)").alias("_r")).filter("_r is not null").select("qid", "label", F.greatest(F.lit(0.0), F.least(F.lit(10.0), "_r")).alias("rating"))
