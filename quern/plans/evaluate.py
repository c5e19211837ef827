"""Retrieval and answer metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(questions: DataFrame, ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(qid, n_relevant, recall, reciprocal_rank, recall_at_k...) of each question; 1 where nothing is relevant."""
    n = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    found = ranked.join(relevant, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("_found"), F.min("rank").alias("_first"), *[F.count_if(F.col("rank") <= k).alias(f"_at_{k}") for k in cuts])
    out = questions.select("qid").distinct().join(n, "qid", "left").join(found, "qid", "left").na.fill(0, ["n_relevant", "_found", *[f"_at_{k}" for k in cuts]])
    share = lambda c: F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.bround(F.col(c) / F.col("n_relevant"), 6))
    first = F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.coalesce(F.bround(1 / F.col("_first"), 6), F.lit(0.0)))
    return out.select("qid", "n_relevant", share("_found").alias("recall"), first.alias("reciprocal_rank"), *[share(f"_at_{k}").alias(f"recall_at_{k}") for k in cuts])


def summary(metrics: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over the questions."""
    return metrics.agg(*[F.bround(F.avg(f"recall_at_{k}"), 4).alias(f"recall_at_{k}") for k in cuts], F.bround(F.avg("reciprocal_rank"), 4).alias("mrr"))


def answer_metrics(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """One row over answers (qid, status, coverage, groundedness) and expected (qid, answerable): groundedness and coverage of what was
    answered, answer_rate of the answerable, refusal_accuracy of the others."""
    said = F.col("status") == "ok"
    joined = answers.join(expected, "qid")
    return joined.agg(
        F.bround(F.avg(F.when(said, F.col("groundedness"))), 4).alias("groundedness"), F.bround(F.avg(F.when(said, F.col("coverage"))), 4).alias("coverage"),
        F.bround(F.avg(F.when(F.col("answerable"), said.cast("int"))), 4).alias("answer_rate"), F.bround(F.avg(F.when(~F.col("answerable"), (~said).cast("int"))), 4).alias("refusal_accuracy"),
    )
