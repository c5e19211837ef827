"""Packing ranked passages into a numbered context within a token budget, as one fold over each query's few candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

# Bounds of a context and the reasons for leaving a passage out.
BUDGET, MOST_PASSAGES, MOST_PER_DOCUMENT = 2600, 8, 4
EMPTY, PASSAGE_CAP, DOCUMENT_CAP, OVER_BUDGET = "empty_text", "passage_cap", "per_document_cap", "token_budget"


def render(marker: Column, label: Column, body: Column) -> Column:
    """[1] label, then the text on the next line."""
    return F.concat(F.lit("["), marker.cast("string"), F.lit("] "), label, F.lit("\n"), body)


def pack_context(ranked: DataFrame, budget: int = BUDGET, most_passages: int = MOST_PASSAGES, most_per_document: int = MOST_PER_DOCUMENT) -> DataFrame:
    """(qid, id, document_id, label, body, rank, marker, drop_reason, truncated, cost) for every row of ranked (qid, id, document_id, label, text, rank).

    In order of rank: blank texts, then passages beyond the cap, then documents beyond theirs, then what does not fit the rest of the
    budget are left out with their reason; smaller passages further down may still fit. If nothing fits, the best that overflowed is cut
    to the budget and marked as truncated. Ties in rank go to the smaller id.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = ranked.select("qid", "id", "document_id", F.coalesce("label", "document_id").alias("label"), body.alias("body"), F.col("rank").cast("int").alias("rank"))
    rows = rows.withColumn("cost", text.token_estimate(render(F.lit(1), F.col("label"), F.col("body"))))
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "document_id", "label", "body", "cost")))
    decided = "array<struct<rank:int,id:string,document_id:string,label:string,body:string,cost:bigint,marker:int,drop_reason:string,truncated:boolean>>"
    begin = F.struct(F.array().cast(decided).alias("done"), F.lit(0).cast("long").alias("spent"), F.lit(0).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        of_document = F.size(F.filter(s["done"], lambda y: y["marker"].isNotNull() & (y["document_id"] == x["document_id"])))
        reason = F.when(x["body"] == "", EMPTY).when(s["taken"] >= most_passages, PASSAGE_CAP).when(of_document >= most_per_document, DOCUMENT_CAP).when(x["cost"] > budget - s["spent"], OVER_BUDGET)
        fits = reason.isNull()
        row = F.struct(
            *[x[c].alias(c) for c in ("rank", "id", "document_id", "label", "body", "cost")], F.when(fits, s["taken"] + 1).cast("int").alias("marker"), reason.alias("drop_reason"), F.lit(False).alias("truncated")
        )
        return F.struct(F.array_append(s["done"], row).alias("done"), (s["spent"] + F.when(fits, x["cost"]).otherwise(0)).alias("spent"), (s["taken"] + fits.cast("int")).alias("taken"))

    folded = rows.groupBy("qid").agg(F.aggregate(items, begin, step).alias("s"))
    first_over = F.array_position(F.transform("s.done", lambda y: y["drop_reason"]), OVER_BUDGET)
    placed = folded.select("qid", F.col("s.taken").alias("n_taken"), first_over.alias("first_over"), F.posexplode("s.done").alias("at", "x")).select("qid", "n_taken", "first_over", "at", "x.*")
    room = budget - (F.col("cost") - text.token_estimate("body"))
    cut = F.trim(text.truncate_to_tokens("body", room))
    shrink = (F.col("n_taken") == 0) & (F.col("at") + 1 == F.col("first_over")) & (room > 0) & (cut != "")
    out = placed.withColumn("_shrink", F.coalesce(shrink, F.lit(False)))
    return out.select(
        "qid", "id", "document_id", "label", F.when(F.col("_shrink"), cut).otherwise(F.col("body")).alias("body"), "rank", F.when(F.col("_shrink"), 1).otherwise(F.col("marker")).alias("marker"),
        F.when(~F.col("_shrink"), F.col("drop_reason")).alias("drop_reason"), F.col("_shrink").alias("truncated"), "cost",
    )


def context_blocks(packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, n_passages, documents, context, token_count, utilisation) of each query with passages."""
    taken = packed.filter("marker is not null")
    parts = F.array_sort(F.collect_list(F.struct("marker", render(F.col("marker"), F.col("label"), F.col("body")).alias("t"), "document_id")))
    out = taken.groupBy("qid").agg(parts.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    out = out.select("qid", F.size("p").alias("n_passages"), F.array_distinct(F.transform("p", lambda x: x["document_id"])).alias("documents"), joined.alias("context"))
    return out.withColumn("token_count", text.token_estimate("context")).withColumn("utilisation", F.bround(F.col("token_count") / budget, 4))
