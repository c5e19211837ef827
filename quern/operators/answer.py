"""Extractive answers from numbered passages, and the check of every sentence against its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.functions.stem import stem_list, stem_word
from quern.operators import citations
from quern.session import materialise

# Thresholds of extraction and support, the refusal sentence, and words that only connect.
MIN_OVERLAP, DUPLICATE, FLOOR_RATIO, MOST_SENTENCES, MOST_TOKENS = 0.30, 0.80, 0.55, 4, 900
SUPPORT, MARGIN = 0.32, 0.25
INSUFFICIENT = "The available documents do not contain enough information to answer this question."
INSUFFICIENT_FRAGMENT = "do not contain enough information"
DISCOURSE = "also consequently conversely furthermore however meanwhile moreover nevertheless nonetheless overall similarly therefore thus".split()
DISCOURSE_STEMS = sorted(map(stem_word, DISCOURSE))


def sentence_candidates(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, marker, pos, sentence, terms, tokens, score) of each sentence of passages (qid, marker, body)."""
    told = passages.filter("marker is not null").select("qid", "marker", F.posexplode(text.sentences("body")).alias("pos", "sentence"))
    asked = queries.select("qid", stem_list(text.content_tokens("question")).alias("q"))
    joined = told.withColumn("terms", stem_list(text.content_tokens("sentence"))).join(asked, "qid")
    return joined.select("qid", "marker", "pos", "sentence", "terms", text.token_estimate("sentence").alias("tokens"), scores.sentence_score(F.col("q"), F.col("terms"), F.col("marker")).alias("score"))


def extract_answers(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, answer, n_sentences) for every query: cited sentences of its passages, or the refusal sentence.

    Sentences of 0.30 or more, best first, until four are taken or the score falls below 0.55 of the best; those that repeat a taken
    one (Jaccard 0.80 of stems) are passed over. The answer follows the order of the passages.
    """
    good = sentence_candidates(queries, passages).filter(F.col("score") >= MIN_OVERLAP)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "marker", "pos", "sentence", "terms", "tokens", "score")))
    item = "struct<key:double,marker:int,pos:int,sentence:string,terms:array<string>,tokens:bigint,score:double>"
    begin = F.struct(F.array().cast(f"array<{item}>").alias("taken"), F.lit(0).cast("long").alias("spent"), F.lit(True).alias("open"))
    grouped = good.groupBy("qid").agg(order.alias("c"))
    floor = F.greatest(F.lit(MIN_OVERLAP), F.col("c")[0]["score"] * FLOOR_RATIO)

    def step(s: Column, x: Column) -> Column:
        ends = ~s["open"] | (F.size(s["taken"]) >= MOST_SENTENCES) | (x["score"] < floor)
        repeats = F.exists(s["taken"], lambda t: scores.jaccard(t["terms"], x["terms"]) >= DUPLICATE)
        cost = x["tokens"] + 4
        over = (s["spent"] + cost > MOST_TOKENS) & (F.size(s["taken"]) > 0)
        take = ~ends & ~repeats & ~over
        return F.struct(F.when(take, F.array_append(s["taken"], x)).otherwise(s["taken"]).alias("taken"), (s["spent"] + F.when(take, cost).otherwise(0)).alias("spent"), (~ends & (repeats | ~over)).alias("open"))

    taken = grouped.select("qid", F.aggregate("c", begin, step, lambda s: s["taken"]).alias("t"))
    ordered = F.array_sort(F.transform("t", lambda x: F.struct(x["marker"].alias("m"), x["pos"].alias("p"), text.cite(x["sentence"], x["marker"]).alias("s"))))
    said = taken.select(F.col("qid").alias("_q"), F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("_a"), F.size("t").alias("_n"))
    return queries.select("qid").distinct().join(said, F.col("qid") == F.col("_q"), "left").select("qid", F.coalesce("_a", F.lit(INSUFFICIENT)).alias("answer"), F.coalesce("_n", F.lit(0)).alias("n_sentences"))


def is_insufficient(answer: Column) -> Column:
    """Whether an answer only says that the documents do not suffice."""
    t = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return t.contains(INSUFFICIENT_FRAGMENT) & ~t.contains("[") & (F.length(t) <= len(INSUFFICIENT) + 40)


def check_support(answers: DataFrame, passages: DataFrame, threshold: float = SUPPORT, enforce: bool = True, margin: float = MARGIN) -> DataFrame:
    """(qid, pos, sentence, is_claim, cited, best_marker, best_score, cited_score, score, supported, misattributed) of each answer sentence.

    A sentence is scored by the share of its stems that a passage holds. A claim is supported if a passage that it cites reaches the
    threshold; without a citation it is not when ``enforce``, else if any passage does. The first passage wins ties and must score
    above 0. Sentences with only connecting words are no claims and count as supported.
    """
    said = answers.select("qid", F.posexplode(citations.cited_sentences("answer")).alias("pos", "sentence"))
    said = said.withColumn("s_terms", stem_list(text.content_tokens(citations.strip_markers("sentence")))).withColumn("found", citations.markers("sentence"))
    said = materialise(said, "answer-sentences")
    shown = passages.filter("marker is not null").withColumn("p_terms", stem_list(text.content_tokens("body")))
    known = shown.groupBy("qid").agg(F.collect_set("marker").alias("known"))
    rows = said.join(known, "qid", "left").withColumn("cited", F.array_sort(F.array_intersect("found", F.coalesce("known", F.array().cast("array<int>")))))
    pairs = rows.join(shown.select("qid", "marker", "p_terms"), "qid", "left").withColumn("overlap", F.coalesce(scores.containment(F.col("s_terms"), F.col("p_terms")), F.lit(0.0)))
    best = F.max(F.struct("overlap", (-F.col("marker")).alias("m")))
    agg = pairs.groupBy("qid", "pos").agg(best.alias("b"), F.max(F.when(F.array_contains("cited", F.col("marker")), F.col("overlap"))).alias("cited_score"))
    out = rows.join(agg, ["qid", "pos"])
    out = out.withColumn("best_score", F.col("b.overlap")).withColumn("best_marker", F.when(F.col("b.overlap") > 0, -F.col("b.m")))
    has = F.size("cited") > 0
    claim = F.exists("s_terms", lambda t: ~t.isin(DISCOURSE_STEMS))
    fine = F.when(has, F.col("cited_score") >= threshold).when(F.lit(enforce), False).otherwise(F.col("best_score") >= threshold)
    wrong = claim & has & (F.col("best_score") - F.col("cited_score") >= margin)
    return out.select("qid", "pos", "sentence", claim.alias("is_claim"), "cited", "best_marker", F.bround("best_score", 6).alias("best_score"), F.bround("cited_score", 6).alias("cited_score"),
                      F.bround(F.when(has, F.col("cited_score")).otherwise(F.col("best_score")), 6).alias("score"), (~claim | fine).alias("supported"), wrong.alias("misattributed"))


def groundedness(support: DataFrame) -> DataFrame:
    """(qid, n_claims, n_supported, groundedness, advises_refusal): supported claims over claims (1 without claims); refusal if no
    claim finds anything in any passage."""
    w = support.groupBy("qid").agg(F.count_if("is_claim").alias("n_claims"), F.count_if(F.col("is_claim") & F.col("supported")).alias("n_supported"), F.max(F.when(F.col("is_claim"), F.col("best_score"))).alias("_best"))
    return w.select("qid", "n_claims", "n_supported", F.when(F.col("n_claims") == 0, 1.0).otherwise(F.bround(F.col("n_supported") / F.col("n_claims"), 4)).alias("groundedness"), (F.coalesce("_best", F.lit(1.0)) <= 0).alias("advises_refusal"))


def history_window(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` user and assistant turns of each conversation, with their place from 1."""
    w = Window.partitionBy("conv_id")
    recent = turns.filter("role in ('user', 'assistant')").withColumn("_back", F.row_number().over(w.orderBy(F.col("turn").desc()))).filter(F.col("_back") <= n).drop("_back")
    return recent.withColumn("place", F.row_number().over(w.orderBy("turn")))


def explain_refusal(status: Column, n: Column, score: Column, threshold: float = 0.16) -> Column:
    """One sentence for each reason to give no answer."""
    return (
        F.when(status == "no_passages", "No passage matched the question.")
        .when(status == "too_few_passages", F.format_string("Only %d passages matched the question.", n))
        .when(status == "weak_match", F.format_string("The best match scores %.2f, below the minimum of %.2f.", score, F.lit(threshold)))
        .when(status == "no_passage_text", "The passages that matched have no text.")
        .when(status == "empty_context", "No passage fits into the context.")
        .when(status == "model_refused", INSUFFICIENT)
        .when(status == "unsupported_answer", "The answer could not be verified against the passages.")
        .otherwise("")
    )
