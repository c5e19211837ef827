"""Answering batches of questions: retrieve, gate, rerank, pack, extract, resolve and verify, one row for each question."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import answer, citations, context, fusion, rerank, scan
from quern.operators.dense import exact_search
from quern.operators.hashing import hash_embed
from quern.operators.keyword import KeywordIndex, search
from quern.session import materialise


@dataclass(frozen=True)
class RagConfig:
    """Every knob of a run, with its usual value."""

    mode: str = "hybrid"
    fusion: str = "rrf"
    dense_k: int = 24
    keyword_k: int = 24
    limit: int = 40
    per_document_hits: int = 0
    rerank: bool = True
    top_n: int = 6
    budget: int = context.BUDGET
    most_passages: int = context.MOST_PASSAGES
    most_per_document: int = context.MOST_PER_DOCUMENT
    gate_score: float = 0.16
    gate_hits: int = 1
    support: float = answer.SUPPORT
    enforce: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))


def retrieve(questions: DataFrame, chunks: DataFrame, c: RagConfig = RagConfig(), index: KeywordIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Fused hits (qid, id, score, contributions, rank) of questions (qid, question) over chunks (id, body, embed_text).

    Vectors are of embed_text, the keyword index is of body. Blank questions find nothing.
    """
    asked = questions.filter(F.trim("question") != "")
    keyword = dense = None
    if c.mode in ("hybrid", "keyword"):
        keyword = search(index, asked, c.keyword_k) if index else scan.keyword_search(chunks, "id", "body", asked, c.keyword_k)
    if c.mode in ("hybrid", "dense"):
        q = hash_embed(asked, "qid", "question").withColumnRenamed("vector", "v")
        dense = scan.embed_search(chunks, "id", "embed_text", q, c.dense_k) if vectors is None else exact_search(vectors, q, c.dense_k)
    return fusion.hybrid(dense, keyword, c.mode, c.fusion, c.weights, c.limit)


def answer_questions(questions: DataFrame, chunks: DataFrame, c: RagConfig = RagConfig(), index: KeywordIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(qid, status, answer, n_citations, coverage, groundedness, passages) for every question.

    chunks: id, document_id, body, embed_text and, if there, title, heading, page_start, page_end. status is ok or why there is no
    answer: no_passages, too_few_passages, weak_match, no_passage_text, empty_context, model_refused or unsupported_answer.
    """
    known = set(chunks.columns)
    chunks = chunks.select(
        F.col("id").cast("string").alias("id"), "document_id", "body", F.coalesce("embed_text", "body").alias("embed_text"), (F.col("title") if "title" in known else F.col("document_id")).alias("title"),
        (F.col("heading") if "heading" in known else F.lit("")).alias("heading"), *[(F.col(p) if p in known else F.lit(None).cast("int")).alias(p) for p in ("page_start", "page_end")],
    )
    hits = materialise(retrieve(questions, chunks, c, index, vectors).withColumn("dense_score", fusion.contribution_of("dense", "score")), "hits")
    gate = fusion.evidence_gate(questions.select("qid"), hits, c.gate_score, c.gate_hits)
    passed = hits.join(gate.filter("status = 'ok'").select("qid"), "qid", "left_semi")
    candidates = rerank.hydrate(passed.select("qid", "id", "rank", "score"), chunks.withColumnRenamed("body", "text"))
    if c.per_document_hits > 0:
        candidates = fusion.cap_by_document(candidates, c.per_document_hits)
    ordered = (rerank.heuristic_rerank(questions, candidates, c.top_n) if c.rerank else rerank.keep_order(candidates, c.top_n)).withColumn("rank", F.col("new_rank"))
    from quern.functions.text import page_label, passage_label

    label = passage_label(F.coalesce(F.nullif("title", F.lit("")), F.col("document_id").cast("string")), page_label(F.col("page_start"), F.col("page_end")), F.col("heading"))
    packed = materialise(context.pack_context(ordered.select("qid", "id", F.col("document_id").cast("string").alias("document_id"), label.alias("label"), "text", "rank"), c.budget, c.most_passages, c.most_per_document), "packed")
    drafted = materialise(answer.extract_answers(questions, packed), "drafts")
    report, cited = citations.resolve(drafted.select("qid", "answer"), packed)
    support = answer.check_support(report.select("qid", "answer"), packed, c.support, c.enforce)
    ground = answer.groundedness(support).withColumnRenamed("qid", "_g")
    n_cited = cited.groupBy(F.col("qid").alias("_c")).agg(F.sum("n").alias("n_citations"))
    held = ordered.groupBy(F.col("qid").alias("_t")).agg(F.count(F.lit(1)).alias("n_texts"))
    fitted = packed.groupBy(F.col("qid").alias("_p")).agg(F.count("marker").alias("n_passages"), F.array_sort(F.collect_list(F.when(F.col("marker").isNotNull(), F.struct("marker", "id")))).alias("passages"))
    out = gate.join(report.withColumnRenamed("qid", "_r"), F.col("qid") == F.col("_r"), "left")
    for other, key in ((ground, "_g"), (n_cited, "_c"), (held, "_t"), (fitted, "_p")):
        out = out.join(other, F.col("qid") == F.col(key), "left")
    status = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce("n_texts", F.lit(0)) == 0, "no_passage_text").when(F.coalesce("n_passages", F.lit(0)) == 0, "empty_context")
        .when(answer.is_insufficient(F.col("answer")), "model_refused").when(F.coalesce("advises_refusal", F.lit(False)), "unsupported_answer").otherwise("ok")
    )
    out = out.withColumn("status", status)
    said = F.col("status") == "ok"
    return out.select(
        "qid", "status", F.when(said, F.col("answer")).otherwise(answer.INSUFFICIENT).alias("answer"), F.when(said, F.coalesce("n_citations", F.lit(0))).otherwise(0).cast("long").alias("n_citations"),
        F.when(said, F.col("coverage")).otherwise(1.0).alias("coverage"), F.when(said, F.col("groundedness")).otherwise(1.0).alias("groundedness"), F.coalesce("passages", F.array().cast("array<struct<marker:int,id:string>>")).alias("passages"),
        answer.explain_refusal(F.col("status"), F.col("n_hits"), F.col("top_score"), c.gate_score).alias("explanation"),
    )
