"""The registered queries: one for each operator that runs over the given tables, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.functions.stem import stem_list, stem_vocabulary
from quern.operators import answer, chunking, citations, context, dense, fusion, hashing, keyword, prompts, records, rerank, tables
from quern.operators.terms import query_terms
from quern.session import materialise, spread
from quern.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))


# Text ----------------------------------------------------------------------------------------------------------------


def _per_doc(name: str, columns: Callable[[], list]) -> None:
    QUERIES[name] = lambda spark, d: docs(spark, d).select("doc_id", *columns())


_size = lambda c: F.size(c).cast("long")


def _list_sizes(name: str, found: Callable, column: str) -> None:
    """Sizes of a list that is made once: an explode of one row keeps the optimizer from writing it twice."""
    QUERIES[name] = lambda spark, d: docs(spark, d).select("doc_id", F.explode(F.array(found("text"))).alias("t")).select("doc_id", _size(F.col("t")).alias(column), _size(F.array_distinct("t")).alias("n_distinct"))


_list_sizes("token_stats", text.tokens, "n_tokens")
_list_sizes("content_token_stats", text.content_tokens, "n_content")
_per_doc("token_estimate", lambda: [text.token_estimate("text").alias("tokens")])
_per_doc("truncate_to_tokens", lambda: [F.md5(text.truncate_to_tokens("text", 100)).alias("digest")])
_per_doc("clean_text_fingerprint", lambda: [F.md5(text.clean_text("text")).alias("digest"), F.length(text.clean_text("text")).cast("long").alias("n")])
_lines = lambda: F.split(F.col("text"), "\n", -1)
_per_doc("doc_text_stats", lambda: [F.length("text").cast("long").alias("n_chars"), _size(text.words("text")).alias("n_words"), _size(_lines()).alias("n_lines"), _size(text.paragraphs("text")).alias("n_paragraphs")])
_per_doc("snippets", lambda: [text.snippet("text").alias("snippet")])
_per_doc("slugs", lambda: [text.slug("text").alias("slug")])
_per_doc("legibility", lambda: [F.bround(text.legibility("text"), 6).alias("share")])
_per_doc("page_furniture", lambda: [_size(text.strip_furniture(_lines())).alias("n_kept")])
_per_doc("sentence_stats", lambda: [_size(text.raw_sentences("text")).alias("n_sentences"), F.md5(F.array_join(text.raw_sentences("text"), "\n")).alias("digest")])
_per_doc("sentence_counts", lambda: [_size(text.sentences("text")).alias("n_sentences")])
_per_doc("human_sizes", lambda: [text.human_size(F.octet_length("text")).alias("size")])
_per_doc("redact_text", lambda: [F.md5(text.redact("text")).alias("digest"), (text.redact("text") != F.col("text")).alias("changed")])
_marked = lambda: F.concat(F.coalesce("text", F.lit("")), F.lit(" Both agree [1, 3], see [2][1] ."))
_per_doc("strip_markers", lambda: [F.md5(citations.strip_markers(_marked())).alias("digest")])
_payload = lambda: F.from_json(F.to_json(F.struct("source", "lang", "n_chars")), "source string, lang string, n_chars bigint")
_per_doc("json_payload", lambda: [_payload()["source"].alias("source"), _payload()["lang"].alias("lang")])


@query
def stem_vocab(spark, d):
    return stem_vocabulary(docs(spark, d).select(F.explode(text.tokens("text")).alias("token")))


@query
def source_rollup(spark, d):
    n = F.length("text").cast("long")
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_chars"), F.min(n).alias("least"), F.max(n).alias("most"), F.bround(F.avg(n), 4).alias("mean"))


@query
def marker_counts(spark, d):
    return citations.marker_counts(docs(spark, d).withColumn("t", _marked()), "doc_id", "t")


@query
def heading_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(_lines()).alias("line_no", "line"))
    return lines.filter(files.is_plain_heading(F.col("line")))


@query
def front_matter(spark, d):
    made = F.concat(F.lit("---\ntitle: "), "source", F.lit("\nlanguage: '"), "lang", F.lit("'\n---\n"), "text")
    split = docs(spark, d).select("doc_id", files.front_matter(made).alias("f"), files.without_front_matter(made).alias("b"))
    return split.select("doc_id", F.col("f")["title"].alias("title"), F.col("f")["language"].alias("language"), F.md5("b").alias("body"))


@query
def upload_names(spark, d):
    kinds = F.array(*map(F.lit, ("pdf", "docx", "txt", "md", "exe", "html", "csv")))
    raw = F.concat(F.lit("../up\\"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("."), F.element_at(kinds, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")))
    name = files.safe_name(raw)
    return docs(spark, d).select("doc_id", name.alias("name"), files.extension(name).alias("extension"), (files.refusal(name) == "").alias("allowed"), files.refusal(name).alias("reason"))


@query
def repeated_lines(spark, d):
    lines = docs(spark, d).select("source", "doc_id", F.explode(_lines()).alias("line"))
    return tables.repeated_lines(lines, "source", "doc_id", "line", share=0.05)


# Keyword search --------------------------------------------------------------------------------------------------------


_INDEXES: dict[tuple, keyword.KeywordIndex] = {}


def _index(spark, d, **options) -> keyword.KeywordIndex:
    """The index over a folder's documents, built once for all queries of an application."""
    key = (spark.sparkContext.applicationId, d, *sorted(options.items()))
    if key not in _INDEXES:
        _INDEXES[key] = keyword.build_index(docs(spark, d), "doc_id", "text", **options)
    return _INDEXES[key]


def _bm25(spark, d, k=10, **options) -> DataFrame:
    return keyword.search(_index(spark, d), asked(spark, d), k, **options)


def _top(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query
def term_df(spark, d):
    return keyword.term_frequencies(_index(spark, d))


@query
def index_stats(spark, d):
    return keyword.index_stats(_index(spark, d))


@query
def bm25_topk_raw(spark, d):
    raw = {"stemmed": False, "content": False}
    return _top(keyword.search(_index(spark, d, **raw), asked(spark, d), 10, **raw))


@query
def bm25_topk(spark, d):
    return _top(_bm25(spark, d))


@query
def fts_topk(spark, d):
    return _top(_bm25(spark, d, idf="textbook"))


@query
def bm25_filtered(spark, d):
    good = tables.filtered(table(spark, d, "labels"), {"quality": 1}).select(F.col("doc_id").alias("id"))
    return _top(_bm25(spark, d, allowed=good))


# Dense search ----------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v"), "label", "vec_id")


def _dense(spark, d, k=10, allowed=None) -> DataFrame:
    v = _vectors(spark, d)
    return dense.exact_search(v.select("id", "v"), v.filter("vec_id % 50 = 0").select(F.col("id").alias("qid"), "v"), k, allowed)


@query
def dense_topk(spark, d):
    return _top(_dense(spark, d))


@query
def dense_filtered(spark, d):
    return _top(_dense(spark, d, allowed=tables.filtered(_vectors(spark, d), {"label": [1, 2]}).select("id")))


@query
def ann_lsh(spark, d):
    v = _vectors(spark, d)
    return _top(dense.hyperplane_search(v.select("id", "v"), v.filter("vec_id % 50 = 0").select(F.col("id").alias("qid"), "v"), 10))


@query
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.bround(scores.norm(F.col("embedding")), 6).alias("norm"))


@query
def similarity_bands(spark, d):
    # Scores have six places already; half of one more than them is exact, and rounding it again would only meet ties.
    return _dense(spark, d).select("qid", "id", ((F.col("score") + 1) / 2).alias("confidence"), scores.band(F.col("score")).alias("band"))


@query
def evidence_gate(spark, d):
    found = _dense(spark, d)
    return fusion.evidence_gate(found.select("qid").distinct(), found.filter("qid <> id").withColumnRenamed("score", "dense_score"))


@query
def hash_features(spark, d):
    features = hashing.hash_features(docs(spark, d), "doc_id", "text", most_gram_tokens=None)
    return features.groupBy("doc_id", F.substring("feature", 1, 1).alias("family")).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n"))


@query
def hash_embed(spark, d):
    v = hashing.hash_embed(docs(spark, d), "doc_id", "text", most_gram_tokens=None)
    return v.select("doc_id", F.bround(scores.norm(F.col("vector")), 4).alias("norm"), F.size(F.filter("vector", lambda x: x != 0)).alias("n_cells"))


@query
def explain_vector(spark, d):
    return hashing.explain_vector(asked(spark, d), "qid", "question")


# Fusion ----------------------------------------------------------------------------------------------------------------


def _lists(spark, d) -> dict[str, DataFrame]:
    """Keyword hits of the benchmark items, and as the dense list the nearest documents to the vector that shares an item's number."""
    v = _vectors(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.exact_search(v.select("id", "v"), v.join(asked(spark, d), F.col("id") == F.col("qid")).select("qid", "v"), 10)
    return {"dense": near, "keyword": keyword.search(_index(spark, d), asked(spark, d), 10)}


@query
def rrf_fusion(spark, d):
    return _top(fusion.reciprocal_rank_fusion(_lists(spark, d), weights=fusion.WEIGHTS))


@query
def weighted_fusion(spark, d):
    return _top(fusion.weighted_fusion(_lists(spark, d), fusion.WEIGHTS))


@query
def document_cap(spark, d):
    hits = fusion.reciprocal_rank_fusion(_lists(spark, d), weights=fusion.WEIGHTS).join(docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "source"), "id")
    return fusion.cap_by_document(hits, 1, "source").select("qid", "id", "source", F.col("rank").cast("long").alias("rank"))


@query
def fusion_diagnostics(spark, d):
    lists = _lists(spark, d)
    return fusion.diagnostics(lists, fusion.reciprocal_rank_fusion(lists, weights=fusion.WEIGHTS), asked(spark, d)).select("qid", "n_keyword", "n_dense", "n_fused", "note")


@query
def min_max_scores(spark, d):
    return fusion.min_max(fusion.stack({"keyword": _bm25(spark, d)})).select("qid", "id", F.bround("normalised", 6).alias("normalised"))


# Reranking and grounding -------------------------------------------------------------------------------------------------


def _candidates(spark, d) -> DataFrame:
    chunks = docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.array_join(F.slice(text.words("text"), 1, 8), " ").alias("heading"), F.col("source").alias("document_id"))
    return rerank.hydrate(_bm25(spark, d).select("qid", "id", "rank", "score"), chunks)


@query
def term_coverage(spark, d):
    return rerank.signals(asked(spark, d), _candidates(spark, d)).select("qid", "id", "coverage")


@query
def phrase_overlap(spark, d):
    return rerank.signals(asked(spark, d), _candidates(spark, d)).select("qid", "id", "phrase")


@query
def proximity(spark, d):
    return rerank.signals(asked(spark, d), _candidates(spark, d)).select("qid", "id", "proximity")


@query
def heading_overlap(spark, d):
    return rerank.signals(asked(spark, d), _candidates(spark, d)).select("qid", "id", "heading_overlap")


@query
def heuristic_rerank(spark, d):
    out = rerank.heuristic_rerank(asked(spark, d), _candidates(spark, d))
    return out.select("qid", "id", "rerank_score", F.col("new_rank").cast("long").alias("new_rank"), F.col("movement").cast("long").alias("movement"))


def _pairs(spark, d) -> DataFrame:
    """Stems of each item and of the whole text of each of its hits."""
    p = _candidates(spark, d).select("qid", "id", "rank", stem_list(text.content_tokens("text")).alias("p"))
    return p.join(query_terms(asked(spark, d)).withColumnRenamed("terms", "q"), "qid")


@query
def jaccard_pairs(spark, d):
    q, p = F.col("q"), F.col("p")
    return _pairs(spark, d).select("qid", "id", F.bround(scores.jaccard(q, p), 6).alias("jaccard"), F.bround(scores.containment(q, p), 6).alias("containment"))


def _support(spark, d) -> DataFrame:
    """Each benchmark item as a claim that cites its first hit, against the whole texts of all its hits."""
    claims = asked(spark, d).select("qid", F.concat(F.translate("question", ".!?", "   "), F.lit(" [1]")).alias("answer"))
    return answer.check_support(claims, _candidates(spark, d).select("qid", F.col("rank").alias("marker"), F.col("text").alias("body")))


@query
def support_check(spark, d):
    return _support(spark, d).select("qid", "is_claim", "best_marker", "best_score", "cited_score", "supported", "misattributed")


@query
def groundedness(spark, d):
    return answer.groundedness(_support(spark, d)).select("qid", "n_claims", "n_supported", "groundedness", "advises_refusal")


def _packed(spark, d) -> DataFrame:
    ranked = rerank.heuristic_rerank(asked(spark, d), _candidates(spark, d), 10)
    ranked = ranked.select("qid", "id", "document_id", F.col("document_id").alias("label"), "text", F.col("new_rank").alias("rank"))
    return materialise(context.pack_context(ranked), "packed")


@query
def context_pack(spark, d):
    return _packed(spark, d).select("qid", "id", "rank", "marker", "drop_reason", "truncated", "cost")


@query
def context_blocks(spark, d):
    return context.context_blocks(_packed(spark, d)).select("qid", "n_passages", "token_count", "utilisation", F.md5("context").alias("digest"))


@query
def extractive_answer(spark, d):
    return answer.extract_answers(asked(spark, d), _packed(spark, d))


@query
def answer_e2e(spark, d):
    from quern.plans.rag import answer_questions

    chunks = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("body"), F.col("text").alias("embed_text"), F.col("source").alias("title"))
    return answer_questions(asked(spark, d), chunks).select("qid", "status", "answer", "n_citations", "coverage", "groundedness")


def _grams(rows: DataFrame, key: str, column: str) -> DataFrame:
    k = F.col("_k")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(k) - 7, F.lit(1))), lambda i: F.array_join(F.slice(k, i, F.lit(8)), " "))
    return rows.select(F.col(key).cast("string").alias(key), text.tokens(column).alias("_k")).filter(F.size("_k") >= 8).select(key, F.explode(F.array_distinct(runs)).alias("g"))


@query
def recall_mrr(spark, d):
    """Relevant documents share eight tokens in a row with the item; items without any are vacuous."""
    from quern.plans.evaluate import retrieval_metrics

    relevant = _grams(asked(spark, d), "qid", "question").join(_grams(docs(spark, d).withColumnRenamed("doc_id", "id"), "id", "text"), "g").select("qid", "id").distinct()
    return retrieval_metrics(asked(spark, d), _bm25(spark, d), relevant).select("qid", "n_relevant", F.col("recall"), "reciprocal_rank")


# Tables ------------------------------------------------------------------------------------------------------------------


@query
def history_window(spark, d):
    return answer.history_window(table(spark, d, "conversations")).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


@query
def conversation_counts(spark, d):
    messages = table(spark, d, "conversations")
    users = messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"))
    return tables.conversation_counts(messages.select("conv_id").distinct(), messages.select("conv_id", "role")).join(users, "conv_id")


@query
def documents_page(spark, d):
    return tables.page(docs(spark, d), [F.col("n_chars").desc(), F.col("doc_id")], 50, 20).select("doc_id", "source", "n_chars")


@query
def upsert_latest(spark, d):
    return tables.latest(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query
def orphan_antijoin(spark, d):
    return tables.orphans(docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query
def delete_by_filter(spark, d):
    return tables.delete_where(docs(spark, d), {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"]}).select("doc_id", "lang")


@query
def cascade_delete(spark, d):
    labels = table(spark, d, "labels")
    return tables.cascade_delete(docs(spark, d), labels, labels.filter("toxic = 1"), "doc_id")[1].select("doc_id", "toxic")


@query
def update_by_key(spark, d):
    low = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("source"))
    return tables.update_by_key(docs(spark, d), low, "doc_id").select("doc_id", "source", "lang")


@query
def fetch_by_ids(spark, d):
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 7).alias("doc_id"))
    return tables.fetch(docs(spark, d), wanted, "doc_id").select("pos", "doc_id", "lang")


@query
def document_titles(spark, d):
    named = docs(spark, d).select(F.col("doc_id").alias("document_id"), F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("title"))
    return tables.titles(table(spark, d, "labels").select(F.col("doc_id").alias("document_id")), named).select("document_id", "title")


@query
def dense_levels(spark, d):
    levels = table(spark, d, "labels").join(docs(spark, d), "doc_id").select(F.col("source").alias("document_id"), "doc_id", (F.col("quality") * 4 + F.col("toxic") * 2).alias("level"))
    return chunking.dense_levels(levels).select("document_id", "doc_id", "level", F.col("dense_level").cast("long").alias("dense_level"))


@query
def tenant_scope(spark, d):
    return tables.scoped(docs(spark, d), "src1", "source").select("doc_id", "source")


@query
def delete_before(spark, d):
    messages = table(spark, d, "conversations")
    bounds = messages.filter("conv_id % 2 = 0").groupBy("conv_id").agg((F.max("turn") - 1).alias("before"))
    return tables.delete_before(messages, bounds).select("conv_id", "turn", "role")


def _chunk_rows(spark, d) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("heading"), F.col("n_chars").alias("token_count"))


@query
def vector_records(spark, d):
    v = _vectors(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    held = _chunk_rows(spark, d).join(v.select(F.col("vec_id").alias("document_id")), "document_id", "left_semi")
    made = records.records_from_chunks(held, v.select(F.concat("id", F.lit(":0")).alias("id"), "v"), user_id=7)
    return made.select("id", F.to_json("payload").alias("payload"), F.size("v").cast("long").alias("width"))


@query
def sync_records(spark, d):
    made = _vectors(spark, d).select(F.concat("id", F.lit(":0")).alias("id"), "v", F.create_map(F.lit("document_id"), F.col("id")).alias("payload"))
    kept, missing = records.sync_records(made, _chunk_rows(spark, d), _chunk_rows(spark, d))
    return kept.select("id", F.lit("kept").alias("state")).unionByName(missing.select(F.concat(F.col("document_id").cast("string"), F.lit(":0")).alias("id"), F.lit("missing").alias("state")))


@query
def matched_terms(spark, d):
    found = keyword.search(_index(spark, d), asked(spark, d), 10, matched=True)
    return fusion.matched_terms({"keyword": found}).select("qid", "id", F.array_join(F.array_sort("terms"), " ").alias("terms"))


@query
def prompt_messages(spark, d):
    questions = asked(spark, d).withColumn("conv_id", F.col("qid").cast("long"))
    made = prompts.build_messages(questions, questions.select("qid", F.col("question").alias("context")), table(spark, d, "conversations"))
    return made.select("qid", F.size("messages").cast("long").alias("n_messages"), F.md5(prompts.flatten_messages(F.col("messages"))).alias("digest"))


# Structure ---------------------------------------------------------------------------------------------------------------


@query
def chunk_documents(spark, d):
    made = chunking.chunk_documents(chunking.plain_blocks(docs(spark, d), "doc_id", "text"))
    return made.select("document_id", "id", "chunk_index", "token_count", "has_overlap", F.md5("body").alias("digest"))


@query
def document_stats(spark, d):
    return chunking.document_stats(chunking.plain_blocks(docs(spark, d), "doc_id", "text")).select("document_id", "n_blocks", "n_headings", "n_chars", "n_words")


@query
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunking.chunk_documents(chunking.plain_blocks(docs(spark, d), "doc_id", "text")))


