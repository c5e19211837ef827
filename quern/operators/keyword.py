"""Keyword search for batches of queries: an inverted index as tables, BM25 as a join and a sum.

The index is a function of its chunks: postings (term, id, tf, dl), terms (term, df, cf) and lengths (id, dl). A chunk's postings are
counted where the chunk is read, so nothing is shuffled to build them; a search filters them by the query's terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.functions.stem import stem_list, term_counts
from quern.session import materialise


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame


def _tokens(text_column: str, content: bool) -> Column:
    return text.content_tokens(text_column) if content else text.tokens(text_column)


def build_index(chunks: DataFrame, id_column: str = "id", text_column: str = "text", stemmed: bool = True, content: bool = True) -> KeywordIndex:
    """Index all chunks; those without terms have length 0 and count towards the mean. Null texts are empty; rows that share an id are one chunk.

    The tables are written to the shared folder, so that texts are read and tokens stemmed once for all searches.
    """
    postings, lengths = _postings(count_terms(chunks, id_column, text_column, stemmed, content))
    return _index(materialise(postings, "postings"), materialise(lengths, "lengths"))


def count_terms(chunks: DataFrame, id_column: str, text_column: str, stemmed: bool = True, content: bool = True, wanted: frozenset[str] | None = None) -> DataFrame:
    """(id, dl, terms) of each row, written to the shared folder: its length, and (term, tf) of each of its terms, only of those ``wanted`` if given."""
    rows = chunks.select(F.col(id_column).cast("string").alias("id"), term_counts(text_column, stemmed, content, wanted).alias("c"))
    return materialise(rows.select("id", "c.dl", "c.terms"), "counted")


def repeats(lengths: DataFrame) -> bool:
    """Whether rows share an id."""
    return not lengths.groupBy("id").count().filter("count > 1").isEmpty()


def _postings(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    postings, lengths = counted.select(F.explode("terms").alias("t"), "id", "dl").select("t.term", "id", "t.tf", "dl"), counted.select("id", "dl")
    if repeats(lengths):
        lengths = lengths.groupBy("id").agg(F.sum("dl").alias("dl"))
        postings = postings.groupBy("term", "id").agg(F.sum("tf").alias("tf")).join(lengths, "id").select("term", "id", "tf", "dl")
    return postings, lengths


def index_of(counted: DataFrame) -> KeywordIndex:
    """An index of what :func:`count_terms` gives."""
    return _index(*_postings(counted))


def frequencies(counted: DataFrame) -> DataFrame:
    """(term, df, cf) of what :func:`count_terms` gives of rows that share no id."""
    return _terms(counted.select(F.explode("terms").alias("t")).select("t.term", "t.tf"))


def _terms(postings: DataFrame) -> DataFrame:
    return materialise(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "terms")


def _index(postings: DataFrame, lengths: DataFrame) -> KeywordIndex:
    return KeywordIndex(postings, lengths, _terms(postings))


def index_stats(index: KeywordIndex) -> DataFrame:
    """One row: documents, terms, mean_length."""
    documents = index.lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.bround(F.avg("dl"), 4), F.lit(0.0)).alias("mean_length"))
    return documents.crossJoin(index.terms.agg(F.count(F.lit(1)).alias("terms"))).select("documents", "terms", "mean_length")


def term_frequencies(index: KeywordIndex) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences."""
    return index.terms


def ranked(scored: DataFrame, k: int | None, order: Column | None = None) -> DataFrame:
    """Rank by score (rounded to six places), ties to the smaller id as text; keep the first ``k`` of each query."""
    out = scored.withColumn("score", F.bround("score", 6))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc() if order is None else order, F.col("id").asc())
    out = out.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def asked_terms(queries: DataFrame, stemmed: bool = True, content: bool = True) -> DataFrame:
    """(qid, term, word) of queries (qid, question), each term once."""
    tokens = _tokens("question", content)
    words = queries.select(F.col("qid").cast("string").alias("qid"), F.explode(F.arrays_zip(tokens.alias("word"), (stem_list(tokens) if stemmed else tokens).alias("term"))).alias("t"))
    return words.select("qid", "t.term", "t.word").groupBy("qid", "term").agg(F.min("word").alias("word"))


def weighed(asked: DataFrame, terms: DataFrame, lengths: DataFrame, idf: str = "bm25") -> DataFrame:
    """(qid, term, word, idf, mean) of the terms asked for that some chunk holds."""
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean"))
    weigh = {"bm25": scores.bm25_idf, "textbook": scores.textbook_idf}[idf]
    return asked.join(terms, "term").crossJoin(F.broadcast(corpus)).select("qid", "term", "word", weigh(F.col("n_docs"), F.col("df")).alias("idf"), "mean")  # one row


def search(index: KeywordIndex, queries: DataFrame, k: int = 24, idf: str = "bm25", stemmed: bool = True, content: bool = True, allowed: DataFrame | None = None, matched: bool = False) -> DataFrame:
    """(qid, id, score, rank[, matched]) for queries (qid, question): the best ``k`` chunks with any query term.

    ``idf`` is "bm25" or "textbook". ``allowed`` (id), if given, restricts the ids that may be found: an empty one finds nothing. Statistics
    are those of the whole index. ``matched`` adds the query's words that were found, in order of terms.
    """
    # Written out, so that its size is known: Spark sends it to the postings if it is small, and splits common terms where it is not.
    weights = materialise(weighed(asked_terms(queries, stemmed, content), index.terms, index.lengths, idf), "query-terms")
    postings = index.postings
    if allowed is not None:
        postings = postings.join(allowed.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    hits = postings.join(weights, "term").withColumn("part", F.col("idf") * scores.bm25_tf(F.col("tf"), F.col("dl"), F.col("mean")))
    found = [F.sum("part").alias("score")]
    if matched:
        found.append(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("term", "word"))), lambda x: x["word"]), " ").alias("matched"))
    return ranked(hits.groupBy("qid", "id").agg(*found).filter("score > 0"), k)


def upsert(index: KeywordIndex, added: KeywordIndex) -> KeywordIndex:
    """Rows of ``added`` replace those of the same ids."""
    keep = lambda old, new: old.join(added.lengths.select("id"), "id", "left_anti").select(new.columns).unionByName(new)
    return _index(keep(index.postings, added.postings), keep(index.lengths, added.lengths))


def delete(index: KeywordIndex, ids: DataFrame) -> KeywordIndex:
    gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
    return _index(index.postings.join(gone, "id", "left_anti"), index.lengths.join(gone, "id", "left_anti"))


def sync(index: KeywordIndex, chunks: DataFrame, documents: DataFrame, id_column: str = "id", text_column: str = "text", document: str = "document_id") -> KeywordIndex:
    """The index of the chunks of live ``documents``: chunks of others go, those that it lacks are added; texts that it holds are not read again."""
    live = chunks.join(documents.select(document).distinct(), document, "left_semi").withColumn("_id", F.col(id_column).cast("string"))
    kept = index.lengths.join(live.select(F.col("_id").alias("id")), "id", "left_semi")
    missing = live.join(index.lengths.select(F.col("id").alias("_id")), "_id", "left_anti")
    added = build_index(missing, "_id", text_column)
    held = index.postings.join(kept.select("id"), "id", "left_semi").select("term", "id", "tf", "dl")
    return _index(materialise(held.unionByName(added.postings), "postings"), materialise(kept.select("id", "dl").unionByName(added.lengths), "lengths"))
