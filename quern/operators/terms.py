"""Ordered lists of stems for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.stem import stem_list


def stem_lists(rows: DataFrame, id_column: str, text_column: str, out: str = "terms", content: bool = True) -> DataFrame:
    """(id, out): the stems of each text's tokens in order, repeats kept; an empty list for texts without any. One row for each row."""
    found = text.content_tokens(text_column) if content else text.tokens(text_column)
    return rows.select(F.col(id_column), stem_list(found).alias(out))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, terms): content stems of each question; where it has none, the stems of its stop words."""
    both = queries.select("qid", stem_list(text.content_tokens("question")).alias("terms"), stem_list(F.filter(text.tokens("question"), lambda t: t.isin(text.STOP_WORDS))).alias("stops"))
    return both.select("qid", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.col("stops")).alias("terms"))
