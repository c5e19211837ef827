"""Citation markers such as [1] or [2, 3] in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

# What counts as a marker.
MARKER = r"\[\s*(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\s*\]"
LEADING = r"^((?:\[\s*\d{1,3}(?:\s*[,;]\s*\d{1,3})*\s*\]\s*)+)"


def _numbers(groups: Column) -> Column:
    return F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), 0))), lambda x: x.cast("int"))


def all_markers(c: Column | str) -> Column:
    """Marker numbers in order, repeats kept."""
    return _numbers(F.regexp_extract_all(text._text(c), F.lit(MARKER), 0))


def markers(c: Column | str) -> Column:
    """Marker numbers by first appearance."""
    return F.array_distinct(all_markers(c))


def marker_counts(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, marker, n)."""
    return rows.select(id_column, F.explode(all_markers(text_column)).alias("marker")).groupBy(id_column, "marker").agg(F.count(F.lit(1)).alias("n"))


def tidy(c: Column) -> Column:
    """Repair the spaces that a removed marker leaves."""
    t = F.regexp_replace(c, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+([.,;:!?)\]])", "$1")
    t = F.regexp_replace(t, r"([(\[])[ \t]+", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_markers(c: Column | str) -> Column:
    return tidy(F.regexp_replace(text._text(c), MARKER, ""))


def normalise_markers(c: Column | str, keep: Column | None = None) -> Column:
    """Groups as single markers, those not in ``keep`` (an array; null keeps all) removed."""
    t = text._text(c)
    groups = F.regexp_extract_all(t, F.lit(MARKER), 0)
    between = F.split(t, MARKER, -1)

    def rewritten(group: Column) -> Column:
        found = F.array_distinct(_numbers(F.array(group)))
        if keep is not None:
            found = F.filter(found, lambda n: F.array_contains(keep, n))
        return F.array_join(F.transform(found, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")

    parts = F.zip_with(between, F.transform(groups, rewritten), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return tidy(F.array_join(parts, ""))


def cited_sentences(c: Column | str) -> Column:
    """Sentences with markers that stand after a full stop moved back into the sentence that they belong to."""

    def attach(sentence: Column, found: Column) -> Column:
        body = F.rtrim(sentence)
        inside = body.rlike(r"[.!?]$") & ~body.rlike(r"\.\.$")
        return F.when(inside, F.concat(F.rtrim(F.substring(body, F.lit(1), F.length(body) - 1)), F.lit(" "), found, F.right(body, F.lit(1)))).otherwise(F.concat(body, F.lit(" "), found))

    def step(done: Column, sentence: Column) -> Column:
        lead = F.regexp_extract(sentence, LEADING, 1)
        rest = F.trim(F.substring(sentence, F.length(lead) + 1, F.length(sentence)))
        last = F.try_element_at(done, F.lit(-1))
        moved = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), attach(last, tidy(lead)))
        moves = (lead != "") & (F.size(done) > 0)
        return F.when(moves & (rest == ""), moved).when(moves, F.array_append(moved, rest)).otherwise(F.array_append(done, sentence))

    return F.aggregate(text.sentences(c), F.array().cast("array<string>"), step)


def resolve(answers: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, citations) for answers (qid, answer) and passages (qid, marker, id).

    report: qid, answer with unknown markers removed, invalid_markers, n_sentences, uncited_sentences, coverage (share of sentences with a
    known marker, 4 places; 1 for an empty answer). citations: qid, marker, id, n.
    """
    known = passages.filter("marker is not null").groupBy("qid").agg(F.sort_array(F.collect_set("marker")).alias("known"))
    joined = answers.join(known, "qid", "left").withColumn("known", F.coalesce("known", F.array().cast("array<int>")))
    clean = joined.withColumn("invalid_markers", F.array_except(markers("answer"), "known")).withColumn("answer", normalise_markers("answer", F.col("known")))
    said = clean.withColumn("_s", cited_sentences("answer"))
    uncited = F.filter("_s", lambda s: F.size(markers(s)) == 0)
    n = F.size("_s")
    report = said.select("qid", "answer", "invalid_markers", n.alias("n_sentences"), F.size(uncited).alias("uncited_sentences"), F.when(n == 0, 1.0).otherwise(F.bround(1 - F.size(uncited) / n, 4)).alias("coverage"))
    return report, marker_counts(clean, "qid", "answer").join(passages.select("qid", "marker", "id"), ["qid", "marker"])
