"""Operations on the engine's tables: filters, lookups, upserts, deletes and pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_filters(filters: Mapping[str, Any] | None) -> dict[str, tuple]:
    """Each field with a tuple of allowed values; a scalar is one value, an empty list allows nothing."""
    out = {}
    for field, value in (filters or {}).items():
        out[field] = tuple(value) if isinstance(value, Iterable) and not isinstance(value, str | bytes) else (value,)
    return out


def matches(filters: Mapping[str, Any] | None) -> Column:
    """All fields among their allowed values, compared as text."""
    out = F.lit(True)
    for field, allowed in normalise_filters(filters).items():
        out = out & (F.col(field).cast("string").isin([str(v) for v in allowed]) if allowed else F.lit(False))
    return F.coalesce(out, F.lit(False))


def filtered(rows: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    return rows.filter(matches(filters))


def scoped(rows: DataFrame, owner: Any = None, column: str = "user_id") -> DataFrame:
    """Rows of one owner; None (a caller that may see all) keeps every row."""
    return rows if owner is None else rows.filter(F.col(column).cast("string") == str(owner))


def delete_before(rows: DataFrame, bounds: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """What is left without the rows of each group in ``bounds`` (group, before) that come before its bound."""
    limits = bounds.select(F.col(group).alias("_g"), F.col("before").alias("_before"))
    return rows.join(limits, (F.col(group) == F.col("_g")) & (F.col(order) < F.col("_before")), "left_anti")


def delete_where(rows: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """What is left; without a filter it raises rather than delete all."""
    if not filters:
        raise ValueError("refusing to delete without a filter")
    return rows.filter(~matches(filters))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def orphans(rows: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """Rows without a parent."""
    return rows.join(parents.select(on).distinct(), on, "left_anti")


def without_orphans(rows: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    return rows.join(parents.select(on).distinct(), on, "left_semi")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids, key, "left_anti")


def update_by_key(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New values where they are not null; other columns and rows as they were."""
    changed = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = rows.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns])


def fetch(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows for ids (pos, key), in the order of pos; ids that are not there are skipped."""
    return wanted.join(rows, key).orderBy("pos")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def chunk_page(chunks: DataFrame, document_id: Any, limit: int, offset: int = 0, preview: int = 500) -> DataFrame:
    """A page of one document's chunks in order, with the opening of each as a preview."""
    mine = chunks.filter(F.col("document_id").cast("string") == str(document_id))
    return page(mine, [F.col("chunk_index")], limit, offset).withColumn("preview", F.substring("body", 1, preview))


def titles(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's title, or its id where the title is missing or empty."""
    named = documents.select(F.col("document_id").alias("_d"), "title")
    return chunks.join(named, F.col("document_id") == F.col("_d"), "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("document_id").cast("string"))).drop("_d")


def conversation_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with the number of its messages."""
    return conversations.join(messages, "conv_id", "left").groupBy("conv_id").agg(F.count("role").alias("n_messages"))


def check_fingerprint(expected: str, found: str | None) -> None:
    """An index made by another embedder must not be searched; an empty index has no fingerprint yet."""
    if found is not None and found != expected:
        raise ValueError(f"index was built with {found}, not {expected}")


def repeated_lines(lines: DataFrame, group: str, page: str, line: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """(group, line, pages): lines of 3 to 120 characters on 60 % of a group's pages or more, of at least three."""
    trimmed = lines.select(group, page, F.trim(line).alias("line")).filter((F.length("line") >= 3) & (F.length("line") <= 120))
    total = lines.groupBy(group).agg(F.countDistinct(page).alias("_all"))
    counted = trimmed.groupBy(group, "line").agg(F.countDistinct(page).alias("pages"))
    return counted.join(total, group).filter((F.col("_all") >= least) & (F.col("pages") >= F.greatest(F.lit(least), F.bround(F.col("_all") * share)))).select(group, "line", "pages")
