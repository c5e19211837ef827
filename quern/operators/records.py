"""Vectors of chunks as records: embedding in batches, pairing with chunks, and keeping records in step with live documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a record says of its chunk; the text itself stays with the chunks, where it can change.
PAYLOAD = ("document_id", "chunk_index", "page_start", "page_end", "section_key", "section_path", "heading", "token_count")


def embed_rows(rows: DataFrame, encode: Callable[[Sequence[str]], Any], dim: int, id_column: str = "id", text_column: str = "text", batch: int = 32, normalised: bool = True) -> DataFrame:
    """(id, v array<float>) by ``encode(texts)``, a model of the caller's, called on ``batch`` texts at a time in Arrow batches.

    Texts are trimmed, and blank ones are a single space, so that every row has its vector. Not-a-number and infinite components become 0;
    another number of rows or another width than ``dim`` raises.
    """
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [(t or "").strip() or " " for t in b.column(1).to_pylist()]
            made = [np.zeros((0, dim), dtype=np.float32)]
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                x = np.atleast_2d(np.asarray(encode(part), dtype=np.float32))
                if x.shape != (len(part), dim):
                    raise ValueError(f"the model gave {x.shape} for {len(part)} texts of width {dim}")
                made.append(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0))
            x = np.concatenate(made)
            if normalised:
                n = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                x = np.divide(x, n, out=np.zeros_like(x, dtype=np.float64), where=n > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))], names=["id", "v"])

    return rows.select(F.col(id_column).alias("id"), text_column).mapInArrow(run, f"id {kind}, v array<float>")


def records_from_chunks(chunks: DataFrame, vectors: DataFrame, user_id: Any = None, extra: dict[str, Any] | None = None) -> DataFrame:
    """(id, v, payload) of chunks (document_id, chunk_index, ...) with their vectors (id, v), id being document_id:chunk_index.

    So a document that is indexed anew replaces its own records. The payload is a map without nulls, of everything as text, with the owner and
    ``extra``. A chunk without a vector, or a vector without a chunk, raises: records out of step would cite the wrong passages.
    """
    held = set(chunks.columns)
    fields = {c: (F.col(c).cast("string") if c != "section_path" else F.array_join(c, " > ")) for c in PAYLOAD if c in held}
    fields |= {k: F.lit(str(v)) for k, v in {**({"user_id": user_id} if user_id is not None else {}), **(extra or {})}.items()}
    payload = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    left = chunks.select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), payload.alias("payload"))
    both = left.join(vectors.select(F.col("id").cast("string").alias("id"), "v"), "id", "full_outer")
    bad = F.col("payload").isNull() | F.col("v").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no chunk or no vector for "), F.col("id")))).otherwise(F.col("id"))
    return both.select(checked.cast("string").alias("id"), "v", "payload")


def sync_records(records: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing): records of live documents, and live chunks that have no record yet."""
    live = documents.select(F.col("document_id").cast("string").alias("_d")).distinct()
    kept = records.join(live, F.col("payload")["document_id"] == F.col("_d"), "left_semi")
    wanted = chunks.join(live, F.col("document_id").cast("string") == F.col("_d"), "left_semi")
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    return kept, wanted.withColumn("_id", key).join(kept.select(F.col("id").alias("_id")), "_id", "left_anti").drop("_id")
