"""Token counts of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encode import byte_balanced, text_list, worker_encoder


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``, in no order; ``tokenizer`` is a vocabulary file.

    The file is a tokenizers .json or a sentencepiece .model. No begin, end or added tokens; special strings inside
    a text are handled as the library does by default. Only lengths leave Python. Batches hold about
    ``batch_bytes`` bytes whatever the number of rows, and long texts are cut where no token can cross.
    Null and empty texts have no bytes and no tokens; null ids are kept; repeated rows give repeated rows; an empty
    table gives an empty one; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.octet_length(F.col(text_column)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col(text_column).alias("text"))

    def count(batches):
        import pyarrow as pa

        counter = _counter(tokenizer)
        for batch in batches:
            done = 0
            for group in byte_balanced(((t,) for t in text_list(batch.column(2))), batch_bytes):
                n = counter([t for (t,) in group])
                part = batch.slice(done, len(group))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, type=pa.int64())], names=["id", "n_bytes", "n_tokens"])
                done += len(group)

    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_column)


def _counter(tokenizer: str):
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return worker_encoder(tokenizer).counts
