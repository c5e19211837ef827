"""Files that arrive in a folder into tables of chunks: each micro-batch replaces the chunks of the documents that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunking import ChunkConfig, chunk_documents
from quern.operators.tables import latest
from quern.sources.files import parse_files

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def start_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, config: ChunkConfig = ChunkConfig()):  # noqa: B008
    """Start a query that takes what is there and ends. A batch that is replayed overwrites what it wrote."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(parse_files(batch), config).withColumn("batch", F.lit(number))
        chunks.write.mode("overwrite").parquet(f"{out}/part={number:08d}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document as of its last batch."""
    rows = spark.read.parquet(out).drop("part")
    newest = latest(rows.select("document_id", "batch").distinct(), "document_id", "batch")
    return rows.join(newest, ["document_id", "batch"], "left_semi")
