"""Token ids as flat unsigned integer files with 64-bit document offsets, read through memory maps.

A shard is three files beside each other: ``NAME.ids`` (little-endian unsigned 16-bit ids if the vocabulary has at
most 65,536 entries, else 32-bit), ``NAME.off`` (little-endian signed 64-bit: one offset in ids for each document and
one for the end, counted from the shard's start) and ``NAME.doc`` (signed 64-bit document ids, then one byte for each
document: 1 where the id is null). Shards in order hold the documents in ascending order of ids, nulls first.
The manifest lists each shard's first document and first id, the prefix sums of those before it.
"""

from __future__ import annotations

import mmap
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.encode import byte_balanced, text_list, worker_encoder
from quern.session import scratch_path

#: Characters of text that one shard holds, about.
SHARD_CHARS = 48 << 20


@dataclass(frozen=True)
class Shard:
    """One line of the manifest."""

    name: str
    docs: int
    ids: int
    first_doc: int
    first_id: int
    width: int


def _filesystem(path: str):
    """A pyarrow file system and the path in it: file:, hdfs:, s3: and others by their address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _ShardWriter:
    """Writes one shard under a name of its own; only a shard that the manifest names counts."""

    def __init__(self, folder: str, number: int, width: int):
        self.fs, root = _filesystem(folder)
        self.name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        self.path, self.width = f"{root}/{self.name}", width
        self.out = self.fs.open_output_stream(self.path + ".ids")
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.lengths.append(counts)
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        lengths = np.concatenate(self.lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with self.fs.open_output_stream(self.path + ".off") as f:
            f.write(offsets.tobytes())
        with self.fs.open_output_stream(self.path + ".doc") as f:
            f.write(np.concatenate(self.doc_ids).astype("<i8").tobytes() + np.concatenate(self.nulls).astype("u1").tobytes())
        return self.name, len(lengths), int(offsets[-1])


def _with_end(counts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each document."""
    full = counts + 1
    out = np.full(int(full.sum()), end, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(full) - 1] = False
    out[keep] = ids
    return full, out


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> tuple[str, list[Shard]]:
    """Encode every text, append ``end_id`` and write shards in ascending order of ids; (folder, manifest).

    Rows are dealt by ranges of (id, text hash), so shards are alike in size even if many rows share an id; a task writes
    its rows in order, in byte-balanced batches. A task that is run again writes new files, and the manifest names
    those of the attempt that counted. The driver gets one row for each shard, whose bases are prefix sums.
    Null texts are empty (the end id alone); null ids come first; repeated rows are all written; an empty table has
    no shards; other columns are not read. The folder, in the shared one unless given, must be
    reachable from the executors by an address that pyarrow knows.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    shards = max(1, -(-size // SHARD_CHARS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The last key only separates rows that are equal in both others, whose order does not matter.
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    ordered = rows.withColumn("h", F.xxhash64("text")).withColumn("t", tie).repartitionByRange(shards, F.col("id").asc_nulls_first(), "h", "t").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        writer, encoder = None, None
        number = TaskContext.get().partitionId()
        for batch in batches:
            nulls = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0))
            done = 0
            for group in byte_balanced(((t,) for t in text_list(batch.column(1)))):
                if writer is None:
                    encoder = worker_encoder(tokenizer)
                    writer = _ShardWriter(folder, number, 2 if max(len(encoder.opens_word), end_id + 1) <= 1 << 16 else 4)
                counts, flat = _with_end(*encoder.encode([t for (t,) in group]), end_id)
                writer.add(ids[done : done + len(group)], nulls[done : done + len(group)], counts, flat)
                done += len(group)
        if writer is not None:
            name, n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "name": [name], "docs": [n], "ids": [total], "width": [writer.width]})

    written = ordered.select("id", "text").mapInArrow(write, "number bigint, name string, docs bigint, ids bigint, width bigint").collect()
    manifest, first_doc, first_id = [], 0, 0
    for r in sorted(written, key=lambda r: r.number):
        manifest.append(Shard(r.name, r.docs, r.ids, first_doc, first_id, r.width))
        first_doc, first_id = first_doc + r.docs, first_id + r.ids
    return folder, manifest


class ShardReader:
    """A shard's documents; ids are mapped into memory where the file system is local."""

    def __init__(self, folder: str, name: str, width: int):
        from pyarrow import fs

        files, root = _filesystem(folder)
        path = f"{root}/{name}"
        self._map = None
        if isinstance(files, fs.LocalFileSystem) and os.path.getsize(path + ".ids"):
            with open(path + ".ids", "rb") as f:
                self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            self.ids = np.frombuffer(self._map, dtype=f"<u{width}")
        else:
            self.ids = np.frombuffer(files.open_input_file(path + ".ids").read(), dtype=f"<u{width}")
        self.offsets = np.frombuffer(files.open_input_file(path + ".off").read(), dtype="<i8")
        doc = files.open_input_file(path + ".doc").read()
        n = len(self.offsets) - 1
        self.doc_ids, self.nulls = np.frombuffer(doc[: 8 * n], dtype="<i8"), np.frombuffer(doc[8 * n :], dtype="u1")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, offset in the shard, ids) in order."""
        for i in range(len(self.doc_ids)):
            a, b = self.offsets[i], self.offsets[i + 1]
            yield None if self.nulls[i] else int(self.doc_ids[i]), int(a), self.ids[a:b]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_token_files(spark: SparkSession, folder: str, manifest: list[Shard], id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""
    schema = "name string, width bigint, first_id bigint"
    shards = spark.createDataFrame([(s.name, s.width, s.first_id) for s in manifest], schema).repartition(max(1, len(manifest)), F.col("name"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard in batch.to_pylist():
                reader = ShardReader(folder, shard["name"], shard["width"])
                rows = [(d, shard["first_id"] + a, len(x), ids_crc32(x)) for d, a, x in reader.documents()]
                for k in range(0, len(rows), 50_000):
                    part = list(zip(*rows[k : k + 50_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in part], names=["id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_column)
