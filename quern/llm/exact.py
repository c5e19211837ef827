"""Exact deduplication by a streaming aggregation whose keyed state is on disk and never expires.

The stream reads (digest, document id, content locator) of each row. Its state, in RocksDB and checkpointed to the
shared folder, holds for every digest the largest id, where that row's content is, and how many rows have come. Equal digests
are a hit, and hits are checked against full bytes; texts that differ under one digest are told apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.rows import located
from quern.session import materialise, remove_at_exit, scratch_path

#: Parts that the rows of one digest are dealt to where their bytes are compared.
SALTS = 16
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = "digest string, doc_id bigint, file string, place bigint"


def sha256(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def with_locator(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, file, place): a row's content is at ``place`` of ``file``, for good."""
    rows, file, place = located(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    return rows.select("doc_id", "text", F.col(file).alias("file"), F.col(place).alias("place"))


def dedup_stream(keys: DataFrame, state_dir: str, out_dir: str):
    """Start the stateful deduplication of a stream of ``KEYS`` rows; each batch writes the groups that it changed.

    Returns the running query (available-now). Started again with the same folders, it goes on from its state: rows of
    later files meet all earlier ones. A batch that is replayed overwrites what it wrote.
    """
    groups = keys.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch:08d}")

    return groups.writeStream.outputMode("update").option("checkpointLocation", state_dir).foreachBatch(write).trigger(availableNow=True).start()


_GROUPS = "digest string, keep struct<doc_id:bigint,file:string,place:bigint>, group_size bigint"


def latest_groups(spark: SparkSession, out_dir: str) -> DataFrame:
    """(digest, keep, group_size) as of the last batch that changed each digest."""
    changed = spark.read.schema(_GROUPS + ", batch bigint").parquet(f"{out_dir}/batch=*")
    # Both grow with every change, so the latest state has the largest count.
    return changed.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s")).select("digest", "s.keep", "s.group_size")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int | None = None, digest=sha256) -> tuple[DataFrame, DataFrame]:
    """(content, verdicts): content (doc_id, text, file, place) and, for every row of it, (doc_id, file, place, digest, keep_id, group_size, kept).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays; of
    rows that also share the id, the one at the last locator, so exactly one is kept. Null ids rank lowest.
    ``files_per_batch`` bounds a micro-batch. ``digest`` may be weak: hits are settled by the bytes.
    An empty table gives empty results; extra columns are not read.
    """
    content = with_locator(docs, id_column, text_column)
    return content, _verdicts(content, files_per_batch, digest)


def _verdicts(content: DataFrame, files_per_batch: int | None = None, digest=sha256) -> DataFrame:
    """What :func:`exact_groups` says of rows (doc_id, text, file, place)."""
    spark = content.sparkSession
    keys = content.select(digest(F.col("text")).alias("digest"), "doc_id", "file", "place")
    landed, state, out = (scratch_path(spark, x) for x in ("keys", "state", "groups"))
    keys.write.parquet(landed)
    # A session of its own: the state store's settings stay out of the caller's.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    # Many small stores: no disk is set aside for logs that they never fill.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(KEYS)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    dedup_stream(stream.parquet(landed), state, out).awaitTermination()
    for path in (landed, state, out):
        remove_at_exit(spark, path)
    seen = spark.read.schema(KEYS).parquet(landed)
    try:
        groups = latest_groups(spark, out)
    except AnalysisException:  # no rows, no batch
        groups = spark.createDataFrame([], _GROUPS)
    groups = materialise(groups, "latest")
    clash = materialise(_clashes(content, groups, digest), "clashes")
    # Both sides are plain scans, so that the rows of a digest that many share are split where Spark joins them.
    verdict = seen.join(groups, "digest").select("doc_id", "file", "place", "digest", "keep", "group_size")
    if not clash.isEmpty():
        verdict = verdict.join(clash, "digest", "left_anti").unionByName(_by_bytes(content, clash, digest))
    kept = (F.col("keep.place") == F.col("place")) & (F.col("keep.file") == F.col("file"))
    return verdict.select("doc_id", "file", "place", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))


def _clashes(content: DataFrame, groups: DataFrame, digest) -> DataFrame:
    """Digests whose rows are not all the same bytes. Only rows of hits are compared, dealt to ``SALTS`` tasks a digest."""
    hits = groups.filter("group_size > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = content.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("place", "file"), F.lit(SALTS)).cast("int").alias("salt"))
    ends = rows.join(hits, ["digest", "salt"]).groupBy("digest", "salt").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    # Each part ships its two ends, once.
    return ends.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("digest")


def _by_bytes(content: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """Verdicts of the rows under clashing digests, grouped by their bytes."""
    rows = content.withColumn("digest", digest(F.col("text"))).withColumn("text", F.coalesce("text", F.lit(""))).join(clash, "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "text"]).select("doc_id", "file", "place", "digest", "keep", "group_size")


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies, with its columns: of equal texts the row with the largest id stays.

    Null counts as empty and null ids rank lowest; of rows that share id and text exactly one stays, also where joins or explodes
    repeat rows or other columns differ. An empty table gives an empty result; columns of any name are handed on.
    """
    rows, file, place = located(docs)
    content = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(file).alias("file"), F.col(place).alias("place"))
    dropped = _verdicts(content).filter(~F.col("kept")).select(F.col("file").alias(file), F.col("place").alias(place))
    return rows.join(dropped, [file, place], "left_anti").select(*docs.columns)
