"""The registered queries of the operators in quern.llm, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simhash import Rule, near_duplicate_components

    found = near_duplicate_components(_table(spark, sf_dir, "documents"), width=3, rule=Rule(radius=2))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.substring import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents"), k=13)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.exact import exact_groups

    _, verdicts = exact_groups(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_scores

    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_files import read_token_files, write_token_files

    folder, manifest = write_token_files(_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return read_token_files(spark, folder, manifest)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


#: The tools that :func:`tool_traffic` calls.
TOOLS = {
    "search": {"properties": {"limit": {"type": "integer", "minimum": 100}, "query": {"type": "string"}}, "required": ["query"], "additionalProperties": False},
    "lookup": {"properties": {"key": {"type": "integer"}}, "required": ["key"]},
}


def tool_traffic(messages: DataFrame) -> DataFrame:
    """The messages of (conv_id, turn, role, text) with tool calls and results, made from them by rule; n is conv_id + turn.

    An assistant says its text and calls two tools: c<turn> (search, or an unlisted tool where n % 13 = 0), which waits for the call two turns
    before and, where n % 17 = 0, for the second one; and d<turn> (only d where conv_id % 10 = 9; lookup), which waits for the first where
    n % 17 = 0. The query of a search is the digest of the text, its limit the length, as a string where n % 5 = 0; the query is left out where
    n % 7 = 0, and x is added where n % 11 = 0. Users turn into tools where conv_id % 4 is not 0, and answer by n % 6: the first or second call
    of the turn before, the first of the turn after, one that is nowhere, c1, or none (plain text).
    """
    n, turn, length = F.col("conv_id") + F.col("turn"), F.col("turn").cast("string"), F.length("text")
    limit = F.when(n % 5 == 0, F.concat(F.lit('"'), length.cast("string"), F.lit('"'))).otherwise(length.cast("string"))
    parts = F.concat_ws(",", F.concat(F.lit('"limit":'), limit), F.when(n % 7 != 0, F.concat(F.lit('"query":"'), F.md5("text"), F.lit('"'))), F.when(n % 11 == 0, F.lit('"x":null')))
    second = F.when(F.col("conv_id") % 10 == 9, F.lit("d")).otherwise(F.concat(F.lit("d"), turn))
    first = F.concat(F.lit("c"), turn)
    waits = F.array_compact(F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")), F.when(n % 17 == 0, second)))
    call = lambda i, name, arguments, depends: F.struct(i.alias("id"), name.alias("name"), F.parse_json(arguments).alias("arguments"), depends.alias("depends_on"))
    calls = F.array(
        call(first, F.when(n % 13 == 0, "unlisted").otherwise("search"), F.concat(F.lit("{"), parts, F.lit("}")), waits),
        call(second, F.lit("lookup"), F.concat(F.lit('{"key":'), turn, F.lit("}")), F.array_compact(F.array(F.when(n % 17 == 0, first)))),
    )
    before, after = (F.col("turn") - 1).cast("string"), (F.col("turn") + 1).cast("string")
    answers = F.when(n % 6 == 0, F.concat(F.lit("c"), before)).when(n % 6 == 1, F.concat(F.lit("d"), before)).when(n % 6 == 2, F.concat(F.lit("c"), after)).when(n % 6 == 3, "zz").when(n % 6 == 4, "c1")
    tool = (F.col("role") == "user") & (F.col("conv_id") % 4 != 0)
    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("content"), calls.alias("tool_calls"))))
    said = said.when(tool & answers.isNotNull(), F.to_json(F.struct(F.col("text").alias("content"), answers.alias("tool_call_id")))).otherwise(F.col("text"))
    return messages.select("conv_id", "turn", F.when(tool, "tool").otherwise(F.col("role")).alias("role"), said.alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.chat import format_chat

    made = format_chat(tool_traffic(_table(spark, sf_dir, "conversations")), TOOLS)
    return made.select("conv_id", "turn", "role", "anchor", "slot", "level", "place", "n_calls", "n_answered", "n_errors", "status", "message")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.topk import exact_top_k, scaled_vectors

    vectors = scaled_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_top_k(vectors, vectors.filter(F.col("id") % 100 == 0), 10)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_count import token_counts

    counted = token_counts(_table(spark, sf_dir, "documents"), vocabulary())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_exact": op3_exact,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_pack": op7_pack,
    "op8_chat": op8_chat,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_token_counts": op10_token_counts,
}

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP8_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, conv_id + turn AS n, role = 'user' AND conv_id % 4 <> 0 AS tool,
         CASE WHEN role = 'user' AND conv_id % 4 <> 0 THEN 'tool' ELSE role END AS role
  FROM conversations
), calls AS (
  SELECT conv_id, turn, n, 0 AS place, 'c' || turn AS id, CASE WHEN n % 13 = 0 THEN 'unlisted' ELSE 'search' END AS name,
         '{"limit":' || CASE WHEN n % 5 = 0 THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END
           || CASE WHEN n % 7 <> 0 THEN ',"query":"' || md5(text) || '"' ELSE '' END || CASE WHEN n % 11 = 0 THEN ',"x":null' ELSE '' END || '}' AS arguments,
         CASE WHEN n % 13 = 0 THEN 1 ELSE CAST(n % 7 = 0 AS INT) + CAST(n % 5 = 0 OR length(text) < 100 AS INT) + CAST(n % 11 = 0 AS INT) END AS errors
  FROM m WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id, turn, n, 1, 'd' || CASE WHEN conv_id % 10 = 9 THEN '' ELSE CAST(turn AS VARCHAR) END, 'lookup', '{"key":' || turn || '}', 0
  FROM m WHERE role = 'assistant'
), owned AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS copy FROM calls) WHERE copy = 1
), edges AS (
  SELECT o.conv_id, o.id, w.id AS wanted FROM owned o JOIN owned w ON w.conv_id = o.conv_id AND (
    (o.place = 0 AND w.id = 'c' || (o.turn - 2)) OR (o.n % 17 = 0 AND w.place <> o.place AND w.id = CASE WHEN o.place = 1 THEN 'c' || o.turn WHEN o.conv_id % 10 = 9 THEN 'd' ELSE 'd' || o.turn END))
), paths AS (
  SELECT conv_id, id, 0 AS steps FROM owned
  UNION
  SELECT e.conv_id, e.id, p.steps + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.wanted = p.id WHERE p.steps < 1000
), levels AS (
  SELECT conv_id, id, CASE WHEN max(steps) < 1000 THEN max(steps) END AS level FROM paths GROUP BY ALL
), results AS (
  SELECT conv_id, turn, CASE n % 6 WHEN 0 THEN 'c' || (turn - 1) WHEN 1 THEN 'd' || (turn - 1) WHEN 2 THEN 'c' || (turn + 1) WHEN 3 THEN 'zz' WHEN 4 THEN 'c1' END AS call_id
  FROM m WHERE tool
), linked AS (
  SELECT r.conv_id, r.turn, r.call_id, o.turn AS call_turn, o.place AS call_place, l.level AS call_level,
         min(CASE WHEN r.turn >= o.turn THEN r.turn END) OVER (PARTITION BY r.conv_id, r.call_id) AS answer
  FROM results r LEFT JOIN owned o ON o.conv_id = r.conv_id AND o.id = r.call_id LEFT JOIN levels l ON l.conv_id = o.conv_id AND l.id = o.id
  WHERE r.call_id IS NOT NULL
), judged AS (
  SELECT *, CASE WHEN call_turn IS NULL THEN 'orphan' WHEN turn < call_turn THEN 'early' WHEN turn = answer THEN 'linked' ELSE 'duplicate' END AS status FROM linked
), callers AS (
  SELECT c.conv_id, c.turn, count(*) AS n_calls, count(a.conv_id) AS n_answered,
         sum(c.errors) + count(*) FILTER (WHERE o.id IS NOT NULL AND l.level IS NULL) AS n_errors,
         string_agg('{"arguments":' || c.arguments || ',"id":"' || c.id || '","name":"' || c.name || '"}', ',' ORDER BY c.place) AS told
  FROM calls c LEFT JOIN owned o ON o.conv_id = c.conv_id AND o.id = c.id AND o.turn = c.turn
  LEFT JOIN levels l ON l.conv_id = o.conv_id AND l.id = o.id
  LEFT JOIN (SELECT conv_id, call_id FROM judged WHERE status = 'linked') a ON a.conv_id = o.conv_id AND a.call_id = o.id
  GROUP BY ALL
)
SELECT m.conv_id, m.turn, m.role, CASE WHEN j.status IN ('linked', 'duplicate') THEN j.call_turn ELSE m.turn END AS anchor,
       CASE WHEN j.status IN ('linked', 'duplicate') THEN 1 ELSE 0 END AS slot,
       CAST(CASE WHEN j.status IN ('linked', 'duplicate') THEN coalesce(j.call_level, 1073741824) ELSE 0 END AS INTEGER) AS level,
       CASE WHEN j.status IN ('linked', 'duplicate') THEN j.call_place ELSE 0 END AS place,
       coalesce(c.n_calls, 0) AS n_calls, coalesce(c.n_answered, 0) AS n_answered, CAST(coalesce(c.n_errors, 0) AS BIGINT) AS n_errors,
       CASE WHEN m.tool THEN coalesce(j.status, 'unmarked') END AS status,
       '{"content":' || to_json(m.text) || ',"role":"' || m.role || '"' || CASE WHEN j.call_id IS NOT NULL THEN ',"tool_call_id":"' || j.call_id || '"' ELSE '' END
         || CASE WHEN c.told IS NOT NULL THEN ',"tool_calls":[' || c.told || ']' ELSE '' END || '}' AS message
FROM m LEFT JOIN judged j ON j.conv_id = m.conv_id AND j.turn = m.turn LEFT JOIN callers c ON c.conv_id = m.conv_id AND c.turn = m.turn
"""

ORACLE_SQL: dict[str, str] = {"op3_exact": OP3_SQL, "op8_chat": OP8_SQL, "op9_exact_top_k": OP9_SQL}
