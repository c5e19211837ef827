"""Messages for a model of the caller's, built for batches of questions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.answer import INSUFFICIENT, history_window

MESSAGE = "array<struct<role:string,content:string>>"
INSTRUCTIONS = f"Answer from the numbered passages only and cite them, like [1]. If they do not hold the answer, say: {INSUFFICIENT}"
RATING = "Rate from 0 to 10 how well each passage answers the question. Reply with a JSON object from passage number to rating."


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(questions: DataFrame, contexts: DataFrame, history: DataFrame | None = None, turns: int = 6, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(qid, messages) for questions (qid, question[, conv_id]) and contexts (qid, context): instructions, the last turns, the question.

    ``history`` is (conv_id, turn, role, text); only user and assistant turns are replayed, so that no stored turn can give instructions.
    """
    asked = questions.join(contexts.select("qid", "context"), "qid", "left")
    past = F.array().cast(MESSAGE)
    if history is not None:
        recent = history_window(history, max(0, turns)).groupBy(F.col("conv_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("place", "role", F.col("text").alias("content")))).alias("_past"))
        asked = asked.join(recent, F.col("conv_id") == F.col("_c"), "left")
        past = F.coalesce(F.transform("_past", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), past)
    final = F.concat(F.lit("Passages:\n\n"), F.trim(F.coalesce("context", F.lit(""))), F.lit("\n\nQuestion: "), F.trim("question"))
    return asked.select("qid", F.concat(F.array(_message("system", F.lit(instructions))), past, F.array(_message("user", final))).cast(MESSAGE).alias("messages"))


def flatten_messages(messages: Column) -> Column:
    """One text of all messages that say something, blank lines between."""
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda t: t != ""), "\n\n")


def fold_system(messages: Column) -> Column:
    """(system, rest): all instructions as one text, and the other messages."""
    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])
    return F.struct(F.array_join(system, "\n\n").alias("system"), F.filter(messages, lambda m: m["role"] != "system").alias("rest"))


def rating_prompts(questions: DataFrame, candidates: DataFrame, most_chars: int = 1600) -> DataFrame:
    """(qid, prompt) that asks a judge to rate candidates (qid, rank, text, heading) by their place; ids are not shown."""
    body = F.array_join(F.filter(F.split(F.substring("text", 1, most_chars), r"\s+"), lambda w: w != ""), " ")
    label = F.when(F.coalesce("heading", F.lit("")) == "", "").otherwise(F.concat(F.lit("("), F.col("heading"), F.lit(") ")))
    listed = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(label, body).alias("t")))).alias("p"))
    lines = F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"]))
    return listed.join(questions.select("qid", "question"), "qid").select("qid", F.concat(F.lit(RATING + "\n\nQuestion: "), F.trim("question"), F.lit("\n\n"), F.array_join(lines, "\n\n")).alias("prompt"))
