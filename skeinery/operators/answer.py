"""Answers in words: a context within a token budget, a mode, a prompt, one call of a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinery.functions import text as T

NOTHING = "No relevant code found."


def with_budget(context: DataFrame, max_tokens, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """``context`` (query_id, rank, file, path, score, text) with section, up to the first that would pass the budget.

    The first section always stays. Counts aren't negative, so the running sum ends the prefix exactly there.
    """
    parts = context.withColumn("section", T.section(*(F.col(c) for c in ("rank", "file", "path", "score", "text"))))
    running = F.sum(count(F.col("section"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("rank").over(Window.partitionBy("query_id"))
    limit = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    return parts.withColumns({"running_tokens": running, "first": first}).filter((F.col("rank") == F.col("first")) | (F.col("running_tokens") <= limit)).drop("first")


def prompts(questions: DataFrame, context: DataFrame, max_tokens: int = 4000, role: str = "You are a senior engineer.") -> DataFrame:
    """``questions`` (query_id, query, mode or null) as (query_id, mode, prompt, context, n_contexts); prompt is null without context."""
    joined = with_budget(context, max_tokens).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "section"))).alias("parts"))
    all_ = context.groupBy("query_id").agg(F.count("*").alias("n_contexts"))
    rows = questions.join(all_, "query_id", "left").join(joined, "query_id", "left").withColumn("n_contexts", F.coalesce("n_contexts", F.lit(0)))
    text = F.array_join(F.transform("parts", lambda p: p["section"]), "\n\n")
    mode = T.mode_fallback(F.coalesce("mode", T.detect_mode(F.col("query"))), F.col("n_contexts"))
    rows = rows.withColumns({"context": text, "mode": mode})
    rules = "Use the code below and nothing else. Say so when you are not sure. Name the files you rely on."
    prompt = F.format_string(role + "\n\n%s\n" + rules + "\n\nQuestion:\n%s\n\nCode:\n%s\n", T.instruction(F.col("mode")), F.col("query"), F.col("context"))
    return rows.select("query_id", "query", "mode", "n_contexts", "context", F.when(F.col("n_contexts") > 0, prompt).alias("prompt"))


def ask(question: str, search: Callable[[DataFrame, int], DataFrame], complete: Callable[[str], str], spark, mode: str | None = None, top_k: int = 12, max_tokens: int = 4000) -> str:
    """One question, one call of ``complete``; its failure is returned as text with the beginning of the context."""
    questions = spark.createDataFrame([(0, question, mode)], "query_id long, query string, mode string")
    found = search(questions.select("query_id", "query"), top_k)
    row = prompts(questions, found, max_tokens).first()
    if not row.n_contexts:
        return NOTHING
    try:
        return complete(row.prompt)
    except Exception as e:
        return f"LLM error: {e}\n\nContext was:\n{row.context[:1000]}"
