"""Models over tables: prompts in, answers out, one load a worker.

A model is named ``module:function``; the function takes no argument and returns a callable, which takes a list of inputs
and returns a list of as many outputs. Only the name goes to the workers; each loads the model when it first needs it and
keeps it. Inputs are handed over in batches of about the same length, within a budget of tokens.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.operators import answer


@lru_cache(maxsize=4)
def loaded(name: str) -> Callable[[list], list]:
    """The model, loaded once in a process."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def token_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Places of inputs by length, dealt into batches whose longest times number is at most the budget (one input always fits)."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * max(1, lengths[i]) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _outputs(model: str, inputs: list, lengths: list[int], budget: int) -> list:
    """(output, error) for each input: a batch that fails is tried again one by one, so that one bad input costs one answer."""
    out: list = [None] * len(inputs)
    for batch in token_batches(lengths, budget):
        try:
            got = list(loaded(model)([inputs[i] for i in batch]))
            if len(got) != len(batch):
                raise ValueError(f"{model} gave {len(got)} outputs for {len(batch)} inputs")
            found = [(x, None) for x in got]
        except Exception as e:
            found = [(None, str(e))] if len(batch) == 1 else [_outputs(model, [inputs[i]], [0], budget)[0] for i in batch]
        for i, x in zip(batch, found):
            out[i] = x
    return out


def complete(rows: DataFrame, model: str, prompt: str = "prompt", token_budget: int = 16_384, into: str = "answer", error: str = "error") -> DataFrame:
    """``rows`` with the model's answer and error (null where there is none); a null prompt has neither."""

    @F.arrow_udf("struct<answer: string, error: string>")
    def said(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            own = [i for i, t in enumerate(texts) if t is not None]
            found = dict(zip(own, _outputs(model, [texts[i] for i in own], [len(texts[i].split()) for i in own], token_budget)))
            both = [found.get(i, (None, None)) for i in range(len(texts))]
            yield pa.StructArray.from_arrays([pa.array([None if x[k] is None else str(x[k]) for x in both], pa.string()) for k in (0, 1)], ["answer", "error"])

    asked = rows.withColumn("_said", said.asNondeterministic()(F.col(prompt)))
    return asked.select(*rows.columns, F.col("_said.answer").alias(into), F.col("_said.error").alias(error))


def logits(rows: DataFrame, model: str, query: str = "query", text: str = "text", into: str = "logit", token_budget: int = 16_384) -> DataFrame:
    """``rows`` with a cross-encoder's logit for each pair of query and text; the model takes a list of pairs. An error ends the job: a rank can't be left out."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for queries, texts in batches:
            pairs = [(q or "", t or "") for q, t in zip(queries.to_pylist(), texts.to_pylist())]
            found = _outputs(model, pairs, [len(q.split()) + len(t.split()) for q, t in pairs], token_budget)
            if wrong := next((e for _, e in found if e is not None), None):
                raise RuntimeError(f"{model}: {wrong}")
            yield pa.array([float(x) for x, _ in found], pa.float64())

    return rows.withColumn(into, scored.asNondeterministic()(F.col(query), F.col(text)))


def ask_all(questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], model: str, top_k: int = 12, max_tokens: int = 4000, token_budget: int = 16_384) -> DataFrame:
    """``questions`` (query_id, query, mode or null) as (query_id, query, mode, n_contexts, answer), one row each.

    Without context the answer says so; a failure is an answer too, with the beginning of the context.
    """
    prompts = answer.prompts(questions, search(questions.select("query_id", "query"), top_k), max_tokens)
    got = complete(prompts, model, token_budget=token_budget)
    failed = F.concat(F.lit("LLM error: "), "error", F.lit("\n\nContext was:\n"), F.substring("context", 1, 1000))
    said = F.when(F.col("n_contexts") == 0, answer.NOTHING).when(F.col("error").isNotNull(), failed).otherwise(F.col("answer"))
    return got.select("query_id", "query", "mode", "n_contexts", said.alias("answer"))


__all__ = ["ask_all", "complete", "loaded", "logits", "token_batches"]
