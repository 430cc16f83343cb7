"""Batch completion job (X4) with resume.

Pending prompts are those without a stored answer (``left_anti`` against the answer table); the
completion function runs in Arrow batches (``mapInPandas``) on the executors and its output is
appended to the answer table, so a rerun only handles what is still missing.  The function is a
parameter: a real deployment passes a model client, tests pass a deterministic function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CompletionFn = Callable[[pd.Series], pd.Series]


def keyword_completion(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in model: answers in the requested '<Feature: a, b. Feature: c.>' form,
    built from the words of the prompt."""
    def one(p: str) -> str:
        body = p.split(": ", 1)[-1].rstrip(".")
        words = [w for w in body.replace(";", " ").split() if w]
        genres = ", ".join(words[:2]) or "unknown"
        plot = words[-1] if words else "none"
        return f"<Genres: {genres}. Kind of plot: {plot}.>"
    return prompts.astype(str).map(one)


def pending(prompts: DataFrame, answers: DataFrame | None, key: str) -> DataFrame:
    if answers is None:
        return prompts
    return prompts.join(answers.select(key).distinct(), key, "left_anti")


def complete_each(fn: CompletionFn, prompts: pd.Series) -> list:
    """Answers of a batch; when the batch fails, of each prompt on its own, None where that fails too."""
    try:
        return list(fn(prompts))
    except Exception:  # noqa: BLE001 - isolate the prompts that fail
        out = []
        for k in range(len(prompts)):
            try:
                out.append(list(fn(prompts.iloc[k:k + 1]))[0])
            except Exception:  # noqa: BLE001
                out.append(None)
        return out


def run_completions(prompts: DataFrame, key: str, fn: CompletionFn = keyword_completion,
                    answers: DataFrame | None = None) -> DataFrame:
    """``(key, prompt, plain)`` for every key without an answer yet, one row a key (its smallest prompt).

    A prompt on which the completion function raises is left out, so it stays pending for the next run.
    """
    once = prompts.groupBy(key).agg(F.min("prompt").alias("prompt"))
    todo = pending(once, answers, key)
    key_type = prompts.schema[key].dataType.simpleString()

    def run(it):
        for pdf in it:
            if pdf.empty:
                continue
            out = pdf[[key, "prompt"]].copy()
            out["plain"] = complete_each(fn, pdf["prompt"])
            yield out[out["plain"].notna()]

    return todo.mapInPandas(run, f"{key} {key_type}, prompt string, plain string")


def append_answers(done: DataFrame, path: str) -> None:
    """Append new answers to the answer table (parquet, partitioned by nothing: one table)."""
    done.withColumn("answered_at", F.current_timestamp()).write.mode("append").parquet(path)
