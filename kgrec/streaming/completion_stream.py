"""Structured Streaming front for the batch completion job.

New prompt files landing in a folder are picked up incrementally; each micro-batch answers only the
prompts that have no stored answer yet (anti-join against the answer table) and appends the answers.
The stream's checkpoint records which files were consumed, and the anti-join makes a replayed
micro-batch (after a lost executor or driver restart) idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgrec.operators.complete import CompletionFn, append_answers, keyword_completion, run_completions
from kgrec.sources.files import exists

PROMPT_SCHEMA = "item_id bigint, prompt string"


def start_completion_stream(spark: SparkSession, prompt_dir: str, answer_dir: str, checkpoint_location: str,
                            fn: CompletionFn = keyword_completion, key: str = "item_id",
                            schema: str = PROMPT_SCHEMA, available_now: bool = True):
    """Start the stream; with ``available_now`` it drains what is there and stops."""
    prompts = spark.readStream.schema(schema).parquet(prompt_dir)

    def answer_batch(batch: DataFrame, epoch_id: int) -> None:
        answers = spark.read.parquet(answer_dir) if exists(spark, answer_dir) else None
        append_answers(run_completions(batch, key, fn, answers=answers), answer_dir)

    writer = prompts.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
