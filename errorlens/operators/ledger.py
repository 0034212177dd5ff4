"""Model calls with a ledger (L5): what was answered is never asked again.

A prompt is addressed by the SHA-256 of the model's name and its text. Each run
appends its answers and failures to the ledger folder as its own ``run=<id>``;
tasks hold a few calls each and commit by themselves, so a job that is
killed keeps the calls of all tasks that ended, and the next run asks only
what has no answer yet. Rows stand for themselves, so a run without ``_SUCCESS``
is read like any other.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorlens.operators.state import _fs
from errorlens.session import checkpoint

ROWS = "key string, response string, error string, tries int"


def prompt_key(model: str, prompt_col: str = "prompt"):
    """The content address of a prompt; null for a null prompt."""
    return F.sha2(F.concat(F.lit(f"{model}\0"), F.col(prompt_col)), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per prompt ever asked: ``key``, ``response`` (null: never
    answered), ``error`` (the largest text of its failures if so) and ``tries``,
    the calls made. Rows written twice (a task that ran again) count both."""
    fs, p, _ = _fs(spark, path)
    rows = (spark.read.schema(ROWS).parquet(path) if fs.exists(p) else spark.createDataFrame([], ROWS)).select(
        "key", "response", "error", "tries")
    answer = F.max("response")
    return rows.groupBy("key").agg(answer.alias("response"), F.when(answer.isNull(), F.max("error")).alias("error"),
                                   F.sum("tries").alias("tries"))


def complete_with_ledger(prompts: DataFrame, fn: Callable[[str], str | None], ledger: str, model: str = "",
                         prompt_col: str = "prompt", tries: int = 3, give_up: int = 9, calls_per_task: int = 16,
                         wait: float = 0.0) -> DataFrame:
    """``prompts`` with ``response`` and ``error``, calling ``fn`` once for each
    distinct prompt that ``ledger`` has no answer to.

    A call that raises or returns None is tried again, ``tries`` times in a run
    (``wait`` seconds longer each time) and ``give_up`` times over all runs;
    then ``response`` is null and ``error`` says why. Null prompts are not
    asked and have neither. Equal prompts share one call. ``model`` names the
    model and its version: another name asks anew.

    A killed job loses the calls of running tasks only, ``calls_per_task`` each
    (where the store's committer moves a task's files when the task ends; where
    it publishes whole jobs only, those of the run). One run at a time should
    use a ledger; two at once may ask the same prompt twice, which harms
    nothing else."""
    spark = prompts.sparkSession
    rows = checkpoint(prompts.drop("response", "error").withColumn("_key", prompt_key(model, prompt_col)))
    done = read_ledger(spark, ledger).where(F.col("response").isNotNull() | (F.col("tries") >= give_up))
    due = checkpoint(rows.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key"))
                     .agg(F.min(prompt_col).alias("prompt")).join(done, "key", "left_anti"))

    def call(prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for n in range(1, tries + 1):
            try:
                answer = fn(prompt)
            except Exception as e:  # noqa: BLE001 - recorded, tried again
                error = f"{type(e).__name__}: {e}"
            else:
                if answer is not None:
                    return answer, None, n
                error = "no answer"
            if wait and n < tries:
                time.sleep(wait * n)
        return None, error, tries

    def run(batches):
        for pdf in batches:
            got = [call(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"key": pdf["key"], "response": pd.Series([g[0] for g in got], dtype="object"),
                                "error": pd.Series([g[1] for g in got], dtype="object"),
                                "tries": pd.Series([g[2] for g in got], dtype="int32")})

    n = due.count()
    if n:
        (due.repartition(-(-n // calls_per_task)).mapInPandas(run, ROWS).write
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .parquet(f"{ledger.rstrip('/')}/run={uuid.uuid4().hex}"))
    known = read_ledger(spark, ledger).select(F.col("key").alias("_key"), "response", "error")
    return rows.join(known, "_key", "left").drop("_key")
