"""Batch scoring: examples to (expected, response), then to labels.

A predictor is a factory: called once in each Python worker task, it returns a
function from a list of prompt texts to a list of answer texts.

Prompts are dealt over tasks of ROWS_PER_TASK prompts, whatever the number of cores (few
prompts are spread over the cores). Equal prompts have equal answers, so ``respond_once``
asks each distinct prompt once and keeps finished waves, from which a restart goes on.
"""

from typing import Callable, Iterator, List

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chat import answer_sql, asked_sql, before_answer_sql, prompt_sql
from ..functions.labels import task_label_sql
from .subwords import capped

Predictor = Callable[[List[str]], List[str]]
#: Prompts of a task: long enough to make up for opening a model, short enough to be repeated when an executor is lost.
ROWS_PER_TASK = 2_000
#: Share of the work that a restart may have to repeat: one wave of so many.
WAVES = 8


def prepare(examples: DataFrame, specs, max_tokens=None, hide_answer=False, vocabulary=None, template=None) -> DataFrame:
    """(task, example_id, expected, prompt) of (task, example_id, messages).

    Examples without ground truth stay, with null in both, since they count in n.
    Only the label of the answer is carried on, not its text. ``max_tokens`` counts tokens of
    the vocabulary, or blank-separated ones without it. ``template`` is a model's ``ChatTemplate``.
    """
    asked = before_answer_sql("messages") if hide_answer else asked_sql("messages")
    rendered = template.prompt_sql if template else prompt_sql
    texts = examples.selectExpr("task", "example_id", "messages", f"nullif({answer_sql('messages')}, '') AS answer").selectExpr(
        "task", "example_id", "answer", f"if(answer IS NULL, NULL, {rendered(asked)}) AS prompt"
    )
    labelled = texts.selectExpr("task", "example_id", f"{task_label_sql('answer', 'task', specs)} AS expected", "prompt")
    return capped(labelled, "prompt", max_tokens, vocabulary) if max_tokens else labelled


def scoring_tasks(n, cores, rows_per_task=ROWS_PER_TASK) -> int:
    """Tasks for n prompts: by their number, and as many as cores while there are few."""
    return max(1, -(-n // rows_per_task), min(cores, n))


def _predicted(df: DataFrame, factory, kept) -> DataFrame:
    """``kept`` columns and ``response``, the predictor's answer to ``prompt`` (null for null)."""
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for batch in batches:
            out = batch[kept].copy()
            asked = batch["prompt"].notna()
            answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if asked.any():
                answers[asked] = list(predict(batch.loc[asked, "prompt"].tolist()))
            out["response"] = answers
            yield out

    return df.mapInPandas(run, schema)


def respond(prepared: DataFrame, factory: Callable[[], Predictor], tasks=None, rows_per_task=ROWS_PER_TASK) -> DataFrame:
    """Replace ``prompt`` by the predictor's ``response``; rows without a prompt get null.

    The number of tasks follows that of the prompts, which are counted first unless ``tasks``
    is given. Rows are dealt by their key, so nothing has to be sorted for it.
    """
    if tasks is None:
        cores = prepared.sparkSession.sparkContext.defaultParallelism
        tasks = scoring_tasks(prepared.where("prompt IS NOT NULL").count(), cores, rows_per_task)
    return _predicted(prepared.repartition(tasks, "task", "example_id"), factory, [c for c in prepared.columns if c != "prompt"])


def _done(spark, folder) -> set:
    """Steps that are recorded as finished in a scoring folder."""
    try:
        return {r["step"] for r in spark.read.schema("step STRING").parquet(f"{folder}/finished").collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _finish(spark, folder, step):
    spark.createDataFrame([(step,)], "step STRING").coalesce(1).write.mode("append").parquet(f"{folder}/finished")


def respond_once(prepared: DataFrame, factory: Callable[[], Predictor], folder, rows_per_task=ROWS_PER_TASK, waves=WAVES) -> DataFrame:
    """Like ``respond``, but every distinct prompt is asked once, and a restart does not ask again.

    Prompts are told apart by their SHA-256. Distinct ones are stored in ``folder`` (one that
    all executors share), asked in waves by a hash, and each wave's answers stored and
    recorded; a second call with the same folder goes on after the last recorded wave. A lost
    task is asked again within its wave. Answers are joined back by digest, without texts.
    """
    spark = prepared.sparkSession
    keyed = prepared.withColumn("prompt_key", F.sha2("prompt", 256))
    done = _done(spark, folder)
    if "prompts" not in done:
        distinct = keyed.where("prompt IS NOT NULL").select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
        distinct.write.mode("overwrite").parquet(f"{folder}/prompts")
        _finish(spark, folder, "prompts")
    prompts = spark.read.schema("prompt_key STRING, prompt STRING").parquet(f"{folder}/prompts")
    cores, answers = spark.sparkContext.defaultParallelism, None
    for wave in range(waves):
        path = f"{folder}/answers-{waves}-{wave}"
        if f"{waves}-{wave}" not in done:
            part = prompts.where(f"pmod(xxhash64(prompt_key), {waves}) = {wave}")
            tasks = scoring_tasks(part.count(), cores, rows_per_task)
            asked = _predicted(part.repartition(tasks, "prompt_key"), factory, ["prompt_key"])
            asked.write.mode("overwrite").parquet(path)
            _finish(spark, folder, f"{waves}-{wave}")
        found = spark.read.schema("prompt_key STRING, response STRING").parquet(path)
        answers = found if answers is None else answers.unionAll(found)
    kept = [c for c in prepared.columns if c != "prompt"]
    return keyed.select(*kept, "prompt_key").join(answers, "prompt_key", "left").select(*kept, "response")


def attach_responses(prepared: DataFrame, predictions: DataFrame) -> DataFrame:
    """Use stored answers (task, example_id, response) in place of a predictor.

    Every example stays once: equal stored answers count as one, different ones fail the
    job. One without a stored answer has no label and so counts as
    neither correct nor positive.
    """
    keys = ["task", "example_id"]
    either = predictions.groupBy(*keys).agg(F.min("response").alias("response"), F.max("response").alias("_other"))
    # two different answers to one example would count it twice
    stored = either.selectExpr(
        *keys, "if(response <=> _other, response, CAST(raise_error('an example has two stored answers') AS STRING)) AS response"
    )
    joined = prepared.drop("prompt").join(stored, ["task", "example_id"], "left")
    kept = [c for c in joined.columns if c != "response"]
    return joined.selectExpr(*kept, "if(expected IS NULL, NULL, response) AS response")


def label_responses(responses: DataFrame, specs) -> DataFrame:
    """Turn ``response`` into ``predicted``."""
    kept = [c for c in responses.columns if c != "response"]
    return responses.selectExpr(*kept, f"{task_label_sql('response', 'task', specs)} AS predicted")


def score_examples(examples: DataFrame, specs, factory, folder=None, **options) -> DataFrame:
    """(task, example_id, expected, predicted) for every example.

    With ``folder`` each distinct prompt is asked once and finished work is kept there.
    """
    prepared = prepare(examples, specs, **options)
    answered = respond_once(prepared, factory, folder) if folder else respond(prepared, factory)
    return label_responses(answered, specs)
