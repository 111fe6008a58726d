"""Distinct prompts asked once, restarts, and the number of scoring tasks."""

import os

import pytest

from chatgauge.operators.score import prepare, respond, respond_once, scoring_tasks
from chatgauge.plans.evaluation import evaluate, evaluate_scored
from chatgauge.operators.score import score_examples
from chatgauge.sources.specs import task_specs

CHATS = "task STRING, example_id BIGINT, seq BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>"
SPECS = task_specs([{"task": "t", "classes": ["yes", "no"], "max_test_samples": None}])


def chat(i):
    # a third of all rows share one prompt; every tenth has no answer
    turns = [("user", "same" if i % 3 == 0 else f"prompt {i % 20}"), ("assistant", "yes" if i % 2 else "no")]
    return ("t", i, i, turns if i % 10 else turns[:1])


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(spark.createDataFrame([chat(i) for i in range(300)], CHATS).repartition(5), SPECS)


def logging_factory(folder, broken=()):
    """A predictor that writes what it is asked to a file of its own, and fails on some prompts."""

    def factory():
        def predict(prompts):
            for p in prompts:
                if any(f"user\n{b}<" in p for b in broken):
                    raise RuntimeError("lost")
            with open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w") as out:
                out.write("".join(p.replace("\n", " ") + "\n" for p in prompts))
            return ["Yes." if "same" in p else f"no: {len(p)}" for p in prompts]

        return predict

    return factory


def asked(folder):
    return sorted(line for f in os.listdir(folder) for line in open(os.path.join(folder, f)))


def test_each_distinct_prompt_is_asked_once(spark, prepared, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    once = respond_once(prepared, logging_factory(str(log)), f"{tmp_path}/work", waves=3)
    rows = sorted(once.collect())
    distinct = {r["prompt"] for r in prepared.collect() if r["prompt"] is not None}
    assert len(asked(log)) == len(distinct) == len(set(asked(log)))
    plain = tmp_path / "plain"
    plain.mkdir()
    assert rows == sorted(respond(prepared, logging_factory(str(plain))).select(once.columns).collect())
    assert len(rows) == 300 and sum(r["response"] is None for r in rows) == 30
    # a second call with the folder asks nothing
    respond_once(prepared, logging_factory(str(log)), f"{tmp_path}/work", waves=3).collect()
    assert len(asked(log)) == len(distinct)


def test_a_restart_goes_on_after_finished_waves(spark, prepared, tmp_path):
    log, work = tmp_path / "log", f"{tmp_path}/work"
    log.mkdir()
    prompts = sorted({r["prompt"] for r in prepared.collect() if r["prompt"] is not None})
    broken = prompts[len(prompts) // 2].split("user\n")[1].split("<")[0]
    with pytest.raises(Exception, match="lost"):
        respond_once(prepared, logging_factory(str(log), [broken]), work, waves=6)
    finished = {r["step"] for r in spark.read.parquet(f"{work}/finished").collect()}
    stored = [spark.read.parquet(f"{work}/answers-6-{k}").count() for k in range(6) if f"6-{k}" in finished]
    assert "prompts" in finished and len(stored) < 6
    for f in os.listdir(log):
        os.rename(log / f, tmp_path / f"first-{f}")
    rows = respond_once(prepared, logging_factory(str(log)), work, waves=6).collect()
    assert len(asked(log)) == len(prompts) - sum(stored)  # only what was not finished
    assert len(rows) == 300 and sum(r["response"] is None for r in rows) == 30


def test_evaluation_by_content_equals_the_plain_one(spark, tmp_path):
    examples = spark.createDataFrame([chat(i) for i in range(300)], CHATS)
    factory = lambda: (lambda prompts: ["yes" if "same" in p else "no" for p in prompts])
    plain = evaluate(examples, SPECS, factory, keep=False).metrics.collect()
    once = evaluate_scored(score_examples(examples, SPECS, factory, folder=f"{tmp_path}/w"), SPECS).metrics.collect()
    assert plain == once == evaluate(examples, SPECS, factory, keep=False, folder=f"{tmp_path}/w2").metrics.collect()


def test_empty_examples(spark, tmp_path):
    none = prepare(spark.createDataFrame([], CHATS), SPECS)
    factory = lambda: (lambda prompts: prompts)
    assert respond_once(none, factory, f"{tmp_path}/w").collect() == [] and respond(none, factory).collect() == []


def test_tasks_follow_the_number_of_prompts(spark, prepared):
    assert [scoring_tasks(n, 8, 100) for n in (0, 1, 5, 8, 800, 801, 100_000)] == [1, 1, 5, 8, 8, 9, 1000]
    factory = lambda: (lambda prompts: prompts)
    assert respond(prepared, factory, rows_per_task=10).rdd.getNumPartitions() == 27  # 270 prompts
    assert respond(prepared, factory, rows_per_task=1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert respond(prepared.limit(2), factory).rdd.getNumPartitions() <= 2
    sizes = respond(prepared, factory, rows_per_task=10).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 30  # equal prompts do not meet
