"""Nothing is cut, split or counted twice unless asked for."""

import datetime

import pytest
from pyspark.sql import functions as F

from chatgauge.catalog.queries import QUERIES
from chatgauge.functions.rounding import printed_sql
from chatgauge.operators.runs import overfit_flags, run_metrics
from chatgauge.operators.score import attach_responses, prepare, respond
from chatgauge.plans.evaluation import evaluate
from chatgauge.session import shared_folder
from chatgauge.sinks import registry
from chatgauge.sources.specs import task_specs
from chatgauge.sources.turns import answers_from_turns, chats_from_turns, prompts_from_turns

CHATS = "task STRING, example_id BIGINT, seq BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>"


def mails(spark, n, task="mail"):
    return spark.createDataFrame([(task, i, i, [("user", "q"), ("assistant", "yes" if i % 2 else "no")]) for i in range(n)], CHATS)


def always(answer):
    return lambda: lambda prompts: [answer] * len(prompts)


def test_without_a_cap_every_example_is_scored(spark):
    specs = task_specs([{"task": "mail", "classes": ["yes", "no"], "max_test_samples": None}])
    assert evaluate(mails(spark, 700), specs, always("yes"), keep=False).metrics.first()["total_samples"] == 700
    with pytest.raises(Exception, match="no settings for task other"):
        evaluate(mails(spark, 5, "other"), specs, always("yes"), keep=False).metrics.collect()


def test_prompts_are_dealt_over_tasks(spark):
    specs = task_specs([{"task": "mail", "classes": ["yes", "no"]}])
    answered = respond(prepare(mails(spark, 100).coalesce(1), specs), always("yes"), tasks=4)
    assert answered.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_stored_answers_count_once(spark):
    specs = task_specs([{"task": "mail", "classes": ["yes", "no"]}])
    prepared = prepare(mails(spark, 3), specs)
    rows = [("mail", 1, "yes"), ("mail", 1, "yes"), ("mail", 2, None)]
    shape = "task STRING, example_id BIGINT, response STRING"
    assert attach_responses(prepared, spark.createDataFrame(rows, shape)).count() == 3
    with pytest.raises(Exception, match="two stored answers"):
        attach_responses(prepared, spark.createDataFrame(rows + [("mail", 1, "no")], shape)).collect()


def test_a_long_chat_with_gaps_is_one_chat(spark):
    turns = spark.range(6000).selectExpr(
        "7L AS conv_id", "id * 3 + id % 2 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('w', id) AS text"
    ).repartition(5)
    assert [tuple(r) for r in answers_from_turns(turns).collect()] == [(7, 6000, "w5999")]
    chat = chats_from_turns(turns).collect()
    assert len(chat) == 1 and [m["content"] for m in chat[0]["messages"]] == [f"w{i}" for i in range(6000)]
    whole = prompts_from_turns(turns).first()["prompt"]
    assert whole.count("<|im_start|>") == 6000 and "w5998" in whole and "w5999" not in whole
    capped = prompts_from_turns(turns, max_tokens=40, turns_per_part=10).first()["prompt"]
    assert len(capped.split()) == 40 and whole.startswith(capped)


def test_last_answers_gather_no_chat(spark, tmp_path):
    turns = spark.range(6000).selectExpr(
        "if(id < 5000, 7L, 8L) AS conv_id", "id AS turn", "if(id % 2 = 1 AND id < 4998, 'assistant', 'user') AS role", "concat('w', id) AS text"
    )
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["last_assistant"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(7, "w4997", 4999, 4997), (8, None, 999, 1000)]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_capped_prompts_bring_few_pieces(spark):
    turns = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    prompts_from_turns(turns, max_tokens=30, turns_per_part=8).write.format("noop").mode("overwrite").save()
    plan = prompts_from_turns(turns, max_tokens=30, turns_per_part=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "before" in plan and "< 16" in plan


def test_odd_losses_never_fail(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 60.0, 0.5, inf, 1), ("b", 60.0, 0.5, 1e30, 1), ("c", 60.0, 0.5, nan, 1), ("d", 60.0, 0.5, 0.0, 1), ("e", 60.0, inf, inf, 1), ("f", 60.0, nan, 2.0, 1)]
    runs = spark.createDataFrame(rows, "run STRING, train_seconds DOUBLE, train_loss DOUBLE, eval_loss DOUBLE, steps BIGINT")
    warned = {r["run"]: r["overfitting_warning"] for r in overfit_flags(runs).collect()}
    assert "eval_loss (inf)" in warned["a"] and "gap=inf" in warned["a"] and warned["b"] is not None
    assert [warned[k] for k in "cdef"] == [None] * 4
    assert run_metrics(runs).count() == 6
    shown = spark.createDataFrame([(0.1235,), (-inf,), (nan,)], "x DOUBLE").selectExpr(f"{printed_sql('x', 4)} AS t").collect()
    assert [r["t"] for r in shown] == ["0.1235", "-inf", "nan"]


def test_registry_does_not_need_clocks(spark, tmp_path):
    path = f"{tmp_path}/registry"
    shape = "name STRING, task STRING, path STRING, accuracy DOUBLE, f1 DOUBLE, size_mb DOUBLE, seq BIGINT"
    model = spark.createDataFrame([("x", "t", "p", 0.5, 0.5, 1.0, 0)], shape)
    registry.registry_append(model, path)
    registry.registry_remove(spark, path, "x")
    # a writer whose clock is a year behind registers the model again
    late = F.lit(datetime.datetime(2020, 1, 1))
    registry.registry_entries(model, at=late, version=3).write.mode("append").parquet(path)
    assert registry.registry_list(spark, path).count() == 1


def model_rows(spark, *names):
    shape = "name STRING, task STRING, path STRING, accuracy DOUBLE, f1 DOUBLE, size_mb DOUBLE, seq BIGINT"
    return spark.createDataFrame([(n, "t", "p", 0.5, 0.5, 1.0, k) for k, n in enumerate(names)], shape)


def test_a_late_append_is_not_hidden_by_a_removal_that_did_not_see_it(spark, tmp_path):
    path = f"{tmp_path}/registry"
    registry.registry_append(model_rows(spark, "x", "y"), path)
    # a writer takes its version, then another registers and removes, then the first one's rows land
    late = registry.registry_entries(model_rows(spark, "x"), version=registry._next_version(spark, path))
    registry.registry_append(model_rows(spark, "x"), path)
    registry.registry_remove(spark, path, "x")
    assert [r["name"] for r in registry.registry_list(spark, path).collect()] == ["y"]
    late.write.mode("append").parquet(path)
    assert sorted(r["name"] for r in registry.registry_list(spark, path).collect()) == ["x", "y"]


def test_removals_marks_add_up(spark, tmp_path):
    path = f"{tmp_path}/registry"
    registry.registry_append(model_rows(spark, "x", "x", "y"), path)
    marks = registry._alive(registry._log(spark, path)).where("name = 'x'").withColumn("removed", F.lit(True)).collect()
    schema = registry._log(spark, path).schema
    registry.registry_append(model_rows(spark, "x"), path)
    for _ in range(2):  # two removals that have seen the same two entries
        spark.createDataFrame(marks, schema).write.mode("append").parquet(path)
    assert [r["name"] for r in registry.registry_list(spark, path).collect()] == ["y", "x"]
    registry.registry_remove(spark, path, "not there")
    assert registry.registry_list(spark, path).count() == 2


def test_shared_folder_is_made_once_and_only_locally(spark):
    assert shared_folder(spark) == shared_folder(spark)

    class Cluster:
        class sparkContext:
            master = "spark://head:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)
