"""Predictors, stored answers, whole plans and the trained classifier."""

import os

import pytest

from chatgauge.catalog.predictors import keyword_predictor
from chatgauge.operators.classifier import bounded, choose_penalty, fit_label_model, predict_labels, training_rows
from chatgauge.operators.score import prepare, respond, score_examples
from chatgauge.plans.evaluation import evaluate, evaluate_stored
from chatgauge.session import clean_up, cut_lineage, new_folder, run_folder, shared_folder
from chatgauge.sources.specs import task_specs

CHATS = "task STRING, example_id BIGINT, seq BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING>>"
SPECS = task_specs([
    {"task": "mail", "classes": ["phishing", "legitimate"], "max_test_samples": 50},
    {"task": "cve", "task_type": "multiclass", "max_test_samples": 1000},
])


def mail(i):
    user = f"please click {i}" if i % 3 == 0 else f"see you at {i}"
    answer = "Phishing. Reason: link" if i % 3 == 0 or i % 7 == 0 else "legitimate"
    turns = [("user", user), ("assistant", answer)]
    return ("mail", i, i, turns if i % 10 else turns[:1])


def cve(i):
    return ("cve", i, i, [("user", f"bug {i}"), ("assistant", ["HIGH", "low", "Critical!", ""][i % 4])])


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([mail(i) for i in range(80)] + [cve(i) for i in range(40)], CHATS).repartition(6).cache()


def mail_truth(i):
    return None if i % 10 == 0 else "PHISHING" if i % 3 == 0 or i % 7 == 0 else "LEGITIMATE"


def test_predictor_gets_each_answered_prompt_once(spark, chats):
    def shouting():
        return lambda prompts: [p.upper() for p in prompts]

    rows = respond(prepare(chats, SPECS), shouting).where("task = 'mail'").collect()
    assert len(rows) == 80
    for r in rows:
        i = r["example_id"]
        assert r["expected"] == mail_truth(i)
        assert r["response"] == (None if i % 10 == 0 else f"<|im_start|>user\n{mail(i)[3][0][1]}<|im_end|>\n<|im_start|>assistant\n".upper())


def test_scoring_and_evaluation_with_caps(spark, chats):
    factory = keyword_predictor("click", "phishing", "legitimate")
    result = evaluate(chats, SPECS, factory)
    rows = {r["task"]: r for r in result.metrics.collect()}
    kept = range(50)
    guess = {i: "PHISHING" if i % 3 == 0 else "LEGITIMATE" for i in kept}
    m = rows["mail"]
    assert (m["total_samples"], m["evaluated"]) == (50, sum(mail_truth(i) is not None for i in kept))
    assert m["correct"] == sum(mail_truth(i) == guess[i] for i in kept)
    assert m["fn"] == sum(mail_truth(i) == "PHISHING" and guess[i] != "PHISHING" for i in kept)
    c = rows["cve"]  # neither answer names a severity, so the first class is predicted
    assert (c["total_samples"], c["evaluated"], c["correct"]) == (40, 30, 10)
    assert {r["task"] for r in result.lines().collect()} == {"mail", "cve"}


def test_kept_counts_do_not_score_again(spark, chats):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def predict(prompts):
            calls.add(len(prompts))
            return ["high"] * len(prompts)
        return predict

    result = evaluate(chats, SPECS, counting, keep=True)
    once = calls.value
    result.metrics.collect(), result.per_class.collect()
    assert calls.value == once == 45 + 30


def test_stored_answers(spark, chats):
    answers = spark.createDataFrame([("mail", i, "phishing" if i % 2 else "legitimate") for i in range(70) if i != 5], "task STRING, example_id BIGINT, response STRING")
    m = {r["task"]: r for r in evaluate_stored(chats, SPECS, answers).metrics.collect()}["mail"]
    kept = [i for i in range(50) if i % 10]
    assert m["total_samples"] == 50
    assert m["correct"] == sum(mail_truth(i) == ("PHISHING" if i % 2 else "LEGITIMATE") for i in kept if i != 5)
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == len(kept)


def test_results_do_not_depend_on_partitioning(spark, chats):
    factory = keyword_predictor("click", "phishing", "legitimate")
    few, many = [sorted(score_examples(chats.repartition(n), SPECS, factory).collect(), key=str) for n in (1, 9)]
    assert few == many


def test_hidden_answer(spark):
    df = spark.createDataFrame([("mail", 1, 1, [("user", "u"), ("assistant", "phishing"), ("user", "thanks")])], CHATS)
    leaky, clean = prepare(df, SPECS).first()["prompt"], prepare(df, SPECS, hide_answer=True).first()["prompt"]
    assert "phishing" in leaky and "phishing" not in clean


def test_classifier_learns_a_keyword(spark):
    rows = [("mail", i, i, [("user", f"click link {i}" if i % 2 else f"lunch at noon {i}"), ("assistant", "phishing" if i % 2 else "legitimate")]) for i in range(60)]
    data = training_rows(spark.createDataFrame(rows, CHATS), ["phishing", "legitimate"])
    model = fit_label_model(data, ["phishing", "legitimate"], features=1 << 10, iterations=5)
    scored = predict_labels(model, data, ["phishing", "legitimate"])
    assert scored.count() == 60 and scored.where("label <> predicted").count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(5).groupBy().sum("id"))
    assert df.first()[0] == 10
    assert spark.sparkContext.getCheckpointDir() is not None
    assert shared_folder(spark) == shared_folder(spark)


def test_penalty_is_the_strongest_within_a_standard_error():
    assert choose_penalty([(10.0, (0.50, 0.01)), (1.0, (0.45, 0.02)), (0.1, (0.44, 0.02)), (0.01, (0.60, 0.1))]) == 1.0
    assert choose_penalty([(1.0, (float("inf"), 0.0)), (0.1, (float("inf"), 0.0))]) == 1.0


def test_rows_for_fitting_are_bounded_and_copies_stay_together(spark):
    rows = spark.createDataFrame([(f"text {i // 3}",) for i in range(30)], "prompt STRING")
    kept = [r["prompt"] for r in bounded(rows, 10).collect()]
    assert len(kept) == 9 and all(kept.count(p) == 3 for p in kept)
    assert bounded(rows, 30).count() == 30 and bounded(rows.limit(0), 5).count() == 0


def test_intermediate_tables_can_be_cleaned_up(spark):
    path = new_folder(spark, "trial")
    assert path.startswith(run_folder(spark)) and path != new_folder(spark, "trial")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    clean_up(spark)
    clean_up(spark)  # nothing left to delete
    assert not os.path.exists(run_folder(spark)) and os.path.isdir(shared_folder(spark))
