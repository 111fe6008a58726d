"""The word model against counts by hand, written and read, and held-out rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from chatgauge.operators.classifier import fit_word_model, predict_words, read_word_model, train_and_evaluate, weights_of_words

ROWS = [
    (1, "Click the link, click!", "YES"), (2, "lunch at noon", "NO"), (3, "noon link", "NO"), (4, "", "YES"), (5, "the the the", "YES"),
    (6, "Été à noon", "NO"), (7, None, "NO"), (8, "unknown label", "MAYBE"), (9, "click click click", None),
]


def by_hand(train, rows, classes):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    known = [(words(t), c) for _, t, c in train if c in classes]
    seen = {w for ws, _ in known for w in ws}
    out = {}
    for key, text, _ in rows:
        scores = []
        for c in classes:
            own = [w for ws, k in known if k == c for w in ws]
            prior = sum(k == c for _, k in known) / len(known)
            s = math.log(prior) if prior else -math.inf
            scores.append(s + sum(math.log((own.count(w) + 1) / (len(own) + len(seen))) for w in words(text) if w in seen))
        out[key] = classes[scores.index(max(scores))]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "example_id BIGINT, prompt STRING, label STRING").repartition(3)


@pytest.mark.parametrize("classes", [["yes", "no"], ["no", "yes"], ["yes", "no", "maybe"], ["other", "no"]])
def test_predictions_equal_counts_by_hand(rows, classes):
    got = {r["example_id"]: r["predicted"] for r in predict_words(fit_word_model(rows, classes), rows).collect()}
    assert got == by_hand(ROWS, ROWS, [c.upper() for c in classes])


@pytest.mark.parametrize("share", [0.0, 0.15, 2.0])
def test_common_words_add_up_with_the_others(rows, monkeypatch, share):
    monkeypatch.setattr("chatgauge.operators.classifier.COMMON", share)
    got = {r["example_id"]: r["predicted"] for r in predict_words(fit_word_model(rows, ["yes", "no"]), rows).collect()}
    assert got == by_hand(ROWS, ROWS, ["YES", "NO"])


def test_a_word_of_every_text_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr("chatgauge.operators.classifier.COMMON", 0.01)
    data = [(i, f"the the own{i} a{i} b{i} the", "YES" if i % 2 else "NO") for i in range(200)]
    rows = spark.createDataFrame(data, "example_id BIGINT, prompt STRING, label STRING")
    words = rows.selectExpr("example_id", "explode(split(prompt, ' ')) AS word")
    common, others = weights_of_words(fit_word_model(rows, ["yes", "no", "never"]), words)
    assert [(r["word"], r["n"]) for r in common.groupBy("word").agg(F.count("*").alias("n")).collect()] == [("the", 600)]
    rest = others.groupBy("word").agg(F.count("*").alias("n")).collect()
    assert len(rest) == 600 and {r["n"] for r in rest} == {1}
    plan = common._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(word" not in plan


def test_written_weights_give_the_same_predictions(spark, rows, tmp_path):
    model = fit_word_model(rows, ["yes", "no"])
    model.write(f"{tmp_path}/m")
    again = read_word_model(spark, f"{tmp_path}/m")
    assert again.classes == ("YES", "NO")
    assert sorted(predict_words(again, rows).collect(), key=str) == sorted(predict_words(model, rows).collect(), key=str)
    # and anybody who reads the table can make a score again
    w = {r["word"]: r["w"] for r in spark.read.parquet(f"{tmp_path}/m/weights").collect()}
    assert w["click"] == pytest.approx([math.log(3 / (7 + 8)), math.log(1 / (8 + 8))])


def test_held_out_rows_are_not_learned_from(spark):
    data = [(i, f"{'click' if i % 2 else 'lunch'} word{i % 13} own{i}", "YES" if i % 2 else "NO") for i in range(400)]
    data += [(1000 + i, "lunch lunch", "YES") for i in range(300)]  # wrong labels, all held out
    rows = spark.createDataFrame(data, "example_id BIGINT, prompt STRING, label STRING")
    _, found = train_and_evaluate(rows, ["yes", "no"], (F.col("example_id") >= 300))
    made = {r["example_id"]: r for r in found.collect()}
    assert len(made) == 700 and sum(r["held_out"] for r in made.values()) == 400
    assert all(made[i]["predicted"] == ("YES" if i % 2 else "NO") for i in range(400))
    assert all(made[1000 + i]["predicted"] == "NO" for i in range(300))


def test_empty_tables(spark, rows):
    model = fit_word_model(rows, ["yes", "no"])
    assert predict_words(model, rows.limit(0)).count() == 0
    nothing = fit_word_model(rows.limit(0), ["yes", "no"])
    assert {r["predicted"] for r in predict_words(nothing, rows).collect()} == {"YES"}
