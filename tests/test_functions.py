"""Golden cases of rounding, text, labels and chat rendering."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatgauge.functions import chat
from chatgauge.functions.labels import clean_classes, extract_label, extract_label_by_row
from chatgauge.functions.rounding import printed_sql, round_exact
from chatgauge.functions.text import is_truncated, truncate_tokens
from chatgauge.schema import ANSWER_OPEN

HDFS = ["ANOMALY", "NORMAL"]
CVE = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
PHISHING = ["PHISHING", "LEGITIMATE"]


def test_rounding_agrees_with_python_on_all_small_fractions(spark):
    pairs = (
        spark.range(1, 401).withColumnRenamed("id", "b")
        .selectExpr("b", "explode(sequence(0L, b)) AS a").selectExpr("a / CAST(b AS DOUBLE) AS x")
    )
    rows = pairs.select("x", round_exact("x", 4).alias("r4"), round_exact("x", 1).alias("r1")).collect()
    assert len(rows) > 80000
    assert [r for r in rows if r["r4"] != round(r["x"], 4) or r["r1"] != round(r["x"], 1)] == []


def test_rounding_of_other_values(spark):
    rng = random.Random(7)
    values = [1 / 32, 5 / 32, 1 / 4000, 7 / 160, 1 / 160, 0.0, 95.5, 94.5, 1e17, -1 / 160, 123456.78125, 2.675, 1e300]
    values += [rng.uniform(0, 10**rng.randint(0, 7)) for _ in range(3000)]
    values += [rng.randint(0, 10**7) / 2**rng.randint(0, 12) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    rows = df.select("x", *[round_exact("x", d).alias(f"r{d}") for d in (0, 1, 4)]).collect()
    bad = [(r["x"], d) for r in rows for d in (0, 1, 4) if r[f"r{d}"] != round(r["x"], d)]
    assert bad == []


def test_printed_decimals(spark):
    row = spark.sql(f"SELECT {printed_sql('0.0312D', 4)} AS a, {printed_sql('96D', 0)} AS b, {printed_sql('7D', 1)} AS c").first()
    assert tuple(row) == ("0.0312", "96", "7.0")


LABEL_CASES = [
    ("ANOMALY. Reason: x", HDFS, "ANOMALY"),
    ("this is normal", HDFS, "NORMAL"),
    ("no idea", HDFS, "ANOMALY"),
    ("ANOMALY_X then NORMAL", HDFS, "NORMAL"),
    ("NORMAL, not ANOMALY", HDFS, "ANOMALY"),
    ("phishing, not legitimate", PHISHING, "LEGITIMATE"),
    ("highly likely LOW", CVE, "LOW"),
    ("low/high", CVE, "HIGH"),
    ("HIGH1 LOW", CVE, "LOW"),
    ("éNORMAL", HDFS, "ANOMALY"),
    ("NORMALé", HDFS, "ANOMALY"),
    ("ⅧHIGH low", CVE, "LOW"),
    ("ANOMALÝ normal", HDFS, "ANOMALY"),
    ("\U0001d400NORMAL", HDFS, "ANOMALY"),
    ("\U0001f600NORMAL", HDFS, "NORMAL"),
    ("", CVE, "CRITICAL"),
    ("line\nlow\nline", CVE, "LOW"),
    ("very high risk", ["LOW RISK", "HIGH RISK", "HIGH"], "HIGH RISK"),
    ("a.b or axb", ["X.Y", "A.B", "AXB"], "A.B"),
]


def python_label(text, classes):
    for name in sorted(classes, key=len, reverse=True):
        if re.search(r"\b" + re.escape(name.upper()) + r"\b", text.upper()):
            return name.upper()
    return classes[0].upper()


@pytest.mark.parametrize("text,classes,expected", LABEL_CASES)
def test_labels(spark, text, classes, expected):
    assert python_label(text, classes) == expected
    df = spark.createDataFrame([(text, [c.lower() for c in classes])], "text STRING, classes ARRAY<STRING>")
    row = df.select(extract_label("text", classes).alias("a"), extract_label_by_row("text", "classes").alias("b")).first()
    assert (row["a"], row["b"]) == (expected, expected)


def test_labels_of_random_texts_agree_with_python(spark):
    rng = random.Random(3)
    bits = ["HIGH", "low", "Medium", "critical", "_", " ", "-", "é", "1", "x", "\n", "Ⅷ", "ß", "。", "İ", "\U0001d400", "\U0001f600", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    rows = spark.createDataFrame([(t, CVE) for t in texts], "t STRING, c ARRAY<STRING>").select(
        "t", extract_label("t", CVE).alias("l"), extract_label_by_row("t", "c").alias("m")).collect()
    assert [tuple(r) for r in rows if {r["l"], r["m"]} != {python_label(r["t"], CVE)}] == []


def test_null_text_has_no_label(spark):
    df = spark.createDataFrame([(None,)], "t STRING")
    assert df.select(extract_label("t", CVE)).first()[0] is None


@pytest.mark.parametrize("classes", [[], ["A", "a"], ["C++"], ["-x"]])
def test_bad_class_lists(classes):
    with pytest.raises(ValueError):
        clean_classes(classes)


CHATS = [
    ([("system", "s"), ("user", "u"), ("assistant", "a")], "a", 2),
    ([("user", "q")], None, 0),
    ([("assistant", "x"), ("user", "t")], "x", 1),
    ([("user", "u"), ("assistant", "A"), ("user", "v"), ("assistant", "")], "", 3),
    ([], None, 0),
    ([("user", None), ("assistant", "a")], "a", 1),
]


@pytest.mark.parametrize("turns,answer,asked", CHATS)
def test_chat_functions(spark, turns, answer, asked):
    df = spark.createDataFrame([(turns,)], "m ARRAY<STRUCT<role: STRING, content: STRING>>")
    row = df.select(
        chat.last_assistant("m").alias("answer"), F.size(chat.prompt_messages("m")).alias("asked"),
        chat.render_chat("m").alias("text"), chat.render_prompt(chat.asked_sql("m")).alias("prompt"),
    ).first()
    rendered = [f"<|im_start|>{r}\n{c or ''}<|im_end|>" for r, c in turns]
    assert (row["answer"], row["asked"]) == (answer, asked)
    assert row["text"] == "\n".join(rendered)
    assert row["prompt"] == "\n".join(rendered[:-1] + [ANSWER_OPEN])


def test_prompt_before_answer_does_not_leak(spark):
    turns = [("user", "u"), ("assistant", "A"), ("user", "thanks")]
    df = spark.createDataFrame([(turns,)], "m ARRAY<STRUCT<role: STRING, content: STRING>>")
    assert df.select(F.size(chat.prompt_before_answer("m"))).first()[0] == 1


@pytest.mark.parametrize("text,n,kept,cut", [
    ("a b c", 3, "a b c", False), ("a b c ", 3, "a b c ", False), ("a  b\nc d", 3, "a  b\nc", True),
    (" a b", 1, " a", True), ("", 2, "", False), ("  ", 1, "  ", False), ("one", 1, "one", False), (None, 2, None, False),
])
def test_truncation(spark, text, n, kept, cut):
    df = spark.createDataFrame([(text,)], "t STRING")
    row = df.select(truncate_tokens("t", n).alias("kept"), is_truncated("t", n).alias("cut")).first()
    assert (row["kept"], bool(row["cut"])) == (kept, cut)
