"""Layout conversion: uniform tables and JSON rows against the same golden cases."""

import json

import pytest

from chatgauge.operators.convert import to_messages
from chatgauge.schema import CVE_UNRATED

CVE_HEAD = "Analyze this CVE:\n\nCVE ID: "
CASES = [
    ({"cve_id": "C-1", "description": "d", "severity": "HIGH"}, CVE_HEAD + "C-1\nDescription: d", "HIGH"),
    ({"description": "d"}, CVE_HEAD + "Unknown\nDescription: d", CVE_UNRATED),
    ({"cve_id": None, "text": "t", "label": 0}, CVE_HEAD + "None\nDescription: t", CVE_UNRATED),
    ({"description": None, "text": "t", "severity": 7}, CVE_HEAD + "Unknown\nDescription: None", "7"),
    ({"cve_id": "x", "label": "0"}, CVE_HEAD + "x\nDescription: ", "0"),
    ({"cve_id": "x", "severity": False, "label": "HIGH"}, CVE_HEAD + "x\nDescription: ", CVE_UNRATED),
    ({"cve_id": "x", "severity": True}, CVE_HEAD + "x\nDescription: ", "True"),
    ({"cve_id": 2.0, "severity": 0.0}, CVE_HEAD + "2.0\nDescription: ", CVE_UNRATED),
    ({"instruction": "i", "input": "x", "output": "o"}, "i\n\nx", "o"),
    ({"instruction": "i", "input": "", "output": None}, "i", "None"),
    ({"instruction": "i", "output": 1e-05}, "i", "1e-05"),
    ({"instruction": None, "output": "o"}, None, "o"),
    ({"question": "q", "answer": 1}, "q", "1"),
    ({"question": None, "answer": 12345678901234567890}, "None", "12345678901234567890"),
    ({"prompt": "p", "completion": "c"}, "p", "c"),
    ({"instruction": "i", "question": "q", "answer": "a"}, "q", "a"),
    ({"description": "d", "question": "q", "answer": "a"}, CVE_HEAD + "Unknown\nDescription: d", CVE_UNRATED),
    ({"instruction": "i"}, None, None),
    ({"text": "t"}, None, None),
    ({"messages": []}, None, None),
    ({"messages": None, "question": "q", "answer": "a"}, None, None),
    ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}], "prompt": "p"}, "u", "a"),
    ([{"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "extra": 1}], "u", "a"),
]


def test_json_rows(spark):
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(CASES)], "id INT, raw STRING")
    found = {r["id"]: r["messages"] for r in to_messages(df).collect()}
    for i, (_, user, answer) in enumerate(CASES):
        if answer is None:
            assert i not in found
        else:
            assert (found[i][-2]["content"], found[i][-1]["content"]) == (user, answer), CASES[i]


def test_json_rows_can_be_kept(spark):
    df = spark.createDataFrame([('{"text": "t"}',), ('{"messages": []}',)], "raw STRING")
    assert [r["messages"] for r in to_messages(df, drop_unknown=False).orderBy("raw").collect()] == [[], None]


@pytest.mark.parametrize("value", [1.0, 0.5, 12345678.5, 1e16, 1.5e-7, 123456789012345.0, 0.0001, 2.5e-4, 1e22, -1e7, 1e-3])
def test_floats_print_like_python(spark, value):
    table = spark.createDataFrame([("q", value)], "question STRING, answer DOUBLE")
    raw = spark.createDataFrame([(json.dumps({"question": "q", "answer": value}),)], "raw STRING")
    for df in (table, raw):
        assert to_messages(df).first()["messages"][2]["content"] == str(value)


TABLES = [
    ("cve_id STRING, description STRING, severity STRING", ("C-1", "d", None), CVE_HEAD + "C-1\nDescription: d", CVE_UNRATED),
    ("description STRING, severity BOOLEAN, label STRING", ("d", False, "HIGH"), CVE_HEAD + "Unknown\nDescription: d", CVE_UNRATED),
    ("cve_id BIGINT, label INT", (7, 3), CVE_HEAD + "7\nDescription: ", "3"),
    ("instruction STRING, input STRING, output STRING", ("i", None, None), "i", "None"),
    ("instruction STRING, input INT, output BOOLEAN", ("i", 5, True), "i\n\n5", "True"),
    ("question STRING, answer STRING, prompt STRING, completion STRING", ("q", "a", "p", "c"), "q", "a"),
    ("prompt STRING, completion DOUBLE", (None, 0.5), "None", "0.5"),
]


@pytest.mark.parametrize("schema,row,user,answer", TABLES)
def test_tables(spark, schema, row, user, answer):
    got = to_messages(spark.createDataFrame([row], schema)).first()["messages"]
    assert [m["role"] for m in got] == ["system", "user", "assistant"]
    assert (got[1]["content"], got[2]["content"]) == (user, answer)


def test_unknown_table_and_nested_values(spark):
    assert to_messages(spark.createDataFrame([("t",)], "text STRING")).count() == 0
    with pytest.raises(TypeError):
        to_messages(spark.createDataFrame([("q", [1])], "question STRING, answer ARRAY<INT>"))
    raw = spark.createDataFrame([('{"question": "q", "answer": [1]}',)], "raw STRING")
    with pytest.raises(Exception, match="cannot print a value"):
        to_messages(raw).collect()


def test_malformed_json_raises(spark):
    with pytest.raises(Exception, match="MALFORMED"):
        to_messages(spark.createDataFrame([('{"question": ',)], "raw STRING")).collect()


def test_json_text_is_parsed_once_whatever_is_filtered_later(spark):
    df = to_messages(spark.createDataFrame([('{"question": "q", "answer": "a"}',)], "raw STRING"))
    later = df.where("messages[2].content = 'a'").selectExpr("size(messages) AS n")
    plan = later._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") == 1 or plan.count("parseJson") == 1
    assert later.first()["n"] == 3


def test_conversion_of_a_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"question": "q", "answer": "a"}\n{"text": "t"}\n')
    lines = spark.readStream.text(str(tmp_path)).withColumnRenamed("value", "raw")
    stream = to_messages(lines).writeStream.format("memory").queryName("converted").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("converted").count() == 1
