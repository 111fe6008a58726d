"""Files, order, limits and chats stored by turn."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatgauge.functions.chat import asked_sql, prompt_sql
from chatgauge.operators.limits import head_n, head_n_per_task, select_cuts
from chatgauge.sources import files
from chatgauge.sources.specs import task_specs
from chatgauge.sources.turns import answers_from_turns, label_chats, messages_from_turns, prepare_turns, prompts_from_turns


def chat_line(i):
    turns = [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": f"a{i}"}]
    return json.dumps({"messages": turns} if i % 2 else turns)


@pytest.fixture(scope="module")
def jsonl(tmp_path_factory):
    """Three files of different sizes, blank lines between, 60 chats in name order."""
    folder = tmp_path_factory.mktemp("jsonl")
    for name, numbers in (("a.jsonl", range(0, 5)), ("b b.jsonl", range(5, 45)), ("c.jsonl", range(45, 60))):
        (folder / name).write_text("\n".join(f"  {chat_line(i)}\t\n \n" for i in numbers))
    return str(folder)


def answers(df):
    return [r["messages"][-1]["content"] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("n", [None, 1, 5, 6, 44, 45, 59, 60, 100])
def test_first_lines_in_file_order(spark, jsonl, n):
    spec = task_specs([{"task": "t", "max_samples": n}])[0]
    assert answers(files.load_train(spark, jsonl, spec)) == [f"a{i}" for i in range(60)][:n]


def test_file_order_with_many_small_splits(spark, jsonl):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = files.read_jsonl(spark, jsonl)
        assert rows.rdd.getNumPartitions() > 5
        assert [json.loads(r["raw"]) for r in rows.orderBy("seq").collect()] == [json.loads(chat_line(i)) for i in range(60)]
        assert files.read_head(spark, jsonl, "jsonl", 17).count() == 17
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_only_needed_files_are_opened(spark, jsonl):
    assert len(files.read_head(spark, jsonl, "jsonl", 5).inputFiles()) == 1
    assert len(files.read_head(spark, jsonl, "jsonl", 6).inputFiles()) == 2


def test_jsonl_with_schema_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n{"a": \n')
    assert [r["a"] for r in files.read_jsonl(spark, str(good), "a INT").orderBy("seq").collect()] == [1, 2]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_jsonl(spark, str(bad), "a INT").collect()


@pytest.mark.parametrize("n", [3, 10, 11, 25])
def test_first_table_rows(spark, tmp_path, n):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id AS answer", "'q' AS question").coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    paths = [f"{tmp_path}/p{i}" for i in (2, 0, 1)]
    rows = files.read_head(spark, paths, "parquet", n).orderBy("seq").collect()
    assert [r["answer"] for r in rows] == list(range(n))


def test_limit_comes_before_conversion(spark, tmp_path):
    rows = [(None if i % 2 else [("user", str(i))],) for i in range(10)]
    spark.createDataFrame(rows, "messages ARRAY<STRUCT<role: STRING, content: STRING>>").coalesce(1).write.parquet(f"{tmp_path}/d")
    spec = task_specs([{"task": "t", "max_samples": 5}])[0]
    assert files.load_train(spark, f"{tmp_path}/d", spec, "parquet").count() == 3


def test_test_set_caps(spark, tmp_path, jsonl):
    spark.range(600).selectExpr("'q' AS question", "id AS answer").coalesce(1).write.parquet(f"{tmp_path}/t")
    unset, few = task_specs([{"task": "a", "max_val_samples": None}, {"task": "b", "max_val_samples": 7}])
    assert files.load_test(spark, f"{tmp_path}/t", unset, "parquet").count() == 600
    assert files.load_test(spark, f"{tmp_path}/t", unset, "parquet", unset=500).count() == 500
    assert files.load_test(spark, f"{tmp_path}/t", few, "parquet").count() == 7
    assert files.load_test(spark, jsonl, unset).count() == 60


def test_splits_and_formats(spark, tmp_path):
    assert files.choose_split("test", ["train", "test"]) == "test"
    assert files.choose_split("test", ["train"]) == "train"
    spark.range(3).write.parquet(f"{tmp_path}/train")
    rows, used = files.read_split(spark, str(tmp_path), "test", ["train"])
    assert (rows.count(), used) == (3, "train")
    with pytest.raises(ValueError):
        files.read_examples(spark, "user/name", "hub")


@pytest.mark.parametrize("n", [0, None, 1, 10, 999, 1000, 2000])
def test_head_n(spark, n):
    df = spark.range(1000).selectExpr("id * 7919 % 100003 AS seq", "id").repartition(5)
    want = sorted(r["seq"] for r in df.collect())[: n or None]
    assert sorted(r["seq"] for r in head_n(df, n).collect()) == want


def test_head_n_per_task_with_a_hot_task(spark):
    df = spark.range(3000).selectExpr("if(id % 10 < 8, 'hot', concat('t', id % 10)) AS task", "(id * 7919) % 100003 AS seq")
    caps = {"hot": 700, "t8": 3, "t9": 5000, "none": 4, "t0": 0}
    got = {}
    for r in head_n_per_task(df, caps, keep_others=True).collect():
        got.setdefault(r["task"], []).append(r["seq"])
    everything = {}
    for r in df.collect():
        everything.setdefault(r["task"], []).append(r["seq"])
    # a cap of 0 or None, or none at all, keeps every row
    assert {t: sorted(s) for t, s in got.items()} == {t: sorted(everything[t])[: caps.get(t) or None] for t in everything}
    assert head_n_per_task(df, {t: None for t in everything}).count() == 3000
    with pytest.raises(Exception, match="no settings for task"):
        head_n_per_task(df, {"hot": 700}).collect()


def test_ties_at_the_cut_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3)], "task STRING, seq BIGINT")
    for n in (1, 3, 4, 9):
        assert head_n(df, n).count() == min(n, 4)
        assert head_n_per_task(df, {"a": n}).count() == min(n, 4)
    with pytest.raises(Exception, match="not unique"):
        head_n(df, 2).collect()
    with pytest.raises(Exception, match="not unique"):
        head_n_per_task(df, {"a": 2}).collect()
    assert head_n(df.limit(0), 2).count() == 0


def test_first_lines_do_not_depend_on_how_files_are_split(spark, tmp_path):
    lines = [str(i) for i in range(2000)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    rows = files.read_head(spark, f"{tmp_path}/one.jsonl", "jsonl", 1234)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert sorted(int(r["raw"]) for r in rows.collect()) == list(range(1234))
        again = files.read_head(spark, f"{tmp_path}/one.jsonl", "jsonl", 1234)
        assert sorted(int(r["raw"]) for r in again.collect()) == list(range(1234))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    rng, want = random.Random(3), {}
    for name in ("a b.jsonl", "b.jsonl", "c.jsonl"):
        lines = [rng.choice(["", " ", f'"{name} {i} ' + "ü" * rng.randint(0, 40) + '"']) for i in range(rng.randint(50, 400))]
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
        want |= {(name, i): line for i, line in enumerate(lines) if line.strip()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "1000", "333", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = files.read_jsonl(spark, str(tmp_path))
            assert size == "128m" or rows.rdd.getNumPartitions() > 10
            found.append({(r["seq"]["file_path"].rsplit("/", 1)[1].replace("%20", " "), r["seq"]["line"]): r["raw"] for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(f == want for f in found)
    plain = files.read_jsonl(spark, str(tmp_path), positions=False)
    assert plain.columns == ["raw"] and sorted(r["raw"] for r in plain.collect()) == sorted(want.values())
    typed = files.read_jsonl(spark, f"{tmp_path}/c.jsonl", "value STRING", positions=False)
    assert typed.columns == ["value"]


def test_positions_are_left_out_where_nobody_asks(spark, jsonl):
    spec = task_specs([{"task": "t", "max_samples": None}])[0]
    with_seq, without = (files.load_train(spark, jsonl, spec, positions=p) for p in (True, False))
    assert "seq" in with_seq.columns and "seq" not in without.columns
    assert sorted(r["messages"][-1]["content"] for r in without.collect()) == sorted(answers(with_seq))
    plan = without._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Exchange" not in plan


def test_head_of_many_files_sees_opened_files_only(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.jsonl").write_text("".join(f"{k}\n\n" for k in range(i * 3, i * 3 + 3)))
    for n in (1, 3, 4, 20, 89, 90, 1000):
        rows = files.read_head(spark, str(tmp_path), "jsonl", n)
        assert [int(r["raw"]) for r in rows.orderBy("seq").collect()] == list(range(90))[:n]
        assert len(rows.inputFiles()) == min(30, -(-n // 3))
    assert files.read_head(spark, str(tmp_path), "jsonl", None).count() == 90


@pytest.mark.parametrize("kind", ["BIGINT", "STRING", "STRUCT<a: STRING, b: INT>", "TIMESTAMP", "DOUBLE"])
def test_selected_cuts_equal_a_sort(spark, kind):
    rng = random.Random(8)
    numbers = rng.sample(range(10**6), 4000)
    made = {
        "BIGINT": "x", "STRING": "concat('k', x)", "DOUBLE": "x / 7D - 1000", "TIMESTAMP": "timestamp_seconds(x)",
        "STRUCT<a: STRING, b: INT>": "struct(CAST(x DIV 100000 AS STRING) AS a, CAST(x % 100000 AS INT) AS b)",
    }[kind]
    df = spark.createDataFrame([(x,) for x in numbers], "x BIGINT").selectExpr(f"{made} AS seq", "x").repartition(6)
    ordered = [r["x"] for r in df.orderBy("seq").collect()]
    for n in (11, 60, 2000, 3999, 4000, 9000):
        assert sorted(r["x"] for r in head_n(df, n, gathered=10).collect()) == sorted(ordered[:n])
    tasks = df.selectExpr("if(x % 5 < 4, 'hot', 'cold') AS task", "seq", "x")
    caps = {"hot": 1700, "cold": 333, "none": 500}
    got = sorted(r["x"] for r in head_n_per_task(tasks, caps, gathered=20).collect())
    want = [x for x in ordered if x % 5 < 4][:1700] + [x for x in ordered if x % 5 == 4][:333]
    assert got == sorted(want)
    # one cap ranked, one selected
    mixed = sorted(r["x"] for r in head_n_per_task(tasks, caps | {"cold": 15}, gathered=20).collect())
    assert mixed == sorted([x for x in ordered if x % 5 < 4][:1700] + [x for x in ordered if x % 5 == 4][:15])


def test_selected_cuts_refuse_ties(spark):
    df = spark.range(3000).selectExpr("if(id BETWEEN 500 AND 2500, 700, id) AS seq", "CAST(id AS STRING) AS body").repartition(4)
    assert head_n(df, 500, gathered=10).count() == 500 and head_n(df, 2501, gathered=10).count() == 2501
    for n in (501, 1500, 2500):
        with pytest.raises(ValueError, match="not unique"):
            head_n(df, n, gathered=10)
    nulls = spark.range(100).selectExpr("if(id < 50, NULL, id) AS seq")
    assert head_n(nulls, 20, gathered=5).count() == 20 and head_n(nulls, 60, gathered=5).count() == 50


def test_no_task_of_a_selection_gathers_n_rows(spark):
    """Of half a table of 200,000 positions no stage but the scans reads more than a few thousand rows."""
    positions = spark.range(0, 200_000, numPartitions=8).selectExpr("'' AS task", "id * 7919 % 1000003 AS position")
    seen = []
    collect = type(positions).collect
    try:
        type(positions).collect = lambda self: seen.append(collect(self)) or seen[-1]
        cuts = select_cuts(positions, {"": 100_000})
    finally:
        type(positions).collect = collect
    assert cuts[""] == sorted(i * 7919 % 1000003 for i in range(200_000))[99_999]
    assert max(len(rows) for rows in seen) < 10_000 and len(seen) < 12


def test_limits_shuffle_positions_only(spark, tmp_path):
    spark.range(100).selectExpr("id AS seq", "repeat('x', 50) AS body").write.parquet(f"{tmp_path}/wide")
    plan = head_n(spark.read.parquet(f"{tmp_path}/wide"), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<seq:bigint>") >= 1
    assert "LessThanOrEqual(seq,ScalarSubquery" in plan


# ---- turns ---------------------------------------------------------------------

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def random_turns(seed, chats=40, longest=12):
    rng, rows = random.Random(seed), []
    for conv in range(chats):
        length = 400 if conv == 7 else rng.randint(1, longest)  # one chat holds most turns
        start = rng.choice([0, 0, 3])
        for turn in range(start, start + length):
            words = " ".join(rng.choice(["that", "with", "ich", "x", "That.", "\n", ""]) for _ in range(rng.randint(0, 4)))
            rows.append((conv, turn, rng.choice(["system", "user", "assistant"]), words))
    rng.shuffle(rows)
    return rows


def whole_chats(spark, df):
    return df.groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(turn, role, text))) AS e")).selectExpr(
        "conv_id", "transform(e, x -> struct(x.role AS role, x.text AS content)) AS messages")


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_message_parts_make_up_the_chat(spark, size):
    df = spark.createDataFrame(random_turns(1), TURNS)
    parts = {}
    for r in messages_from_turns(df, size).orderBy("conv_id", "part").collect():
        assert len(r["messages"]) <= size
        parts.setdefault(r["conv_id"], []).append((r["is_last"], r["messages"]))
    for r in whole_chats(spark, df).collect():
        pieces = parts.pop(r["conv_id"])
        assert [m for _, p in pieces for m in p] == r["messages"]
        assert [last for last, _ in pieces] == [False] * (len(pieces) - 1) + [True]
    assert parts == {}


def test_answers_and_prompts_equal_those_of_whole_chats(spark):
    df = spark.createDataFrame(random_turns(2), TURNS)
    whole = whole_chats(spark, df).selectExpr(
        "conv_id", "try_element_at(filter(messages, m -> m.role = 'assistant'), -1).content AS expected", f"{prompt_sql(asked_sql('messages'))} AS prompt"
    ).collect()
    found = {r["conv_id"]: r["expected"] for r in answers_from_turns(df).collect()}
    assert found == {r["conv_id"]: r["expected"] for r in whole}
    for n, size in ((1, 1), (2, 4096), (7, 3), (30, 4), (30, 4096), (5000, 5), (5000, 4096)):
        rows = prompts_from_turns(df, n, size).collect()
        prompts = {r["conv_id"]: r["prompt"] for r in rows}
        assert len(rows) == len(prompts) == len(whole)
        for r in whole:
            tokens = r["prompt"].split()
            if len(tokens) <= n:
                assert prompts[r["conv_id"]] == r["prompt"]
            else:
                cut = prompts[r["conv_id"]]
                assert cut.split() == tokens[:n] and r["prompt"].startswith(cut)


@pytest.mark.parametrize("classes", [["that", "with", "ich"], ["ich", "assistant"], ["nothing", "user"]])
def test_labels_of_chats(spark, classes):
    from tests.test_functions import python_label

    df = spark.createDataFrame(random_turns(3), TURNS)
    found = {r["conv_id"]: (r["expected"], r["predicted"]) for r in label_chats(df, classes).collect()}
    for r in whole_chats(spark, df).collect():
        said = [m["content"] for m in r["messages"] if m["role"] == "assistant"]
        if not said or not said[-1]:
            assert found[r["conv_id"]] == (None, None)
            continue
        turns = [f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>" for m in r["messages"][:-1]]
        prompt = "\n".join(turns + ["<|im_start|>assistant\n"])
        assert found[r["conv_id"]] == (python_label(said[-1], classes), python_label(prompt, classes))


def test_labels_of_chats_are_one_shuffle_of_numbers(spark):
    df = spark.createDataFrame(random_turns(3, 5), TURNS)
    plan = label_chats(df, ["that", "with"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_prepared_turns_are_capped_per_task(spark):
    df = spark.createDataFrame(random_turns(4), TURNS).withColumn("task", F.expr("if(conv_id % 4 = 0, 'a', 'b')"))
    specs = task_specs([{"task": "a", "max_test_samples": 3}, {"task": "b", "max_test_samples": 1000}])
    ids = {}
    for r in prepare_turns(df, specs).collect():
        ids.setdefault(r["task"], []).append(r["example_id"])
    assert {t: sorted(i) for t, i in ids.items()} == {"a": [0, 4, 8], "b": [i for i in range(40) if i % 4]}
