"""Chat templates, chats written turn by turn, and the overlap of two sets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatgauge.functions.chat_templates import ChatTemplate, TemplateError, render_template, template_sql
from chatgauge.operators.overlap import bloom_filter, maybe_in, overlap, shared_prompts
from chatgauge.operators.score import prepare
from chatgauge.sinks.chat_lines import write_chats
from chatgauge.sinks.training_text import training_text
from chatgauge.sources import files
from chatgauge.sources.specs import task_specs

MARKED = (
    "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
)
INST = """{{ bos_token }}{% for message in messages %}
{% if message['role'] == 'user' %}
{{ '[INST] ' + message['content'] | trim + ' [/INST]' }}
{%- elif message['role'] == 'assistant' %}
{{ ' ' + message.content | trim + ' ' + eos_token }}
{%- elif loop.first and message['role'] == 'system' -%}
    {{ "<<SYS>>\\n" + message['content'] + "\\n<</SYS>>\\n\\n" }}
{%- endif %}
{% endfor %}"""
TURNS = """{{- bos_token -}}
{%- for m in messages -%}
    {%- if (m['role'] == 'assistant') -%}
        {{ '<start_of_turn>model' }}
    {%- else -%}
        {{ '<start_of_turn>' + m['role'] | upper }}
    {%- endif -%}
    {{ '\n' + m['content'] | trim + '<end_of_turn>\n' }}
    {%- if not loop.last and loop.index0 % 2 == 1 -%}{{ '--' }}{%- endif -%}
{%- endfor -%}
{%- if add_generation_prompt -%}
    {{'<start_of_turn>model\n'}}
{%- endif -%}"""


def marked(chat, ask):
    return "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in chat) + ("<|im_start|>assistant\n" if ask else "")


def inst(chat, ask):
    out = "<s>"
    for i, (r, c) in enumerate(chat):
        if r == "user":
            out += f"[INST] {c.strip()} [/INST]"
        elif r == "assistant":
            out += f" {c.strip()} </s>"
        elif i == 0 and r == "system":
            out += f"<<SYS>>\n{c}\n<</SYS>>\n\n"
    return out


def turns_form(chat, ask):
    out = "<s>"
    for i, (r, c) in enumerate(chat):
        out += "<start_of_turn>" + ("model" if r == "assistant" else r.upper()) + f"\n{c.strip()}<end_of_turn>\n"
        if i != len(chat) - 1 and i % 2 == 1:
            out += "--"
    return out + ("<start_of_turn>model\n" if ask else "")


def random_chats(seed=1):
    rng = random.Random(seed)
    said = ["", " ", "hello", "  two\nlines \n", "it's \"quoted\" \\ and {{ odd }} {% if %}", "ünïcödé 😀", "$1 \\n"]
    return [[]] + [[(rng.choice(["system", "user", "assistant"]), rng.choice(said)) for _ in range(rng.randint(1, 6))] for _ in range(80)]


MESSAGES = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"


@pytest.mark.parametrize("source, by_hand", [(MARKED, marked), (INST, inst), (TURNS, turns_form)])
@pytest.mark.parametrize("ask", [True, False])
def test_templates_equal_rendering_by_hand(spark, source, by_hand, ask):
    chats = random_chats()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "id INT, " + MESSAGES)
    text = render_template(source, bos_token="<s>", eos_token="</s>", add_generation_prompt=ask)
    got = {r["id"]: r["text"] for r in df.select("id", text.alias("text")).collect()}
    assert got == {i: by_hand(c, ask) for i, c in enumerate(chats)}


def test_null_content_and_null_chats(spark):
    df = spark.createDataFrame([([("user", None)],), (None,)], MESSAGES)
    assert [r[0] for r in df.select(render_template(MARKED, add_generation_prompt=False)).collect()] == [marked([("user", "")], False), None]


@pytest.mark.parametrize("bad", [
    "{% for m in tools %}{% endfor %}", "{% for m in messages %}{{ m.content }}", "{{ m.content }}", "{% set x = 1 %}", "{{ bos_token | tojson }}",
    "{% for m in messages %}{{ m['tool_calls'] }}{% endfor %}", "{% if x %}{% endif %}", "{{ raise_exception('no') }}", "{{ 'a' + 1 }}",
    "{% for m in messages %}{{ loop.previtem }}{% endfor %}", "{{ 'a' == 'b' }}", "{% if 'a' == 1 %}x{% endif %}", "{{ messages[0] }}", "{% endif %}",
    "{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}", "{{ 'a' ~ 'b' }}",
])
def test_what_is_not_covered_is_refused(bad):
    with pytest.raises(TemplateError):
        template_sql(bad, bos_token="<s>")


def test_prompts_and_training_texts_by_template(spark):
    chat = [("system", "s"), ("user", "u"), ("assistant", "YES")]
    df = spark.createDataFrame([("t", 1, chat)], "task STRING, example_id BIGINT, " + MESSAGES)
    template = ChatTemplate(TURNS, {"bos_token": "<s>"})
    specs = task_specs([{"task": "t", "classes": ["YES", "NO"]}])
    assert prepare(df, specs, template=template).first()["prompt"] == turns_form(chat[:-1], True)
    assert training_text(df, template=template).first()["text"] == turns_form(chat, False)


# ---------------------------------------------------------------- chats as lines


def test_chats_written_turn_by_turn_are_json_lines(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(300 if conv == 3 else rng.randint(1, 6)):
            rows.append((conv, turn * 2, rng.choice(["user", "assistant", None]), rng.choice(["", "a \"b\"\nc", "ü 😀 \t", None, "x" * 200]), 1))
    turns = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id BIGINT, turn BIGINT, role STRING, text STRING, message INT")
    write_chats(turns, f"{tmp_path}/lines", bare=F.col("conv_id") % 3 == 0)
    found = []
    for part in (tmp_path / "lines").glob("part-*"):
        found += [json.loads(line) for line in part.read_text().split("\n") if line.strip()]
    whole = {}
    for conv, _, role, text, _ in sorted(rows, key=lambda r: r[:2]):
        whole.setdefault(conv, []).append({"role": role, "content": text})
    want = [c if conv % 3 == 0 else {"messages": c} for conv, c in whole.items()]
    assert sorted(found, key=json.dumps) == sorted(want, key=json.dumps)
    read = files.load_train(spark, f"{tmp_path}/lines", task_specs([{"task": "t", "max_samples": None}])[0])
    assert sorted(len(r["messages"]) for r in read.collect()) == sorted(map(len, whole.values()))


def test_a_chat_is_never_collected(spark, tmp_path, monkeypatch):
    """With a tiny budget a group held in memory would fail; a sorted run is written as it comes."""
    turns = spark.range(60_000).selectExpr("0L AS conv_id", "id AS turn", "'user' AS role", "repeat('t', 300) AS text")
    for name in ("windowExec", "sortMergeJoinExec"):
        spark.conf.set(f"spark.sql.{name}.buffer.spill.threshold", "1000")
    try:
        write_chats(turns, f"{tmp_path}/one")
    finally:
        for name in ("windowExec", "sortMergeJoinExec"):
            spark.conf.unset(f"spark.sql.{name}.buffer.spill.threshold")
    lines = [line for part in (tmp_path / "one").glob("part-*") for line in part.read_text().split("\n") if line.strip()]
    assert len(lines) == 1 and len(json.loads(lines[0])["messages"]) == 60_000


# ---------------------------------------------------------------- overlap


def test_overlap_is_exact(spark):
    rng = random.Random(3)
    train = [f"p{rng.randrange(3000)}" for _ in range(4000)] + [None, "", "same"] * 2
    test = [f"p{rng.randrange(2500, 4000)}" for _ in range(700)] + [None, "", "same", "same"]
    a, b = (spark.createDataFrame([(p, 1) for p in rows], "prompt STRING, words INT").repartition(3) for rows in (train, test))
    common = {p for p in train if p is not None} & set(test)
    want = (len(common), sum(p in common for p in train), sum(p in common for p in test))
    # any size of filter, also one that lets everything through, gives the same counts
    for bits in (None, 64, 1 << 12):
        assert tuple(overlap(a, b, bits=bits).first()) == want
    words, bits = bloom_filter(b)
    assert len(words.first()["words"]) == bits // 64
    through = maybe_in(a, words, bits)
    assert through.where(F.col("prompt").isin(list(common))).count() == want[1]
    assert through.count() - want[1] < 0.05 * len(train)
    assert sum(r["n_train"] for r in shared_prompts(a, b).collect()) == want[1]
    assert tuple(overlap(a.limit(0), b).first()) == tuple(overlap(a, b.limit(0)).first()) == (0, 0, 0)
