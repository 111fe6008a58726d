"""Sub-word counts and caps against a published encoder and a plain merge loop."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatgauge.functions.subwords import HELD, PATTERN, Subwords, merged_lengths, read_ranks, worker_subwords
from chatgauge.operators.score import prepare
from chatgauge.operators.subwords import Vocabulary, capped, token_capped, with_token_count
from chatgauge.sinks.training_text import training_text
from chatgauge.sources.specs import task_specs
from chatgauge.sources.turns import prompts_from_turns

FILES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
TEXTS = [
    "", " ", "   lead and trail  \n\n", "It's we'll THEY'VE 12345 don't", "ünïcödé 漢字 😀😀 ñandú", "a" * 5000, "!?" * 700, "\t\n x y z",
    "<|im_start|>user\nhi<|im_end|>", "word " * 3000, "é́ combining", "nul\x00byte", "٣٤٥ Ⅷ ²",
]


@pytest.fixture(scope="module")
def ranks(spark):
    return read_ranks(spark, FILES[0])


def published(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", FILES)
def test_counts_equal_a_published_encoder(spark, path):
    encoder, vocabulary = published(path), Vocabulary(spark, path)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "id long, text string, size string")
    found = {r["id"]: r["n_tokens"] for r in with_token_count(rows, "text", vocabulary).collect()}
    assert found == {i: len(encoder.encode_ordinary(t)) for i, t in enumerate(TEXTS)} | {len(TEXTS): None}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_caps_keep_a_prefix_of_n_tokens(spark, n):
    encoder, vocabulary = published(FILES[0]), Vocabulary(spark, FILES[0])
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "id long, text string, other string")
    made = token_capped(rows, "text", n, vocabulary, flag="truncated", size="kept")
    assert made.columns == ["id", "text", "other", "truncated", "kept"]
    for r in made.collect():
        if r["id"] == len(TEXTS):
            assert r["text"] is r["truncated"] is r["kept"] is None
            continue
        text, tokens = TEXTS[r["id"]], encoder.encode_ordinary(TEXTS[r["id"]])
        kept = b"".join(encoder.decode_single_token_bytes(t) for t in tokens[:n])
        assert r["truncated"] == (len(tokens) > n) and r["kept"] == len(kept)
        assert text.startswith(r["text"]) and r["text"] == kept.decode("utf-8", "ignore")


def plain_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [len(p) for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.dictionaries(st.binary(min_size=2, max_size=4), st.integers(0, 30), max_size=30))
def test_heap_merges_equal_a_plain_loop(piece, pairs):
    pairs.pop(piece, None)
    assert merged_lengths(piece, pairs) == plain_merges(piece, pairs)


def test_long_pieces_equal_a_plain_loop(ranks):
    rng = random.Random(4)
    for letters in ("ab", "thein", "aé漢"):
        piece = "".join(rng.choices(letters, k=400)).encode()
        assert merged_lengths(piece, ranks) == plain_merges(piece, ranks)


def test_a_worker_remembers_a_bounded_number_of_pieces(ranks, monkeypatch):
    monkeypatch.setattr("chatgauge.functions.subwords.KEPT", 10)
    words = Subwords(ranks)
    assert words.count(" ".join(f"x{i}y" for i in range(100))) > 200 and len(words.known) <= 10


def test_a_count_and_a_cap_share_one_worker(spark):
    vocabulary = Vocabulary(spark, FILES[0])
    rows = spark.createDataFrame(enumerate(TEXTS), "id long, text string")
    counted = with_token_count(rows, "text", vocabulary)
    plan = token_capped(counted, "text", 5, vocabulary, flag="more", size="kept").drop("text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1, plan


def test_a_worker_keeps_one_memory_for_a_vocabulary(ranks):
    words = worker_subwords(ranks)
    assert words.count("unlikelyword") and worker_subwords(ranks) is words and words.known
    assert all(isinstance(sizes, bytes) for sizes in words.known.values())
    others = [worker_subwords(dict(ranks)) for _ in range(HELD)]
    assert worker_subwords(ranks, r"\S+") not in [words, *others] and worker_subwords(others[-1].ranks) is others[-1]
    assert worker_subwords(ranks) is not words and worker_subwords(ranks).count("unlikelyword") == words.count("unlikelyword")


def test_vocabularies_are_checked(spark, tmp_path, monkeypatch):
    (tmp_path / "small").write_text("QQ== 0\n")
    with pytest.raises(ValueError, match="every byte"):
        read_ranks(spark, str(tmp_path / "small"))
    monkeypatch.setattr("chatgauge.functions.subwords.MOST_ENTRIES", 100)
    with pytest.raises(ValueError, match="not broadcast"):
        read_ranks(spark, FILES[0])


def test_caps_of_prompts_and_training_texts(spark):
    vocabulary, encoder = Vocabulary(spark, FILES[0]), published(FILES[0])
    rng = random.Random(6)
    turns = [(c, t, ["user", "assistant"][t % 2], "\n" * rng.randint(0, 2) + "wörd word! " * rng.randint(0, 9) + "\n" * rng.randint(0, 2)) for c in range(6) for t in range(rng.randint(1, 9))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r["prompt"] for r in prompts_from_turns(table).collect()}
    for n in (1, 5, 23, 60):
        for r in prompts_from_turns(table, max_tokens=n, turns_per_part=2, vocabulary=vocabulary).collect():
            tokens = encoder.encode_ordinary(whole[r["conv_id"]])[:n]
            assert r["prompt"] == b"".join(map(encoder.decode_single_token_bytes, tokens)).decode("utf-8", "ignore")
    chats = table.groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(turn, role, text AS content))) AS e")).selectExpr(
        "'t' AS task", "conv_id AS example_id", "transform(e, x -> struct(x.role AS role, x.content AS content)) AS messages"
    )
    texts = [r["text"] for r in training_text(chats, max_tokens=12, vocabulary=vocabulary).collect()]
    assert texts and all(len(encoder.encode_ordinary(t)) <= 12 for t in texts)
    specs = task_specs([{"task": "t", "classes": ["WORD", "OTHER"]}])
    prompts = [r["prompt"] for r in prepare(chats, specs, max_tokens=9, vocabulary=vocabulary).collect() if r["prompt"]]
    assert prompts and all(len(encoder.encode_ordinary(p)) <= 9 for p in prompts)
    # without a vocabulary tokens are blank-separated
    assert capped(spark.createDataFrame([("a b c",)], "text string"), "text", 2).first()["text"] == "a b"
