"""Chats stored one turn per row: (conv_id, turn, role, text), turn unique in its chat.

A chat can be arbitrarily long, so nothing here gathers a whole chat in one group.
Answers and labels come from partial aggregates over turns; texts and message
arrays are built in parts of a bounded number of turns, keyed (conv_id, part), and
an ordinary chat is simply a chat of one part.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chat import turn_sql
from ..functions.expr import literal
from ..functions.labels import clean_classes, names_class_sql, search_order, task_label_sql
from ..operators.limits import head_n_per_task
from ..operators.subwords import capped
from ..schema import ANSWER_OPEN, MESSAGES

TURNS_PER_PART = 4096


def chats_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): every chat as one example; for chats that fit one row.

    A part of a chat is no chat: whatever writes examples uses this form, whatever asks for
    answers and counts the aggregates below.  All turns of a chat meet in one task, and its
    array must stay below Spark's 2 GB for a value, as must the JSON line made of it; a larger
    chat fails the job.
    """
    shape = MESSAGES.simpleString()
    chats = turns.selectExpr("conv_id", "struct(turn, role, text AS content) AS entry").groupBy("conv_id").agg(
        F.expr("array_sort(collect_list(entry)) AS entries")
    )
    return chats.selectExpr(
        "conv_id", f"CAST(transform(entries, e -> struct(e.role AS role, e.content AS content)) AS {shape}) AS messages"
    )


def messages_from_turns(turns: DataFrame, turns_per_part=TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, is_last, messages): turns in order, long chats in several parts.

    Part p holds the turn numbers p*turns_per_part and up, so no part outgrows that
    many messages and a huge chat spreads over many tasks.
    """
    size = int(turns_per_part)
    parts = (
        turns.selectExpr("conv_id", f"turn DIV {size} AS part", "struct(turn, role, text AS content) AS entry")
        .groupBy("conv_id", "part")
        .agg(F.expr("array_sort(collect_list(entry)) AS entries"))
    )
    # numbers only: the texts are not read for this pass
    ends = turns.groupBy("conv_id").agg(F.expr(f"max(turn) DIV {size} AS part")).selectExpr("conv_id", "part", "true AS is_last")
    shape = MESSAGES.simpleString()
    return parts.join(ends, ["conv_id", "part"], "left").selectExpr(
        "conv_id", "part", "coalesce(is_last, false) AS is_last",
        f"CAST(transform(entries, e -> struct(e.role AS role, e.content AS content)) AS {shape}) AS messages",
    )


def answers_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, expected): content of the last assistant turn, null without one.

    One aggregate, combined before the shuffle: of each chat a task sends its last answer only.
    """
    return turns.groupBy("conv_id").agg(
        F.expr("count(*) AS n_turns"), F.expr("max_by(text, turn) FILTER (WHERE role = 'assistant') AS expected")
    )


def answer_places_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, expected, n_prompt, n_before_answer): the last answer, turns without the last, turn numbers before the answer.

    One aggregate like ``answers_from_turns``; a chat of any length is never gathered.
    Without an answer all turn numbers count.
    """
    return turns.groupBy("conv_id").agg(
        F.expr("max_by(text, turn) FILTER (WHERE role = 'assistant') AS expected"),
        F.expr("count(*) - 1 AS n_prompt"),
        F.expr(
            "CAST(coalesce(max(turn) FILTER (WHERE role = 'assistant'), max(turn) + 1) - min(turn) AS BIGINT) AS n_before_answer"
        ),
    )


def prompts_from_turns(turns: DataFrame, max_tokens=None, turns_per_part=TURNS_PER_PART, vocabulary=None) -> DataFrame:
    """(conv_id, prompt): prompt text without the last turn, cut after ``max_tokens`` if given.

    Tokens are those of the vocabulary, or blank-separated ones without it. The open assistant turn stands in for the dropped last turn.
    """
    ends = turns.groupBy("conv_id").agg(F.expr("min(turn) AS start"), F.expr("max(turn) AS end"))
    return _prompts(turns, ends, ["conv_id"], max_tokens, turns_per_part, vocabulary)


def _prompts(turns, ends, keys, max_tokens, turns_per_part, vocabulary=None):
    """Prompts by chat; ``ends`` holds the first and last turn number of each chat.

    Every rendered turn starts a new token and has at least two (its marker and its
    text), so max_tokens tokens lie within the first max_tokens/2 + 1 turns, and no
    turn needs to bring more than max_tokens tokens along (and, since the line break between
    two turns may join with sub-words around it, a few more).  Turns are counted per part
    (numbers only) to find the parts before which fewer turns lie; only these bring
    texts, each no more than are still wanted, so at most that many meet on a chat.
    Without a cap a chat's whole prompt is one value, and all its turns meet.
    """
    size = int(turns_per_part)
    shown = f"array_join(transform(pieces, p -> if(p.turn <=> end, {literal(ANSWER_OPEN)}, p.piece)), '\\n')"
    if not max_tokens:
        whole = turns.selectExpr(*keys, "turn", f"{turn_sql('role', 'text')} AS piece").groupBy(*keys).agg(
            F.expr("array_sort(collect_list(struct(turn, piece))) AS pieces"), F.expr("max(turn) AS end")
        )
        return whole.selectExpr(*keys, f"{shown} AS prompt")
    cap = max_tokens // 2 + 1
    counts = turns.selectExpr(*keys, f"turn DIV {size} AS part").groupBy(*keys, "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(f"before < {cap}")
    numbered = turns.selectExpr(*keys, f"turn DIV {size} AS part", "turn", "role", "text")
    met = numbered.join(wanted.select(*keys, "part", "before"), [*keys, "part"])
    rendered = met.selectExpr(*keys, "part", "before", "turn", f"{turn_sql('role', 'text')} AS piece")
    parts = (
        capped(rendered, "piece", max_tokens + 8, vocabulary)
        .groupBy(*keys, "part")
        .agg(F.expr("array_sort(collect_list(struct(turn, piece))) AS pieces"), F.max("before").alias("before"))
        .selectExpr(*keys, f"slice(pieces, 1, {cap} - CAST(before AS INT)) AS pieces")
    )
    chats = parts.groupBy(*keys).agg(F.expr("array_sort(flatten(collect_list(pieces))) AS pieces"))
    texts = chats.join(ends.select(*keys, "end"), keys).selectExpr(*keys, f"{shown} AS prompt")
    return capped(texts, "prompt", max_tokens, vocabulary)


def label_chats(turns: DataFrame, classes) -> DataFrame:
    """(conv_id, expected, predicted) with the label of the answer and of the prompt.

    The prediction is the class named in the chat's prompt.  A class has no line
    break in it, so it is in the prompt exactly when it is in one of the rendered
    turns before the last: the first turn naming it must come before the end.  All
    of it is one aggregate over numbers, combined before the single shuffle.
    """
    names = clean_classes(classes)
    if any("\n" in name for name in names):
        raise ValueError("class names must not hold line breaks")
    order = search_order(names)
    # named once, so that every text is rendered and upper-cased once
    upper = turns.selectExpr(
        "conv_id", "turn", "role = 'assistant' AS is_answer",
        "upper(if(role = 'assistant', text, NULL)) AS body", f"upper({turn_sql('role', 'text')}) AS piece",
    )
    ranks = " ".join(f"WHEN {names_class_sql('body', name)} THEN {i}" for i, name in enumerate(order))
    rank = f"CASE WHEN NOT is_answer THEN NULL WHEN coalesce(body, '') = '' THEN -1 {ranks} ELSE {order.index(names[0])} END"
    rows = upper.selectExpr(
        "conv_id", "turn", f"{rank} AS rank", "if(is_answer, turn, NULL) AS answer_turn",
        *[f"if({names_class_sql('piece', name)}, turn, NULL) AS at_{i}" for i, name in enumerate(order)],
    )
    chats = rows.groupBy("conv_id").agg(
        F.expr("max(turn) AS end"), F.expr("max_by(rank, answer_turn) AS rank"),
        *[F.expr(f"min(at_{i}) AS at_{i}") for i in range(len(order))],
    )
    found = " ".join(
        f"WHEN coalesce(at_{i} < end, false) OR {names_class_sql(literal(ANSWER_OPEN.upper()), name)} THEN {literal(name)}"
        for i, name in enumerate(order)
    )
    return chats.selectExpr(
        "conv_id",
        f"if(rank >= 0, element_at({literal(order)}, rank + 1), NULL) AS expected",
        f"CASE WHEN coalesce(rank, -1) < 0 THEN NULL {found} ELSE {literal(names[0])} END AS predicted",
    )


def prepare_turns(turns: DataFrame, specs, max_tokens=None, vocabulary=None) -> DataFrame:
    """(task, example_id, expected, prompt) of chats stored by turn, ready to be scored.

    ``turns`` carries a ``task`` column.  Each task's first ``max_test_samples`` chats
    (all if unset) are kept, by conv_id; chats without an answer stay with nulls.
    """
    keys = ["task", "conv_id"]
    caps = {s.task: s.max_test_samples for s in specs}
    chats = turns.groupBy(*keys).agg(
        F.expr("min(turn) AS start"), F.expr("max(turn) AS end"),
        F.expr("max(turn) FILTER (WHERE role = 'assistant') AS answer_turn"),
    )
    chats = head_n_per_task(chats, caps, order="conv_id")
    kept = turns.join(chats.select(*keys), keys, "left_semi")
    answered = chats.selectExpr(*keys, "answer_turn AS turn")
    answers = turns.join(answered, [*keys, "turn"]).selectExpr(*keys, "nullif(text, '') AS answer")
    prompts = _prompts(kept, chats.select(*keys, "start", "end"), keys, max_tokens, TURNS_PER_PART, vocabulary)
    return prompts.join(answers, keys, "left").selectExpr(
        "task", "conv_id AS example_id", f"{task_label_sql('answer', 'task', specs)} AS expected",
        "if(answer IS NULL, NULL, prompt) AS prompt",
    )
