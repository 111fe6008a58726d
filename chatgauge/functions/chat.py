"""Functions over an array of (role, content) messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ANSWER_OPEN, TURN_CLOSE, TURN_OPEN
from .expr import literal


def turn_sql(role: str, content: str) -> str:
    """Markup of one turn; a missing role or content is written as empty text."""
    return (
        f"concat({literal(TURN_OPEN)}, coalesce({role}, ''), '\\n', coalesce({content}, ''), {literal(TURN_CLOSE)})"
    )


def _turns_sql(messages: str) -> str:
    return f"transform({messages}, m -> {turn_sql('m.role', 'm.content')})"


def chat_sql(messages: str) -> str:
    """Training text: every turn, joined by line breaks."""
    return f"array_join({_turns_sql(messages)}, '\\n')"


def prompt_sql(messages: str) -> str:
    """Prompt text: every turn, then an open assistant turn."""
    return f"array_join(array_append({_turns_sql(messages)}, {literal(ANSWER_OPEN)}), '\\n')"


def asked_sql(messages: str) -> str:
    """All messages but the last, whatever its role."""
    return f"slice({messages}, 1, greatest(size({messages}) - 1, 0))"


def before_answer_sql(messages: str) -> str:
    """Messages before the last assistant turn, so that no answer leaks into the prompt."""
    spots = f"transform({messages}, (m, i) -> if(m.role = 'assistant', i, NULL))"
    return f"slice({messages}, 1, coalesce(array_max({spots}), size({messages})))"


def answer_sql(messages: str) -> str:
    """Content of the last assistant message, null where there is none."""
    return f"try_element_at(filter({messages}, m -> m.role = 'assistant'), -1).content"


def render_chat(messages: str) -> Column:
    return F.expr(chat_sql(messages))


def render_prompt(messages: str) -> Column:
    return F.expr(prompt_sql(messages))


def prompt_messages(messages: str) -> Column:
    return F.expr(asked_sql(messages))


def prompt_before_answer(messages: str) -> Column:
    return F.expr(before_answer_sql(messages))


def last_assistant(messages: str) -> Column:
    return F.expr(answer_sql(messages))
