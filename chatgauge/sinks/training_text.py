"""Training text: one ``text`` column, one row per example."""

from pyspark.sql import DataFrame

from ..functions.chat import chat_sql
from ..operators.subwords import capped


def training_text(examples: DataFrame, max_tokens=None, vocabulary=None, template=None) -> DataFrame:
    """Render ``messages`` (by a model's ``ChatTemplate``, if given); with ``max_tokens`` each text is cut after that many (of the vocabulary, if given)."""
    texts = examples.selectExpr(f"{(template.chat_sql if template else chat_sql)('messages')} AS text")
    return capped(texts, "text", max_tokens, vocabulary) if max_tokens else texts


def write_training_text(
    examples: DataFrame, path, format="parquet", max_tokens=None, vocabulary=None, template=None, mode="errorifexists"
):
    training_text(examples, max_tokens, vocabulary, template).write.mode(mode).format(format).save(path)
