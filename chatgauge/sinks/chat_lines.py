"""Chats stored by turn as JSON lines, without a chat ever being one value.

Turns are shuffled once, by chat, and sorted; a task then writes turn after turn, each as a
piece of its chat's line. The writer's separator is a blank, which JSON allows between pieces,
and the last piece of a chat ends with the line break. So neither memory nor the bound on the
size of a value limits a chat; a sort or a window that outgrows memory goes to disk. One chat
is one line of one file, so a huge chat is written by one task, front to back.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_chats(turns: DataFrame, path, bare: Column | None = None, mode="errorifexists"):
    """Write (conv_id, turn, role, text) with one line for each chat.

    Chats for which ``bare`` holds are written as a list of messages, others as an object with
    ``messages``.
    """
    in_order = W.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("_bare", F.coalesce(bare if bare is not None else F.lit(False), F.lit(False))).select(
        "_bare", F.to_json(F.struct("role", F.col("text").alias("content")), {"ignoreNullFields": "false"}).alias("message"),
        F.lag(F.lit(True)).over(in_order).isNull().alias("first"), F.lead(F.lit(True)).over(in_order).isNull().alias("last"),
    )
    piece = F.concat(
        F.when(~F.col("first"), ",").when(F.col("_bare"), "[").otherwise('{"messages":['), "message",
        F.when(~F.col("last"), "").when(F.col("_bare"), "]\n").otherwise("]}\n"),
    )
    marked.select(piece.alias("value")).write.mode(mode).option("lineSep", " ").text(path)
