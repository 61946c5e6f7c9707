"""Chat message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import strip


def chat_messages(turns: DataFrame, prompts: DataFrame, system: str = lx.TUTOR) -> DataFrame:
    """``conv_id, messages``: the system prompt, the turns of users and assistants with content in
    order, and the new prompt (``conv_id, prompt``)."""
    kept = turns.select("conv_id", "turn", strip(F.col("role")).alias("role"), F.col("text").alias("content"))
    kept = kept.where(F.col("role").isin("user", "assistant") & (F.length("content") > 0))
    history = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_h"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    past = F.transform("_h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return prompts.join(history, "conv_id", "left").select(
        "conv_id",
        F.concat(F.array(message("system", F.lit(system))), F.coalesce(past, none), F.array(message("user", F.col("prompt")))).alias("messages"),
    )
