"""Splits and training formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.functions.order import kth_key, up_to


def split_exact(df: DataFrame, id_col: str, share: float = 0.15, seed: str = "split-1", name: str = "part") -> DataFrame:
    """``df`` with a column that is ``validation`` on exactly floor(share * rows) rows and ``train`` on the rest.

    Rows are ordered by a hash of seed and id (ids unique). The hash of the last validation row is found by
    refined counts (see ``kth_key``), so the part is a comparison: no row is sorted, ranked or moved.
    """
    order = (F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256), F.col(id_col))
    cut = kth_key(df, math.floor(df.count() * share), *order)
    return df.withColumn(name, F.when(up_to(cut, *order), "validation").otherwise("train"))


def instruction(df: DataFrame, text: Column, valid: Column, upper: bool = True) -> DataFrame:
    """(instruction, response) with response TRUE / FALSE, or in lower case."""
    said = F.when(valid, "true").otherwise("false")
    return df.select(text.alias("instruction"), (F.upper(said) if upper else said).alias("response"))


def prompt_string(instruction: Column, response: Column, before: str, between: str, after: str) -> Column:
    """A chat template around instruction and response."""
    return F.concat(F.lit(before), instruction, F.lit(between), response, F.lit(after))


def chat(text: Column, system: str) -> Column:
    """Messages for one question: a system turn and a user turn."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", text))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, messages): each conversation's turns in order, as an array of (role, content)."""
    by = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role"), F.col("text").alias("content")))).alias("m"))
    return by.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def prompt_grid(spark: SparkSession, topics: list[str] | DataFrame, formats: dict[str, str], n: int | None = None) -> DataFrame:
    """(topic, format, plausibility, prompt, validity): topics, as many as ``n`` asks for, by formats by both labels.

    {topic} and {plausibility} are filled in; a format is valid unless its name says invalid. A table of topics
    has one string column and isn't collected; with ``n`` its first topics in order are taken, without it all.
    """
    if isinstance(topics, DataFrame):
        t = topics.toDF("topic")
        t = t if n is None else t.orderBy("topic").limit(n // 8 + 1)
    else:
        t = spark.createDataFrame([(x,) for x in (topics if n is None else topics[: n // 8 + 1])], "topic string")
    f = spark.createDataFrame(list(formats.items()), "format string, template string")
    p = spark.createDataFrame([("plausible",), ("implausible",)], "plausibility string")
    g = t.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(p))
    prompt = F.replace(F.replace("template", F.lit("{topic}"), F.col("topic")), F.lit("{plausibility}"), F.col("plausibility"))
    return g.select("topic", "format", "plausibility", prompt.alias("prompt"), (~F.contains("format", F.lit("invalid"))).alias("validity"))


def second_prompts(df: DataFrame, text: Column, template: str, all_labels: bool = False) -> DataFrame:
    """``df`` with a second-stage prompt around ``text``; ``all_labels`` repeats each row for the four label pairs."""
    out = df.withColumn("prompt", F.replace(F.lit(template), F.lit("{text}"), text))
    if all_labels:
        both = F.array(F.lit(True), F.lit(False))
        out = out.withColumn("validity", F.explode(both)).withColumn("plausibility", F.explode(both))
    return out
