"""Running scores of predictions that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(system, total, correct) over a stream of predictions (system, id, validity) against a fixed gold table (id, validity).

    Each micro-batch joins the gold table and updates one row of state for each system, so the
    state doesn't grow with the predictions. Write it in update or complete mode. Null predictions
    aren't counted; predictions for other ids are ignored.
    """
    g = gold.select("id", F.col("validity").alias("_gold")).filter("_gold is not null")
    joined = predictions.filter("validity is not null").join(g, "id")
    return joined.groupBy("system").agg(F.count("*").alias("total"), F.count_if(F.col("validity") == F.col("_gold")).alias("correct"))


def running_accuracy(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    return running_counts(predictions, gold).withColumn("accuracy", F.col("correct") / F.col("total") * 100)
