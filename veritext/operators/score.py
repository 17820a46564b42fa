"""Scoring of predictions: answers, rewards, accuracy, content effect. Predictions are read once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.shared import numbered, written
from veritext.sources.readers import field


def parse_word(answer: Column, word: str = "TRUE") -> Column:
    """True where the answer contains the word, anywhere and in this case."""
    return F.coalesce(F.contains(answer, F.lit(word)), F.lit(False))


def last_part(answer: Column) -> Column:
    """Text after the last full stop; empty where the answer ends in one."""
    return F.element_at(F.split(F.trim(F.regexp_replace(answer, r"^\s+|\s+$", "")), r"\."), -1)


def parse_reasoned(answer: Column) -> Column:
    """True where the part after the last full stop holds the word valid."""
    return F.coalesce(last_part(answer).rlike(r"\bvalid\b"), F.lit(False))


def reward(completion: Column, valid: Column, strict_both: bool = False) -> Column:
    """1 where the last part names the gold verdict, -1 where it names the other one, 0 where it names none or is negated.

    With both words in it the verdict counts as named (1), or as none (0) with ``strict_both``.
    """
    part = last_part(F.lower(completion))
    says_valid, says_invalid = part.rlike(r"\bvalid\b"), part.rlike(r"\binvalid\b")
    none = part.rlike(r"\bnot\b|n't\b") | ~(says_valid | says_invalid)
    if strict_both:
        none = none | (says_valid & says_invalid)
    right = F.when(valid, says_valid).otherwise(says_invalid)
    return F.when(none | completion.isNull(), 0.0).when(right, 1.0).otherwise(-1.0)


def last_gold(gold: DataFrame, order: Column) -> DataFrame:
    """One row for each id: of repeated ids the last by ``order``."""
    return gold.groupBy("id").agg(F.max_by(F.struct("validity", "plausibility"), order).alias("g")).select("id", "g.*")


def score(gold: DataFrame, predictions: DataFrame, order: Column | None = None, plausibility: bool | None = None) -> DataFrame:
    """Accuracy, content effect and combined score of each system.

    ``gold`` (id, validity, plausibility), ``predictions`` (system, id, validity). Predictions for
    other ids are ignored, repeated ones all count, and of repeated gold ids the last by ``order``
    wins (default: the greatest labels). A system that leaves a gold id out scores 0 throughout
    and has status ``incomplete``. A null prediction covers its id but isn't counted. A cell
    without rows counts as accuracy 0. Values aren't rounded.

    ``plausibility`` keeps gold rows of that label only (null labels go).

    Gold ids are numbered and written first. Predictions are then read once, joined with them, and
    counted in one aggregate by system and block of gold numbers, which also collects the covered numbers as bitmaps.
    """
    if plausibility is not None:
        gold = gold.filter(F.col("plausibility") == plausibility)
    g = last_gold(gold, order if order is not None else F.struct("validity", "plausibility"))
    g = written(numbered(g, F.col("id"), "nth"), "gold")
    size = g.agg(F.count("*").alias("gold_rows"))
    joined = predictions.select("system", "id", F.col("validity").alias("said")).join(g, "id", "left")
    counted = F.col("said").isNotNull() & F.col("validity").isNotNull()
    right = counted & (F.col("said") == F.col("validity"))
    cell = lambda v, b: (F.col("validity") == v) & (F.col("plausibility") == b)
    cells = {"vp": cell(True, True), "vi": cell(True, False), "ip": cell(False, True), "ii": cell(False, False)}
    counts = {"total": counted, "correct": right}
    for k, c in cells.items():
        counts |= {"n_" + k: counted & c, "c_" + k: right & c}
    # which gold ids a system covers: one bit each, by blocks of 32,768 numbers, in the aggregate that counts
    bit = F.when(F.col("nth").isNotNull(), F.bitmap_bit_position(F.col("nth") + 1))
    joined = joined.withColumn("bit", bit)
    blocks = joined.groupBy("system", F.bitmap_bucket_number(F.col("nth") + 1).alias("block")).agg(
        F.bitmap_construct_agg("bit").alias("bits"), *[F.count_if(c).alias(k) for k, c in counts.items()]
    )
    covered = F.sum(F.when(F.col("block").isNotNull(), F.bitmap_count("bits")).otherwise(F.lit(0)))
    s = blocks.groupBy("system").agg(covered.alias("covered"), *[F.sum(k).alias(k) for k in counts]).crossJoin(F.broadcast(size))
    complete = F.coalesce("covered", F.lit(0)) == F.col("gold_rows")
    share = lambda c, n: F.when(complete & (F.coalesce(F.col(n), F.lit(0)) > 0), F.col(c) / F.col(n) * 100).otherwise(0.0)
    s = s.select(
        "system", complete.alias("complete"), share("correct", "total").alias("accuracy"), *[share("c_" + k, "n_" + k).alias(k) for k in cells],
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"),
    )
    intra = (F.abs(F.col("vp") - F.col("vi")) + F.abs(F.col("ip") - F.col("ii"))) / 2
    inter = (F.abs(F.col("vp") - F.col("ip")) + F.abs(F.col("vi") - F.col("ii"))) / 2
    s = s.withColumn("intra", intra).withColumn("inter", inter).withColumn("content_effect", (F.col("intra") + F.col("inter")) / 2)
    return s.select(
        "system", "total", "correct", "accuracy", "intra", "inter", "content_effect",
        F.when(F.col("complete"), combined(F.col("accuracy"), F.col("content_effect"))).otherwise(0.0).alias("combined"),
        F.when(F.col("complete"), "ok").otherwise("incomplete").alias("status"),
    )


def combined(accuracy: Column, effect: Column) -> Column:
    """Accuracy damped by the logarithm of the content effect; a negative effect gives 0."""
    return F.when(effect < 0, 0.0).otherwise(accuracy / (1 + F.log1p(effect)))


def score_files(spark: SparkSession, gold: DataFrame, systems: dict[str, str], order: Column | None = None) -> DataFrame:
    """``score`` for prediction files: ``systems`` maps names to JSON-array files of (id, validity), or to folders of them.

    A system whose file isn't there, or isn't an array of objects with a text as id, scores 0 with
    content effect 100 and has status ``unreadable``; it doesn't stop the others. A validity that isn't
    a boolean counts as none.
    """
    raw = spark.createDataFrame([(s, None) for s in systems], "system string, value string")
    for name, path in systems.items():
        try:
            raw = raw.union(spark.read.text(path, wholetext=True).select(F.lit(name), "value"))
        except AnalysisException:  # no such path: the system has no file
            continue
    files = raw.filter("value is not null").select("system", F.try_parse_json("value").alias("doc"))
    is_array = F.coalesce(F.schema_of_variant("doc").startswith("ARRAY"), F.lit(False))
    files = files.withColumn("items", F.when(is_array, F.try_variant_get("doc", "$", "array<variant>")))
    files = files.withColumn("good", F.coalesce(F.forall("items", lambda v: field(v, "id", "string").isNotNull()), F.lit(False)))
    by = raw.select("system").distinct().join(files.groupBy("system").agg(F.bool_and("good").alias("good")), "system", "left")
    bad = by.filter(~F.coalesce("good", F.lit(False))).select("system")
    one = files.join(bad, "system", "left_anti").select("system", F.explode("items").alias("v"))
    said = one.select("system", field(F.col("v"), "id", "string").alias("id"), field(F.col("v"), "validity", "boolean").alias("validity"))
    out = score(gold, said, order)
    # files without items have no row of predictions
    empty = by.select("system").join(bad, "system", "left_anti").join(out.select("system"), "system", "left_anti")
    zero = lambda t, effect, status: t.select(
        "system", *[F.lit(0).cast("long").alias(c) for c in ("total", "correct")], *[F.lit(0.0).alias(c) for c in ("accuracy", "intra", "inter")],
        F.lit(effect).alias("content_effect"), F.lit(0.0).alias("combined"), F.lit(status).alias("status"),
    )
    return out.union(zero(bad, 100.0, "unreadable")).union(zero(empty, 0.0, "incomplete"))
