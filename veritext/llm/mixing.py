"""Mixing sources to target weights by Pareto order sampling (operator 9), DataFrame functions only.

Each source's target is its weight's share of all words, capped at ``max_copies`` times the
source's own words, the excess shared out again by weight (water filling, in closed form). Inside a
source longer documents are wanted more: a document's expected number of copies is in proportion to
4 + class, where class is the number of binary digits of size + 1, less one, so that a text of a
thousand words counts for 13 and one of ten words for 7; no document expects more than ``max_copies``,
the excess going to the others of its source by the same water filling.

The whole part of an expectation are certain copies. The rest, f, is an inclusion probability,
unequal over documents: they are ranked by random odds over inclusion odds,
Q = (u / (1 - u)) / (f / (1 - f)) (Rosen, 1997), and taken in this order until their words come nearest
to what is missing. u comes from a hash of seed and id, so a rerun, or a run on another number of
partitions, takes the same documents.

No source is ranked in one task: Q / (1 + Q) is cut into ranges, words are added up for each source and
range, and only the documents of the one range that holds the cut go on. Where inclusion
probabilities near 0 or 1 pile documents up in one range, it is cut again, a few thousand times finer each
time, until 20,000 documents at most are left to a source; these are ranked. What passes through one task is a row for each source (and, within a source, for each size class and
range): ten million sources are about a gigabyte.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import WORD, materialise

#: What the shortest documents count for; each doubling of the size adds one.
_LEAST = 4
_RANGE, _FINER = 20_000, 4_096


def _level(rows: DataFrame, part: list[str], total: Column, cap: str, weight: str, order: list[Column]) -> DataFrame:
    """``rows`` with level: within each ``part`` the sum of least(cap, level * weight) is ``total``; null where all are full.

    Rows fill up in the order of cap / weight, which ``order`` gives; the level is where the
    remaining total meets the remaining weights.
    """
    fill, everything = Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*part)
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = rows.select(
        "*",
        F.row_number().over(fill).alias("nth"),
        F.coalesce(F.sum(cap).over(upto), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum(weight).over(upto), F.lit(0)).alias("w_before"),
        F.sum(weight).over(everything).alias("w_total"),
        total.alias("all"),
    )
    s = s.withColumn("level", (F.col("all") - F.col("cap_before")) / (F.col("w_total") - F.col("w_before")))
    free = F.col("level") * F.col(weight) <= F.col(cap)
    return s.withColumn("level", F.min(F.when(free, F.struct("nth", "level"))).over(everything)["level"]).select(*rows.columns, "level")


def _targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """Per source (src, source_size): its target. One row for each source throughout."""
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    k = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(k)) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    total = F.sum("source_size").over(Window.partitionBy())
    s = _level(s, [], total, "cap", "w", [(F.col("cap") / F.col("w")).asc(), F.col("src").asc_nulls_last()])
    target = F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return s.select("src", "source_size", target.alias("target"))


def _expectations(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(src, k, source_size, target, base, f, missing) from (src, k, words): what a document of each size class gets."""
    wanted = F.lit(_LEAST) + F.col("k")
    named = targets.withColumnRenamed("src", "t_src")
    c = classes.join(named, F.col("src").eqNullSafe(F.col("t_src"))).drop("t_src")
    c = c.withColumn("cap", F.col("words") * max_copies).withColumn("w", wanted * F.col("words"))
    filled = _level(c.filter("words > 0"), ["src"], F.col("target"), "cap", "w", [F.col("k").desc()])
    level = filled.groupBy("src").agg(F.first("level").alias("level")).withColumnRenamed("src", "l_src")
    c = c.join(level, F.col("src").eqNullSafe(F.col("l_src")), "left")
    copies = F.when(F.col("source_size") == 0, 0.0).when(F.col("level") * wanted < max_copies, F.col("level") * wanted).otherwise(float(max_copies))
    c = c.withColumn("copies", copies).withColumn("base", F.floor("copies").cast("long")).withColumn("f", F.col("copies") - F.col("base"))
    certain = F.sum(F.col("base") * F.col("words")).over(Window.partitionBy("src"))
    return c.withColumn("missing", F.col("target") - certain).select("src", "k", "source_size", "target", "base", "f", "missing")


def _parted(j: DataFrame, cell: Column, bins: int, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents on either side of the range that holds their source's cut (with drawn), and those in it (with before).

    ``cell`` is from 0 to 1 and rises with q; ``before`` has (b_src, base_before), the words of documents
    that come before all of ``j``'s. One row for each source and range is added up in Spark.
    """
    j = j.filter("q is not null").withColumn("bin", F.greatest(F.lit(0), F.least(F.floor(cell * bins), F.lit(bins - 1))).cast("int"))
    by_bin = j.groupBy("src", "bin").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    if before is None:
        by_bin = by_bin.withColumn("base_before", F.lit(0).cast("long"))
    else:
        by_bin = by_bin.join(before, F.col("src").eqNullSafe(F.col("b_src"))).drop("b_src")
    over = Window.partitionBy("src").orderBy("bin")
    by_bin = by_bin.withColumn("upto", F.col("base_before") + F.sum("words").over(over)).withColumn("before", F.col("upto") - F.col("words"))
    cut = by_bin.filter("before < missing and missing <= upto").select(F.col("src").alias("c_src"), F.col("bin").alias("cut"), "before")
    # written, so that its size is known when the join with the documents is planned: small ones are broadcast
    cut = materialise(cut, "op9-ranges")
    j = j.join(cut, F.col("src").eqNullSafe(F.col("c_src")), "left").drop("c_src")
    # no range holds the cut where the need is below all or, by a rounding of its last digit, above all words
    side = F.when(F.col("cut").isNull(), F.col("missing") > 0).otherwise(F.col("bin") < F.col("cut"))
    inside = F.col("cut").isNotNull() & (F.col("bin") == F.col("cut"))
    return j.filter(~inside).withColumn("drawn", side), j.filter(inside).drop("bin", "cut")


def _at_cut(j: DataFrame, bins: int, ranked: int, rounds: int = 6) -> tuple[list[DataFrame], DataFrame]:
    """Documents whose draw is decided (with drawn), and those left in the range of their source's cut (with before), ``ranked`` of a source at most."""
    decided, left = _parted(j, F.col("y"), bins)
    sure, left, cell, n = [decided], materialise(left, "op9-cut"), F.col("y"), bins
    for _ in range(rounds):
        most = left.groupBy("src").count().agg(F.max("count")).first()[0] or 0  # one row for each source
        if most <= ranked:
            break
        # where in its range a document lies, from 0 to 1
        cell = cell * n - F.greatest(F.lit(0), F.least(F.floor(cell * n), F.lit(n - 1)))
        n = _FINER
        before = left.groupBy(F.col("src").alias("b_src")).agg(F.first("before").alias("base_before"))
        decided, finer = _parted(left.drop("before"), cell, n, before)
        sure.append(decided)
        left = materialise(finer, "op9-cut")
    return sure, left


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "mix-1",
    bins: int | None = None,
    ranked: int = _RANGE,
) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken.

    ``weights`` are dealt to the sources in code-point order, null last, repeating. size is the
    number of words, taken is copies * size. At most ``ranked`` documents of a source are ranked in a
    task, but for documents with one random number and size class (rows that repeat an id).

    Defined cases: a null text has size 0; a null source is a source of its own; documents of
    size 0 get copies like any other and add no words; a source without words has target 0 and
    no copies. Very long texts are counted whole. Rows repeated with one id share their random number and are ranked next to each
    other. A null id is a value like any other. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    ident = F.col(id_col).cast("long")
    named = F.concat_ws(":", F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.sha2(named, 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    d = materialise(
        docs.select(ident.alias("id"), F.col(source_col).cast("string").alias("src"), words.cast("long").alias("size"), u.alias("u")),
        "op9",
    )
    bins = bins or max(4096, d.count() // _RANGE)
    d = d.withColumn("k", F.length(F.bin(F.col("size") + 1)) - 1)
    classes = materialise(d.groupBy("src", "k").agg(F.sum("size").alias("words")), "op9-classes")
    sizes = classes.groupBy("src").agg(F.sum("words").alias("source_size"))
    plan = materialise(_expectations(classes, _targets(sizes, weights, max_copies), max_copies), "op9-plan")

    p = plan.withColumnsRenamed({"src": "p_src", "k": "p_k"})
    j = d.join(p, F.col("src").eqNullSafe(F.col("p_src")) & (F.col("k") == F.col("p_k"))).drop("p_src", "p_k")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    j = j.withColumn("q", F.when(F.col("f") > 0, odds)).withColumn("y", F.col("q") / (1 + F.col("q")))
    sure, left = _at_cut(j, bins, ranked)
    sure.append(j.filter("q is null").withColumn("drawn", F.lit(False)))
    inside = Window.partitionBy("src").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    columns = ["id", "size", "source_size", "target", "base", "drawn"]
    out = left.withColumn("drawn", middle <= F.col("missing")).select(*columns)
    for part in sure:
        out = out.union(part.select(*columns))
    copies = F.col("base") + F.col("drawn").cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
