"""Catalogue of syllogistic forms: validity by model checking, fallacies, names. 256 rows at most."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The roles of (major subject, major predicate, minor subject, minor predicate) in each figure.
FIGURES = {
    1: ("M", "P", "S", "M"),
    2: ("P", "M", "S", "M"),
    3: ("M", "P", "M", "S"),
    4: ("P", "M", "M", "S"),
}
#: Traditional names by mood and figure; _ei marks those that presuppose existence.
NAMES = {
    ("AAA", 1): "barbara",
    ("EAE", 1): "celarent",
    ("AII", 1): "darii",
    ("EIO", 1): "ferio",
    ("AAI", 1): "barbari_ei",
    ("EAO", 1): "celaront_ei",
    ("EAE", 2): "cesare",
    ("AEE", 2): "camestres",
    ("EIO", 2): "festino",
    ("AOO", 2): "baroco",
    ("EAO", 2): "cesaro_ei",
    ("AEO", 2): "camestrop_ei",
    ("AAI", 3): "darapti_ei",
    ("IAI", 3): "disamis",
    ("AII", 3): "datisi",
    ("EAO", 3): "felapton_ei",
    ("OAO", 3): "bocardo",
    ("EIO", 3): "ferison",
    ("AAI", 4): "bramantip_ei",
    ("AEE", 4): "camenes",
    ("IAI", 4): "dimaris",
    ("EAO", 4): "fesapo_ei",
    ("EIO", 4): "fresison",
}
#: Bits of the eight regions of a three-set diagram; a model is a set of regions that aren't empty.
_BIT = {"S": 4, "P": 2, "M": 1}


def figures_in(figures: Iterable[int] | None) -> list[int]:
    chosen = sorted(set(FIGURES if figures is None else figures))
    if bad := [f for f in chosen if f not in FIGURES]:
        raise ValueError(f"unknown figures {bad}; known are {sorted(FIGURES)}")
    return chosen


def _regions(role: Column) -> Column:
    """For a role the mask of the regions inside its set."""
    mask = {r: sum(1 << k for k in range(8) if k & b) for r, b in _BIT.items()}
    return F.when(role == "S", mask["S"]).when(role == "P", mask["P"]).otherwise(mask["M"])


def _holds(form: Column, subject: Column, predicate: Column, model: Column) -> Column:
    """A statement holds in a model: its witnesses, inside subject and inside or outside predicate, exist or don't."""
    inside = _regions(subject).bitwiseAND(_regions(predicate)).bitwiseAND(model)
    outside = _regions(subject).bitwiseAND(F.bitwise_not(_regions(predicate))).bitwiseAND(model)
    return F.when(form == "A", outside == 0).when(form == "E", inside == 0).when(form == "I", inside != 0).otherwise(outside != 0)


def _moods(spark: SparkSession, figures: list[int]) -> DataFrame:
    """64 moods in each figure, counted off in one task."""
    n = F.col("id")
    letter = lambda e: F.substring(F.lit("AEIO"), (e % 4 + 1).cast("int"), F.lit(1))
    rows = spark.range(0, 64 * len(figures), 1, 1)
    rows = rows.select(
        letter(F.floor(n / 16)).alias("a"), letter(F.floor(n / 4)).alias("b"), letter(n).alias("c"),
        F.get(F.array(*map(F.lit, figures)), F.floor(n / 64).cast("int")).alias("figure"),
    )
    role = lambda k: F.coalesce(*[F.when(F.col("figure") == f, FIGURES[f][k]) for f in figures])
    return rows.select("*", F.concat("a", "b", "c").alias("mood"), *[role(k).alias(c) for k, c in enumerate(("ms", "mp", "ns", "np"))])


def _fallacy(semantics: str) -> Column:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    negative = lambda f: f.isin("E", "O").cast("int")
    particular = lambda f: f.isin("I", "O").cast("int")
    negatives, particulars = negative(a) + negative(b), particular(a) + particular(b)
    # a term is spoken of as a whole where it is the subject of A or E, or the predicate of E or O
    spread = lambda form, s, p, role: (form.isin("A", "E") & (s == role)) | (form.isin("E", "O") & (p == role))
    major = lambda r: spread(a, F.col("ms"), F.col("mp"), F.lit(r))
    minor = lambda r: spread(b, F.col("ns"), F.col("np"), F.lit(r))
    end = lambda r: spread(c, F.lit("S"), F.lit("P"), F.lit(r))
    return (
        F.when(negatives == 2, "exclusive_premises")
        .when((negatives == 1) & (negative(c) == 0), "affirmative_conclusion_from_negative_premise")
        .when((negatives == 0) & (negative(c) == 1), "negative_conclusion_from_affirmative_premises")
        .when(particulars == 2, "two_particular_premises")
        .when(~(major("M") | minor("M")), "undistributed_middle")
        .when(end("P") & ~major("P"), "illicit_major")
        .when(end("S") & ~minor("S"), "illicit_minor")
        .when(F.lit(semantics == "modern") & (particular(c) == 1) & (particulars == 0), "existential_fallacy")
        .otherwise("other_invalid_mood_figure")
    )


def form_catalog(spark: SparkSession, semantics: str = "aristotelian", figures: Iterable[int] | None = None) -> DataFrame:
    """(figure, mood, valid, name, fallacy, nth): nth counts the valid and the invalid forms apart, from 0, in catalogue order.

    A form is valid when no model makes its premises true and its conclusion false. ``aristotelian``
    admits only models in which all three terms have members, ``modern`` admits every model.
    """
    from pyspark.sql import Window

    if semantics not in ("aristotelian", "modern"):
        raise ValueError("semantics is aristotelian or modern")
    chosen = figures_in(figures)
    model = F.col("model")
    m = _moods(spark, chosen).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(255))))
    if semantics == "aristotelian":
        for r in "SPM":
            m = m.filter(_regions(F.lit(r)).bitwiseAND(model) != 0)
    counter = _holds(F.col("a"), F.col("ms"), F.col("mp"), model) & _holds(F.col("b"), F.col("ns"), F.col("np"), model) & ~_holds(
        F.col("c"), F.lit("S"), F.lit("P"), model
    )
    key = ["figure", "mood", "a", "b", "c", "ms", "mp", "ns", "np"]
    checked = m.groupBy(*key).agg((~F.bool_or(counter)).alias("valid"))
    names = spark.createDataFrame([(mood, figure, name) for (mood, figure), name in NAMES.items()], "mood string, figure int, named string")
    out = checked.join(F.broadcast(names), ["figure", "mood"], "left").select(
        "figure", "mood", "valid", F.coalesce("named", F.concat_ws("_", "mood", F.col("figure").cast("string"))).alias("name"),
        F.when(~F.col("valid"), _fallacy(semantics)).alias("fallacy"),
    )
    order = Window.partitionBy("valid").orderBy(F.coalesce("fallacy", F.lit("")), "figure", "mood", "name")
    return out.withColumn("nth", F.row_number().over(order) - 1)


def label_forms(df: DataFrame, semantics: str = "aristotelian", figures: Iterable[int] | None = None) -> DataFrame:
    """``df`` (mood, figure) with form_valid, form_name and form_fallacy; null where there is no such form."""
    c = form_catalog(df.sparkSession, semantics, figures).select(
        F.col("figure").alias("_f"), F.col("mood").alias("_m"), F.col("valid").alias("form_valid"), F.col("name").alias("form_name"),
        F.col("fallacy").alias("form_fallacy"),
    )
    return df.join(F.broadcast(c), (F.col("mood") == F.col("_m")) & (F.col("figure") == F.col("_f")), "left").drop("_f", "_m")
