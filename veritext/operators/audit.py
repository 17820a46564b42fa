"""Dataset audits: every histogram of a report in one scan, one shuffle of small keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.functions.shared import written


def histograms(df: DataFrame, metrics: dict[str, Column], skip_null: tuple[str, ...] = ()) -> DataFrame:
    """(metric, key, n) for all metrics from one scan: rows are unpivoted to (metric, key) and counted map-side first.

    A null key is counted as such, but for metrics named in ``skip_null``.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), c.cast("string").alias("key")) for m, c in metrics.items()]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.metric", "x.key")
    if skip_null:
        rows = rows.filter(~(F.col("metric").isin(*skip_null) & F.col("key").isNull()))
    return rows.groupBy("metric", "key").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b, n) by pair and by each side alone (the other side null with its grouping flag set), in one shuffle."""
    rows = df.select(a.alias("a"), b.alias("b"))
    return rows.groupingSets([("a", "b"), ("a",), ("b",)], "a", "b").agg(
        F.grouping("a").cast("int").alias("all_a"), F.grouping("b").cast("int").alias("all_b"), F.count("*").alias("n")
    )


def position_counts(df: DataFrame, indexes: Column, first_late: int = 3) -> DataFrame:
    """One row: rows, missing (null or empty list), late, only_early, non_adjacent, max_index (-1 if none)."""
    x = F.coalesce(indexes, F.array().cast("array<int>"))
    some, late = F.size(x) > 0, T.is_late(x, first_late)
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(~some).alias("missing"),
        F.count_if(some & late).alias("late"),
        F.count_if(some & ~late).alias("only_early"),
        F.count_if(some & T.is_spread(x)).alias("non_adjacent"),
        F.coalesce(F.max(F.array_max(x)), F.lit(-1)).alias("max_index"),
    )


def index_histogram(df: DataFrame, indexes: Column) -> DataFrame:
    return df.select(F.explode(indexes).alias("index")).groupBy("index").agg(F.count("*").alias("n"))


def top_sets(df: DataFrame, indexes: Column, limit: int = 20, in_order: bool = False) -> DataFrame:
    """The most frequent index sets as text, by count and then by key. ``in_order`` takes lists as they stand."""
    key = T.list_text(indexes if in_order else F.array_sort(indexes))
    by = df.filter(indexes.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "key").limit(limit)


def valid_position_counts(df: DataFrame, valid: Column, indexes: Column, first_late: int = 3) -> DataFrame:
    """Of valid rows with two indexes: how many there are, late ones, and those more than one apart."""
    two = valid & (F.size(indexes) == 2)
    return df.agg(
        F.count_if(valid).alias("valid_rows"),
        F.count_if(two & T.is_late(indexes, first_late)).alias("late"),
        F.count_if(two & (F.abs(F.get(indexes, F.lit(0)) - F.get(indexes, F.lit(1))) > 1)).alias("non_adjacent"),
    )


def artifact_warnings(df: DataFrame, indexes: Column, valid_key: Column, first_late: int = 3, most: float = 0.40, least: float = 0.35) -> DataFrame:
    """(warning, value) rows: no late index at all; one set above ``most`` of the rows that have one; a label below ``least``."""
    x = F.coalesce(indexes, F.array().cast("array<int>"))
    pos = position_counts(df, indexes, first_late).filter("late = 0").select(F.lit("no_late_index").alias("warning"), F.lit(0.0).alias("value"))
    sets = df.filter(F.size(x) > 0).groupBy(T.list_text(F.array_sort(x)).alias("key")).count()
    top = sets.agg((F.max("count") / F.sum("count")).alias("value")).filter(F.col("value") > most)
    labels = df.filter(valid_key.isNotNull()).groupBy(valid_key.alias("k")).count()
    two = labels.agg((F.min("count") / F.sum("count")).alias("value"), F.count("*").alias("kinds")).filter((F.col("kinds") == 2) & (F.col("value") < least))
    return pos.union(top.select(F.lit("dominant_set").alias("warning"), "value")).union(two.select(F.lit("unbalanced_labels").alias("warning"), "value"))


def sentence_counts(df: DataFrame, text: Column, first: Column | None = None) -> DataFrame:
    """(sentence, n) over the first ``first`` sentences of each text (default: all), by signature."""
    parts = T.sentences(text)
    parts = F.slice(parts, F.lit(1), first) if first is not None else parts
    # sentences come normalised, so their signature is their lower case
    return df.select(F.explode(parts).alias("p")).groupBy(F.lower("p").alias("sentence")).agg(F.count("*").alias("n"))


def top_sentences(df: DataFrame, text: Column, limit: int = 20, first: Column | None = None) -> DataFrame:
    """The most repeated sentences; ties by the sentence. A bounded sort, never a full one."""
    return sentence_counts(df, text, first).orderBy(F.desc("n"), "sentence").limit(limit)


def style_counts(
    df: DataFrame, text: Column, premises: Column, plain: str = T.CATEGORICAL, marker: str = "Therefore,", pronoun: str = " of them "
) -> DataFrame:
    """One row: canonical and other premises, marked and other conclusions, rows with a loose pronoun.

    ``premises`` says how many of a row's sentences are premises; it may use the column parts, its sentences.
    """
    parts = T.sentences(text)
    body = df.withColumns({"parts": parts, "t": text}).select("parts", "t", premises.alias("k"))
    head = F.slice("parts", F.lit(1), F.col("k"))
    canonical = F.size(F.filter(head, lambda s: T.is_categorical(s, plain)))
    closes = T.ends_with_conclusion(F.col("parts"), marker)
    return body.agg(
        F.sum(canonical).alias("canonical"),
        F.sum(F.size(head) - canonical).alias("other"),
        F.count_if(closes).alias("therefore"),
        F.count_if(~closes & (F.size("parts") > 0)).alias("other_conclusion"),
        F.count_if(T.has_loose_pronoun(F.col("t"), pronoun)).alias("loose_pronoun"),
    )


#: Style counters of the report, in the order of ``style_counts``.
STYLE = ("canonical", "other", "therefore", "other_conclusion", "loose_pronoun")
#: What a counted group is: the labels of a row, or the hash of a core, a text or a premise.
_LABELS, _CORE, _TEXT, _PREMISE = range(4)


def example_audit(examples: DataFrame, limit: int = 20) -> DataFrame:
    """Long report (metric, key, n) over examples with a metadata column (the generator's layout).

    The examples are read twice. The first reading counts everything in one aggregate: rows by all their labels
    together, from whose few combinations the histograms follow, and texts, cores and premises as 128-bit hashes,
    so that no text is moved; each premise keeps the 64-bit hash of one of its texts. The second finds the wordings
    of the premises that are repeated most: it cuts only the texts whose hashes are known by then. Ties at the
    ``limit``-th place are broken by the sentence.
    """
    m = F.col("metadata")

    def cut(df: DataFrame) -> DataFrame:
        df = df.withColumn("_text", T.normalise(F.col("syllogism"))).withColumn("_parts", T.normal_sentences(F.col("_text")))
        return df.withColumn("_head", F.slice("_parts", F.lit(1), m["premise_count"]))

    closes = T.ends_with_conclusion(F.col("_parts"), "Therefore,")
    labels = F.struct(
        m["source"].alias("source"), m["style"].alias("style"), m["schema_name"].alias("schema"), m["mood"].alias("mood"), m["figure"].alias("figure"),
        m["fallacy"].alias("fallacy"), m["premise_count"].alias("premise_count"), m["candidate_premises"].alias("candidates"),
        F.when(F.col("validity"), F.col("relevant_premises")).alias("relevant"), m["core_premise_order_in_output"].alias("core_order"),
        m["num_injected_distractors"].alias("injected"), "validity", "plausibility",
        closes.alias("therefore"), (~closes & (F.size("_parts") > 0)).alias("other_conclusion"), F.contains("_low", F.lit(" of them ")).alias("loose_pronoun"),
    )
    # by place: nothing (the labels), the core, the text and the premises
    said = F.concat(F.array(F.lit(None).cast("string"), m["core_signature"], "_low"), F.coalesce("_head", F.array().cast("array<string>")))
    rows = cut(examples).withColumn("_low", F.lower("_text")).select(labels.alias("labels"), F.xxhash64("syllogism").alias("t"), F.posexplode(said).alias("at", "s"))
    at, premise = F.col("at"), F.col("at") >= _PREMISE
    # sentences come normalised, so their signature is their lower case
    rows = rows.filter((at == _LABELS) | F.col("s").isNotNull()).withColumn("_key", F.when(premise, F.lower("s")).otherwise(F.col("s")))
    rows = rows.select(
        F.least(at, F.lit(_PREMISE)).alias("kind"), F.when(at == _LABELS, F.col("labels")).alias("labels"), *_hashes("_key"), "t",
        F.when(premise, T.is_categorical(F.col("s"))).cast("int").alias("plain"),
    )
    counts = rows.groupBy("kind", "labels", "h", "g").agg(F.count("*").alias("n"), F.sum("plain").alias("plain"), F.min("t").alias("t"))
    counts = written(counts.filter(F.col("kind").isin(_LABELS, _PREMISE) | (F.col("n") > 1)), "audit-counts")

    kind, n, of = F.col("kind"), F.col("n"), lambda c: F.col("labels")[c]
    total = lambda where, what=n: F.coalesce(F.sum(F.when(where, what)), F.lit(0))
    style = {"canonical": total(kind == _PREMISE, F.col("plain")), "other": total(kind == _PREMISE, n - F.col("plain"))}
    style |= {k: total(of(k)) for k in STYLE if k not in style}
    once = [("rows", None, total(kind == _LABELS)), *[("style_counter", k, style[k]) for k in STYLE]]
    once += [("duplicate_core", None, total(kind == _CORE, n - 1)), ("duplicate_text", None, total(kind == _TEXT, n - 1))]
    once += [("max_premise_repetition", None, F.coalesce(F.max(F.when(kind == _PREMISE, n)), F.lit(0)))]
    entry = lambda metric, key, n: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), n.alias("n"))
    summed = counts.agg(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(once)])
    summed = summed.select(F.inline(F.array(*[entry(k, F.lit(key), F.col(f"v{i}")) for i, (k, key, _) in enumerate(once)])))

    label = lambda c: F.initcap(of(c).cast("string"))
    metrics = {
        "source": of("source"), "style": of("style"), "schema": of("schema"), "mood_figure": F.concat_ws("-", of("mood"), of("figure").cast("string")),
        "figure": of("figure"), "fallacy": F.nullif(of("fallacy"), F.lit("")), "premise_count": of("premise_count"),
        "candidate_pair": T.list_text(of("candidates")), "relevant_pair_valid_only": T.list_text(of("relevant")),
        "core_order": F.coalesce(of("core_order"), F.lit("unknown")), "injected": F.coalesce(of("injected"), F.greatest(F.lit(0), of("premise_count") - 2)),
        "validity": label("validity"), "plausibility": label("plausibility"),
        "validity_plausibility": F.concat(F.lit("validity="), label("validity"), F.lit(",plausibility="), label("plausibility")),
    }
    skip_null = ("schema", "mood_figure", "figure", "fallacy", "relevant_pair_valid_only")
    by = counts.filter(kind == _LABELS).select(F.inline(F.array(*[entry(k, c, n) for k, c in metrics.items()])))
    by = by.filter(~F.col("metric").isin(*skip_null) | F.col("key").isNotNull()).groupBy("metric", "key").agg(F.sum("n").alias("n"))

    premises = counts.filter(kind == _PREMISE).select("h", "g", "n", "t")
    least = premises.orderBy(F.desc("n")).limit(limit).agg(F.min("n").alias("least"))
    asked = written(premises.join(F.broadcast(least), F.col("n") >= F.col("least")).select("h", "g", "n", "t"), "audit-premises")
    told = cut(examples.join(asked.select("t").distinct(), F.xxhash64("syllogism") == F.col("t"), "left_semi"))
    told = told.select(F.explode("_head").alias("s")).select(F.lower("s").alias("s")).select("s", *_hashes("s"))
    top = told.join(asked, ["h", "g"]).select("s", "n").distinct().orderBy(F.desc("n"), "s").limit(limit)
    return by.union(summed).union(top.select(F.lit("top_premise"), "s", "n"))


def _hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")
