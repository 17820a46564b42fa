"""Validation rules: rows to violations (row, rule, detail). Each row stops at the rules that make later ones meaningless."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.operators.dedup import flag_all_repeats, flag_repeats
from veritext.operators.forms import figures_in, label_forms


class ViolationError(ValueError):
    """A dataset breaks its rules."""


def _rule(name: str, broken: Column, detail: Column | None = None) -> Column:
    text = detail.cast("string") if detail is not None else F.lit(None).cast("string")
    return F.when(broken, F.struct(F.lit(name).alias("rule"), F.coalesce(text, F.lit("")).alias("detail")))


def _found(rules: list[Column], each: list[Column]) -> Column:
    """All violations of a row; rules: one struct or null each; each: arrays of structs."""
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    for e in each:
        found = F.concat(found, F.coalesce(e, F.array().cast("array<struct<rule:string,detail:string>>")))
    return found


def _listed(marked: DataFrame) -> DataFrame:
    return marked.select("row", F.posexplode("violations").alias("nth", "v")).select("row", "nth", "v.rule", "v.detail")


def stress_violations(df: DataFrame, row: Column, premise_counts: Iterable[int] = (4, 5, 6), marker: str = "Therefore,") -> DataFrame:
    """Violations of a hand-made set: (row, nth, rule, detail), nth in rule order. See ``mark_stress``."""
    return _listed(mark_stress(df, row, premise_counts, marker))


def mark_stress(df: DataFrame, row: Column, premise_counts: Iterable[int] = (4, 5, 6), marker: str = "Therefore,") -> DataFrame:
    """(row, violations, kept) for each row of a hand-made set: its violations in rule order, and the row itself as a struct.

    ``df`` has id, syllogism, validity, plausibility, relevant_premises; a column may be absent
    altogether, and a null counts as a missing field. ``row`` orders the rows and must be unique;
    of equal texts all but the first are duplicates.
    """
    need = ["id", "syllogism", "validity", "plausibility", "relevant_premises"]
    kinds = {"id": "string", "syllogism": "string", "validity": "boolean", "plausibility": "boolean", "relevant_premises": "array<int>"}
    rows = df.select(row.alias("row"), F.struct(*df.columns).alias("kept"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in need])
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in need]), lambda c: c.isNotNull())
    rows = rows.withColumn("missing", missing)
    full = F.size("missing") == 0
    rows = flag_repeats(rows, F.when(full, F.col("syllogism")), [F.col("row")], "again")
    rows = rows.withColumn("n", F.size(T.premises_and_conclusion(F.col("syllogism"), marker)["premises"]))
    rel, n = F.col("relevant_premises"), F.col("n")
    rules = [
        _rule("missing_fields", ~full, F.array_join("missing", ",")),
        _rule("duplicate_text", F.col("again")),
        _rule("premise_count", full & ~n.isin(*premise_counts), n),
        _rule("relevant_count", full & F.col("validity") & (F.size(rel) != 2), F.size(rel)),
        _rule("relevant_not_empty", full & ~F.col("validity") & (F.size(rel) > 0), F.size(rel)),
    ]
    bad = F.transform(F.filter(rel, lambda i: (i < 0) | (i >= n)), lambda i: F.struct(F.lit("relevant_range").alias("rule"), i.cast("string").alias("detail")))
    return rows.select("row", _found(rules, [F.when(full, bad)]).alias("violations"), "kept")


def example_violations(df: DataFrame, row: Column, semantics: str = "aristotelian", figures: Iterable[int] | None = None) -> DataFrame:
    """Violations of generated examples: (row, nth, rule, detail). See ``mark_examples``."""
    return _listed(mark_examples(df, row, semantics, figures))


def mark_examples(df: DataFrame, row: Column, semantics: str = "aristotelian", figures: Iterable[int] | None = None) -> DataFrame:
    """(row, violations, kept) for each generated example: its violations, and the row itself as a struct; ``df`` has the generator's layout.

    Duplicates are all but the first row of a normalised text, of an id, and of a synthetic core (a
    core that an earlier row of any source has makes a synthetic one a duplicate, not the reverse).
    """
    m = F.col("metadata")
    x = df.select(
        row.alias("row"), F.struct(*df.columns).alias("kept"), F.col("syllogism").alias("text"), F.col("id").alias("id") if "id" in df.columns else F.lit(None).cast("string").alias("id"),
        "validity", "plausibility", F.col("relevant_premises").alias("rel"), m.isNull().alias("no_meta"), m["source"].alias("source"),
        m["core_signature"].alias("core"), m["premise_count"].alias("premises"), m["mood"].alias("mood"), m["figure"].alias("figure"),
    )
    has_text = F.col("text").isNotNull()
    keys = {"again_text": T.signature(F.col("text")), "again_id": F.when(has_text, F.col("id")), "again_core": F.col("core")}
    x = flag_all_repeats(x, keys, [F.col("row")])
    x = x.withColumn("again_core", F.col("again_core") & (F.col("source") == "synthetic"))
    x = label_forms(x, semantics).withColumn("found", F.size(T.sentences(F.col("text"))))
    meta = has_text & ~F.col("no_meta")
    counted = meta & F.col("premises").isNotNull()
    whole = counted & (F.col("found") == F.col("premises") + 1)
    v, rel = F.col("validity"), F.col("rel")
    rules = [
        _rule("text_missing", ~has_text),
        _rule("duplicate_text", F.col("again_text")),
        _rule("duplicate_id", F.col("again_id"), F.col("id")),
        _rule("metadata_missing", has_text & F.col("no_meta")),
        _rule("core_missing", meta & F.col("core").isNull()),
        _rule("duplicate_core", meta & F.col("again_core")),
        _rule("premise_count_missing", meta & F.col("premises").isNull()),
        _rule("sentence_count", counted & ~whole, F.col("found")),
        _rule("validity_missing", whole & v.isNull()),
        _rule("plausibility_missing", whole & F.col("plausibility").isNull()),
        _rule("relevant_missing", whole & rel.isNull()),
        _rule("relevant_count", whole & v & (F.size(rel) != 2), F.size(rel)),
        _rule("relevant_not_empty", whole & ~v & (F.size(rel) > 0), F.size(rel)),
    ]
    late = [_rule("form_mismatch", whole & (F.col("form_valid") != v), F.concat_ws("-", "mood", F.col("figure").cast("string")))]
    if figures is not None:
        late.insert(0, _rule("figure", whole & ~F.col("figure").isin(*figures_in(figures)), F.col("figure")))
    bad = F.transform(
        F.filter(rel, lambda i: (i < 0) | (i >= F.col("premises"))), lambda i: F.struct(F.lit("relevant_range").alias("rule"), i.cast("string").alias("detail"))
    )
    found = _found(rules, [F.when(whole, bad), F.filter(F.array(*late), lambda r: r.isNotNull())])
    return x.select("row", found.alias("violations"), "kept")


def fail_on(violations: DataFrame, shown: int = 30) -> None:
    """Stop with the first rows of ``violations``, and how many more there are, if there are any."""
    first = violations.limit(shown).collect()
    if first:
        more = violations.count() - len(first) if len(first) == shown else 0
        raise ViolationError("; ".join(str(r.asDict()) for r in first) + (f"; and {more} more" if more else ""))


def violation_report(violations: DataFrame, shown: int = 100) -> DataFrame:
    """The first ``shown`` of ``violations`` by (row, nth), and one row (row and nth null, rule ``more``) whose detail is the number of the rest, if any."""
    first = violations.orderBy("row", "nth").limit(shown)
    rest = violations.agg((F.count("*") - shown).alias("n")).filter("n > 0")
    none = lambda c: F.lit(None).cast(violations.schema[c].dataType).alias(c)
    return first.select("row", "nth", "rule", "detail").union(rest.select(none("row"), none("nth"), F.lit("more"), F.col("n").cast("string")))


@dataclass(frozen=True)
class Gate:
    """What was counted while a table was written, and whether it was published."""

    published: bool
    rows: int
    broken: int
    violations: int
    first: str | None


def publish(marked: DataFrame, path: str, kind: str = "parquet", strict: bool = True, **options: str) -> Gate:
    """Write the rows of ``marked`` (row, violations, kept) to ``path``, which is there only if no row breaks a rule.

    One reading: rows go to a staging folder beside ``path`` while their violations are counted
    (``DataFrame.observe``). Without any the folder is renamed; else it is removed, and a ViolationError
    tells the counts and the first violation by row, or with ``strict`` off the Gate does. A task that runs
    twice writes its files once, as the writer commits them, and counts once.
    """
    spark, counts = marked.sparkSession, Observation()
    n = F.size("violations")
    first = F.min(F.when(n > 0, F.struct("row", F.get("violations", F.lit(0)).alias("v"))))
    seen = marked.observe(
        counts, F.count("*").alias("rows"), F.count_if(n > 0).alias("broken"), F.coalesce(F.sum(n), F.lit(0)).alias("violations"),
        F.concat_ws(" ", first["row"].cast("string"), first["v"]["rule"], first["v"]["detail"]).alias("first"),
    )
    there = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = there(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(there(path)):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        seen.select("kept.*").write.options(**options).format(kind).save(staging)
        x = counts.get
        gate = Gate(not x["violations"], x["rows"], x["broken"], x["violations"], x["first"] or None)
        if gate.published and not store.rename(there(staging), there(path)):
            raise OSError(f"{staging} couldn't be renamed to {path}")
    finally:
        store.delete(there(staging), True)
    if strict and not gate.published:
        raise ViolationError(f"{gate.violations} violations in {gate.broken} of {gate.rows} rows, the first: {gate.first}")
    return gate
