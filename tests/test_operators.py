import math
import os
import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from veritext.functions import order
from veritext.jobs import queries
from veritext.operators import audit, cells, dedup, formats, forms, generate, published, rules, score


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 3])
def test_similar_pairs_equal_brute_force(spark, k):
    r = random.Random(k)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 13))) for _ in range(160)] + ["été", "ete", "A  b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x.id_a, x.id_b): x.distance for x in dedup.similar_pairs(df, k=k).collect()}
    flat = [" ".join(t.split()).lower() for t in texts]
    want = {(i, j): d for i, j in combinations(range(len(texts)), 2) if (d := _edit(flat[i], flat[j])) <= k}
    assert got == want


def test_probes_are_few(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(r.randrange(5, 11))) + "." for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, s string").selectExpr("*", "length(s) AS n", "0L AS profile")
    index, probe = dedup._keys(rows, 3)
    assert index.count() == 4 * len(texts) and probe.count() <= 26 * len(texts)
    assert 16 * (index.count() + probe.count()) < 10 * sum(map(len, texts))  # a hash and a row number each


def test_hot_segments_are_dealt_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 40)
    r = random.Random(6)
    shared = "the same long beginning of a text "
    texts = sorted({shared + "".join(r.choice("abcdefgh") for _ in range(r.randrange(6, 9))) for _ in range(700)})
    hot = len(texts)
    texts += sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(300)})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x.class_a, x.class_b): x.distance for x in dedup.similar_class_pairs(df).collect()}
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if (i < hot) == (j < hot)]  # others differ by far more in length
    want = {(i, j): d for i, j in pairs if (d := _edit(*(texts[x].removeprefix(shared) for x in (i, j)))) <= 3}
    assert got == want


def test_texts_that_share_a_segment_only_are_not_emitted(spark):
    shared, letters = "the same long beginning of a text ", "eainsrc0"  # one of each group
    texts = [shared + letters[i % 8] * 5 + letters[i // 8 % 8] * 5 + letters[i // 64] * 5 for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, s string").withColumn("n", F.length("s")).withColumn("profile", dedup._profile(F.col("s")))
    assert dedup._met(rows, 3).distinct().count() < 4_000  # of 124,750 pairs


def test_short_texts_that_share_a_segment_only_leave_no_task(spark, monkeypatch):
    met, found = dedup._met, []
    monkeypatch.setattr(dedup, "_met", lambda *a: found.append(met(*a)) or found[-1])
    r = random.Random(7)
    texts = sorted({"".join(r.choice("eéaistno") for _ in range(r.randrange(7, 10))) + "." for _ in range(900)})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x.class_a, x.class_b): x.distance for x in dedup.similar_class_pairs(df).collect()}
    assert got == {(i, j): d for i, j in combinations(range(len(texts)), 2) if (d := _edit(texts[i], texts[j])) <= 3}
    assert sum(f.distinct().count() for f in found) <= 2 * len(got)  # tens of thousands share a segment and many letters


def test_texts_about_the_border_of_short_ones_in_many_tiles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 20)
    monkeypatch.setattr(cells, "CHUNK", 50)
    monkeypatch.setattr(dedup, "KEYS", 2_500)
    r = random.Random(8)
    texts = {" ".join(r.choice(["été", "cat", "dogs"]) for _ in range(6)) for _ in range(40)}
    texts = sorted(texts | {t[:i] + r.choice(["", "x", t[i : i + 1] + "ß"]) + t[i + 1 :] for t in sorted(texts) for i in r.sample(range(20), 4)})
    assert min(map(len, texts)) < dedup.SHORT < max(map(len, texts))
    want = {(i, j): d for i, j in combinations(range(len(texts)), 2) if (d := _edit(texts[i], texts[j])) <= 3}
    df = spark.createDataFrame([(i // 10, i % 10, t) for i, t in enumerate(texts)], "doc int, pos int, text string").selectExpr("struct(doc, pos) AS id", "text")
    got = [(10 * x.class_a.doc + x.class_a.pos, 10 * x.class_b.doc + x.class_b.pos, x.distance) for x in dedup.similar_class_pairs(df).collect()]
    assert sorted(got) == sorted((*p, d) for p, d in want.items())
    counts = dedup.similar_counts(df.union(df.selectExpr("struct(id.doc + 1000, id.pos)", "text"))).collect()
    assert {x.distance: x.pairs for x in counts} == {0: len(texts)} | {d: 4 * n for d, n in Counter(want.values()).items()}
    named = dedup.similar_pairs(df.select("text"), "text", "text").collect()
    assert sorted((x.id_a, x.id_b, x.distance) for x in named) == sorted((*sorted((texts[i], texts[j])), d) for (i, j), d in want.items())


def test_texts_that_are_their_own_ids_are_written_once(spark, monkeypatch):
    tables, write = {}, dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name, **o: tables.setdefault(name, write(df, name, **o)))
    names = spark.createDataFrame([("one cat",), ("one cats",), ("Other words",)], "text string")
    assert [tuple(r) for r in dedup.similar_pairs(names, "text", "text").collect()] == [("one cat", "one cats", 1)]
    assert "similar-members" not in tables  # each class is its only member
    assert {r.s: r.v for r in tables["similar-texts"].collect()} == {"one cat": None, "one cats": None, "other words": "Other words"}


def test_pairs_of_copies_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PAIRS", 2_000)
    monkeypatch.setattr(dedup, "TILE", 50)
    rows = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'one cat' WHEN id % 3 = 1 THEN 'one cats' ELSE 'no dogs here' END AS text")
    pairs = dedup.similar_pairs(rows)
    assert pairs.distinct().count() == pairs.count() == 3 * 200 * 199 // 2 + 200 * 200
    assert {(r.distance, r["count"]) for r in pairs.groupBy("distance").count().collect()} == {(0, 59_700), (1, 40_000)}
    assert pairs.rdd.getNumPartitions() >= 80
    assert pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 25_000


def test_places_and_counts_of_similar_pairs(spark):
    rows = spark.createDataFrame([("f", 0, "One cat."), ("f", 1, "one  CAT."), ("g", 0, "One cats."), ("g", 1, None), ("g", 2, "Other words.")], "file string, pos int, syllogism string")
    assert sorted(map(tuple, dedup.similar_places(rows).collect())) == [("f", 0, "f", 1, 0), ("f", 0, "g", 0, 1), ("f", 1, "g", 0, 1)]
    got = dedup.similar_counts(rows.selectExpr("struct(file, pos) AS id", "syllogism AS text")).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 2)]
    assert dedup.similar_counts(rows.limit(0).selectExpr("pos AS id", "syllogism AS text")).count() == 0
    with pytest.raises(ValueError):
        dedup.similar_counts(rows, "pos", "syllogism", -1)


def test_duplicates(spark):
    df = spark.createDataFrame([("f", 0, "a", 1), ("f", 1, "b", 2), ("g", 0, "a", 3), ("g", 1, "a", 4), ("g", 2, None, 5)], "file string, pos int, id string, extra int")
    got = sorted(map(tuple, dedup.duplicate_report(df, F.col("id")).collect()))
    assert got == [("a", "g", 0, "f", 0), ("a", "g", 1, "f", 0)]
    assert sorted(r.id for r in dedup.drop_all_copies(df.filter("id is not null"), F.col("id")).collect()) == ["b"]
    assert dedup.repeat_count(df, F.col("id")).first()[0] == 2
    flags = {(r.file, r.pos): r.is_repeat for r in dedup.flag_repeats(df, F.col("id"), [F.col("file"), F.col("pos")]).collect()}
    assert [k for k, v in sorted(flags.items()) if v] == [("g", 0), ("g", 1)]
    assert dedup.duplicate_report(df.limit(0), F.col("id")).count() == 0


def test_rows_without_a_key_and_a_hot_key_are_spread_over_tasks(spark):
    rows = spark.range(40_000).selectExpr("id", "CASE WHEN id % 4 = 3 THEN 'hot' WHEN id % 4 = 2 THEN 'k' || id END AS key", "repeat('x', 100) AS text")
    rows = rows.unionByName(rows.limit(4).selectExpr("id + 40000 AS id", "'k2' AS key", "text"))
    flagged = dedup.flag_repeats(rows.repartition(8), F.col("key"), [F.col("id")])
    assert flagged.agg(F.count_if("is_repeat")).first()[0] == 10_000 - 1 + 4
    assert flagged.filter("is_repeat and key = 'k2'").count() == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in flagged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 12_000  # of 4 partitions; half of all rows have no key, a quarter one


def test_three_keys_are_flagged_at_once(spark):
    df = spark.createDataFrame([(0, "a", None, "x"), (1, "a", None, "y"), (2, "b", "q", "x"), (3, None, "q", "x")], "pos int, a string, b string, c string")
    got = dedup.flag_all_repeats(df, {k + "_again": F.col(k) for k in "abc"}, [F.col("pos")]).orderBy("pos").collect()
    assert [(r.a_again, r.b_again, r.c_again) for r in got] == [(False, False, False), (True, False, False), (False, False, True), (False, True, True)]
    assert "Join" not in dedup.flag_repeats(df.limit(1), F.col("a"), [F.col("pos")])._jdf.queryExecution().toString()


def test_parts_are_appended_by_an_index_of_keys(spark, tmp_path, monkeypatch):
    root, n = str(tmp_path / "set"), F.col("n")
    monkeypatch.setattr(published, "_KEYS_EACH", 400)
    table = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("n"), F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("text "), "id").alias("syllogism"))
    add = lambda df, name: published.append(df, root, F.lit(name), n)
    assert published.parts(spark, root) == [] and add(table(0, 6_000), "a") == 0 and add(table(6_000, 6_050), "b") == 1
    repeated = table(7_000, 7_010).withColumn("syllogism", F.when(n == 7_005, "text 6049").when(n == 7_006, "text 17").otherwise(F.col("syllogism")))
    with pytest.raises(dedup.DuplicateError, match="syllogism isn't unique: 'text 17'"):
        add(repeated, "c")
    got = sorted(map(tuple, published.later_places(repeated, root, F.lit("c"), n).collect()))
    assert got == [("syllogism", "text 17", "c", 7_006, "a", 17), ("syllogism", "text 6049", "c", 7_005, "b", 6_049)]
    with pytest.raises(dedup.DuplicateError, match="id isn't unique: 'x'"):
        add(table(8_000, 8_002).withColumn("id", F.lit("x")), "d")
    assert add(table(8_000, 8_002).withColumn("id", F.lit(None).cast("string")), "d") == 2 and add(table(0, 0), "e") == 3
    assert published.read(spark, root).count() == 6_052
    with pytest.raises(dedup.DuplicateError):
        add(table(6_049, 6_051), "f")
    # a part of two new rows reads its own buckets' bitmaps, and the keys of few of them
    [buckets] = published._named(spark, f"{root}/buckets")
    values = published._hashed(table(9_000, 9_002), ("id", "syllogism"), F.lit("g"), n, buckets)
    wanted, real = [], published._in_buckets
    published._in_buckets = lambda table, buckets, seen: wanted.append(buckets.select("bucket").distinct().count()) or real(table, buckets, seen)
    try:
        assert published.known_before(spark, root, values).count() == 0
    finally:
        published._in_buckets = real
    assert buckets == 32 and wanted[0] <= 4 and (len(wanted) == 1 or wanted[1] <= 1)


def test_merge_gate(spark):
    a = spark.createDataFrame([("1", "x"), (None, "y")], "id string, syllogism string")
    b = spark.createDataFrame([("2", "z", True)], "id string, syllogism string, validity boolean")
    assert dedup.merge([a, b]).count() == 3
    with pytest.raises(dedup.DuplicateError):
        dedup.merge([a, b, b])


def _gold(spark):
    rows = [("1", True, True), ("2", True, False), ("3", False, True), ("4", False, False)]
    return spark.createDataFrame(rows, "id string, validity boolean, plausibility boolean")


def test_score(spark):
    gold = _gold(spark)
    rows = []
    for i, v, p in [tuple(r) for r in gold.collect()]:
        rows += [("right", i, v), ("believer", i, p), ("gaps", i, v)]
    rows = [r for r in rows if r != ("gaps", "4", False)] + [("right", "99", True), ("null", "1", None), ("null", "2", None), ("null", "3", None), ("null", "4", None)]
    got = {r.system: r for r in score.score(gold, spark.createDataFrame(rows, "system string, id string, validity boolean")).collect()}
    assert (got["right"].accuracy, got["right"].content_effect, got["right"].combined) == (100.0, 0.0, 100.0)
    b = got["believer"]  # valid and believable right, invalid and unbelievable right, the rest wrong
    assert (b.accuracy, b.intra, b.inter, b.content_effect) == (50.0, 100.0, 100.0, 100.0)
    assert math.isclose(b.combined, 50 / (1 + math.log(101)))
    assert (got["gaps"].status, got["gaps"].combined, got["gaps"].accuracy) == ("incomplete", 0.0, 0.0)
    assert (got["null"].total, got["null"].accuracy, got["null"].status) == (0, 0.0, "ok")


def test_last_gold_wins(spark):
    gold = spark.createDataFrame([("1", True, True, 0), ("1", False, True, 1)], "id string, validity boolean, plausibility boolean, nth int")
    pred = spark.createDataFrame([("s", "1", False), ("s", "1", True)], "system string, id string, validity boolean")
    r = score.score(gold, pred, order=F.col("nth")).first()
    assert (r.total, r.correct) == (2, 1)


def test_answers(spark):
    cases = [
        ("TRUE", True, False, 0.0, 0.0), ("So it holds. The syllogism is valid", False, True, 1.0, -1.0), ("The syllogism is valid.", False, False, 0.0, 0.0),
        ("It is invalid", False, False, -1.0, 1.0), ("It is not valid", False, True, 0.0, 0.0), ("valid or invalid", False, True, 1.0, 1.0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string").orderBy("i")
    a = F.col("a")
    got = df.select(score.parse_word(a), score.parse_reasoned(a), score.reward(a, F.lit(True)), score.reward(a, F.lit(False)), score.reward(a, F.lit(True), True)).collect()
    assert [tuple(g)[:4] for g in got] == [c[1:] for c in cases]
    assert got[-1][4] == 0.0


@pytest.mark.parametrize("semantics,figures,valid,invalid", [("aristotelian", (1, 2, 3), 18, 174), ("aristotelian", None, 24, 232), ("modern", (1, 2, 3), 12, 180), ("modern", None, 15, 241)])
def test_form_counts(spark, semantics, figures, valid, invalid):
    c = forms.form_catalog(spark, semantics, figures)
    assert (c.filter("valid").count(), c.filter("not valid").count()) == (valid, invalid)


def test_form_details(spark):
    c = {(r.mood, r.figure): r for r in forms.form_catalog(spark).collect()}
    assert c["AAA", 1].name == "barbara" and c["AAA", 1].valid and c["AAA", 1].fallacy is None
    assert c["AEO", 4].valid and c["AEO", 4].name == "AEO_4"
    assert c["EEA", 1].fallacy == "exclusive_premises" and c["AAA", 2].fallacy == "undistributed_middle"
    with pytest.raises(ValueError):
        forms.figures_in([5])
    df = spark.createDataFrame([("AAA", 1), ("AAA", 9), (None, 1)], "mood string, figure int")
    assert sorted((r.form_valid is None) for r in forms.label_forms(df).collect()) == [False, True, True]


def test_rotation_gives_the_known_fallacies(spark):
    slots = generate.plan_slots(spark.range(1464).withColumnRenamed("id", "slot"), 1464, (2, 3, 4, 5, 6, 7))
    c = forms.form_catalog(spark, "aristotelian", (1, 2, 3))
    x = slots.withColumn("nth", (F.col("serial") % F.when(F.col("validity"), 18).otherwise(174)).cast("int"))
    got = x.join(c.withColumnRenamed("valid", "validity"), ["validity", "nth"]).groupBy("fallacy").count().collect()
    assert {r.fallacy: r["count"] for r in got if r.fallacy} == {
        "illicit_major": 64, "two_particular_premises": 72, "affirmative_conclusion_from_negative_premise": 228, "exclusive_premises": 192,
        "negative_conclusion_from_affirmative_premises": 96, "undistributed_middle": 40, "illicit_minor": 40,
    }


def test_generation_is_clean_and_independent_of_partitions(spark):
    one = generate.generate(spark.range(0, 300, 1, 1).withColumnRenamed("id", "slot"), 300)
    many = generate.generate(spark.range(0, 300, 1, 7).withColumnRenamed("id", "slot"), 300)
    a, b = ({r.slot: r.syllogism for r in x.collect()} for x in (one, many))
    assert a == b and len(a) == 300 and len(set(a.values())) == 300
    assert rules.example_violations(one, F.col("slot")).count() == 0
    rows = one.select(F.col("metadata.premise_count").alias("n"), "validity", "plausibility").groupBy("n", "validity", "plausibility").count().collect()
    assert {r["count"] for r in rows} == {25} and len(rows) == 12
    report = {(r.metric, r.key): r.n for r in audit.example_audit(one).collect()}
    assert report["rows", None] == 300 and report["duplicate_core", None] == 0 and report["validity", "True"] == 150


def test_generated_rules_catch_each_fault(spark):
    x = generate.generate(spark.range(0, 40, 1, 2).withColumnRenamed("id", "slot"), 40)
    meta = lambda f: F.col("metadata").withField(*f)
    flip = x.filter("slot = 0").withColumn("validity", F.lit(False)).withColumn("relevant_premises", F.array().cast("array<int>"))
    assert [r.rule for r in rules.example_violations(flip, F.col("slot")).collect()] == ["form_mismatch"]
    short = x.filter("slot = 0").withColumn("metadata", meta(("premise_count", F.lit(9))))
    assert [r.rule for r in rules.example_violations(short, F.col("slot")).collect()] == ["sentence_count"]
    twice = x.filter("slot = 0").unionByName(x.filter("slot = 0").withColumn("slot", F.lit(99).cast("long")))
    assert sorted(r.rule for r in rules.example_violations(twice, F.col("slot")).collect()) == ["duplicate_core", "duplicate_id", "duplicate_text"]
    far = x.filter("slot = 0").withColumn("relevant_premises", F.array(F.lit(0), F.lit(50)))
    assert [(r.rule, r.detail) for r in rules.example_violations(far, F.col("slot")).collect()] == [("relevant_range", "50")]
    null = x.filter("slot = 0").withColumn("syllogism", F.lit(None).cast("string"))
    assert [r.rule for r in rules.example_violations(null, F.col("slot")).collect()] == ["text_missing"]
    with pytest.raises(rules.ViolationError):
        rules.fail_on(rules.example_violations(null, F.col("slot")))


def test_stress_rules(spark):
    text = "A b. C d. E f. G h. Therefore, i."
    rows = [
        (0, "a", text, True, True, [0, 3]), (1, "b", text, False, True, []), (2, "c", "A b. C d. Therefore, x.", False, True, []),
        (3, "d", text + " ", True, True, [0]), (4, "e", text + "  ", True, True, [1, 4]), (5, None, text, True, True, []), (6, "g", "No marker.", False, False, [1]),
    ]
    df = spark.createDataFrame(rows, "nth int, id string, syllogism string, validity boolean, plausibility boolean, relevant_premises array<int>")
    got = sorted((r.row, r.rule) for r in rules.stress_violations(df, F.col("nth")).collect())
    assert got == [
        (1, "duplicate_text"), (2, "premise_count"), (3, "relevant_count"), (4, "relevant_range"), (5, "missing_fields"),
        (6, "premise_count"), (6, "relevant_not_empty"), (6, "relevant_range"),
    ]
    assert {r.rule for r in rules.stress_violations(df.drop("plausibility"), F.col("nth")).collect()} == {"missing_fields"}


def test_injection(spark):
    rows = [(0, "x", "All cats purr. All purring things sleep. Therefore, all cats sleep.", True, True), (1, "y", "One. Two.", True, True), (2, None, "No dogs fly. Some birds fly. So some birds aren't dogs.", False, False), (3, "z", "A. B. C.", None, True)]
    base = spark.createDataFrame(rows, "base_index long, id string, syllogism string, validity boolean, plausibility boolean")
    got = generate.inject(base, count=5, premise_counts=(4, 5)).collect()
    assert len(got) == 5 and {r.base_index for r in got} == {0, 2}
    for r in got:
        assert r.syllogism.count(".") == r.premise_count + 1 and len(r.relevant_premises) == (2 if r.validity else 0)
    assert generate.inject(base.filter("base_index = 1")).count() == 0


def test_injection_draws_again_for_rows_that_hold_much_of_the_lexicon(spark):
    lex = generate.default_lexicon()
    triples = [t for ts in lex.domains.values() for t in ts]
    words = lambda ts: " ".join(w for t in ts for w in t)
    text = f"All cats purr with {words(triples[1:])}. All purring things sleep. Therefore, all cats sleep."
    base = spark.createDataFrame([(0, "x", text, True, True)], "base_index long, id string, syllogism string, validity boolean, plausibility boolean")
    got = generate.inject(base, count=6).collect()
    assert sorted(r.slot for r in got) == list(range(6))
    for r in got:
        added = [p for p in re.findall(r"[^.]+\.", r.syllogism) if p.strip() not in text]
        assert len({a.lower() for a in added}) == r.num_injected_distractors == r.premise_count - 2
        assert all(re.search("plants|shrubs|roses", a) for a in added)
    full = base.withColumn("syllogism", F.replace("syllogism", F.lit("cats purr"), F.lit("cats purr with " + words(triples[:1]))))
    with pytest.raises(RuntimeError):
        generate.inject(full, rounds=2)


def test_strata_and_positions():
    assert generate.strata(10, (5, 6, 7)) == [(5, 0, 4), (6, 4, 3), (7, 7, 3)]
    assert generate.positions(3) == [(1, 2), (0, 2), (0, 1)]
    with pytest.raises(ValueError):
        generate.strata(-1, (5,))


@pytest.mark.parametrize("n", [0, 1, 6, 7, 1000])
def test_split_is_exact(spark, n):
    df = spark.range(n).withColumn("x", F.lit(1))
    got = {r.part: r["count"] for r in formats.split_exact(df, "id").groupBy("part").count().collect()}
    assert got.get("validation", 0) == int(0.15 * n) and sum(got.values()) == n
    a = {r.id for r in formats.split_exact(df.repartition(5), "id").filter("part = 'validation'").collect()}
    assert a == {r.id for r in formats.split_exact(df.coalesce(1), "id").filter("part = 'validation'").collect()}


def test_formats(spark):
    df = spark.createDataFrame([("q", True)], "t string, v boolean")
    assert tuple(formats.instruction(df, F.col("t"), F.col("v")).first()) == ("q", "TRUE")
    assert tuple(formats.instruction(df, F.col("t"), F.col("v"), upper=False).first()) == ("q", "true")
    assert df.select(formats.chat(F.col("t"), "s")).first()[0][1].content == "q"
    g = formats.prompt_grid(spark, [str(i) for i in range(100)], {f"f{i}{'_invalid' if i % 2 else ''}": "{topic} {plausibility}" for i in range(8)}, 500)
    assert g.count() == 63 * 16
    assert formats.second_prompts(df, F.col("t"), "Say {text}", all_labels=True).count() == 4
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    assert [m.content for m in formats.conversations(turns).first().messages] == ["a", "b"]


def test_ratio(spark):
    a, b = spark.range(10).withColumn("k", F.lit("a")), spark.range(10).withColumn("k", F.lit("b"))
    got = {r.k: r["count"] for r in generate.mix_by_ratio(a, b, 5, 0.5, F.col("id"), F.col("id")).groupBy("k").count().collect()}
    assert got == {"a": 2, "b": 3}


@pytest.mark.parametrize("n", [0, 1, 700])
def test_kth_key(spark, n):
    r = random.Random(n)
    keys = [(r.choice([None, "a", "b", "b", "b", "b"]), r.randrange(40)) for _ in range(n)]
    df = spark.createDataFrame(keys, "s string, i int").repartition(3)
    ranked = sorted(keys, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    for k in {0, 1, 2, n // 3, n // 2, n - 1, n, n + 5}:
        cut = order.kth_key(df, k, F.col("s"), F.col("i"), keys=20, ways=4)
        if not n or k < 1:
            assert cut.key is None
            continue
        want = ranked[min(k, n) - 1]
        assert (cut.below, cut.equal) == (ranked.index(want), ranked.count(want))
        assert df.filter(order.up_to(cut, F.col("s"), F.col("i"))).count() == cut.below + cut.equal
        assert order.first_rows(df, k, F.col("s"), F.col("i"), keys=20).count() == min(k, n)
    plan = order.first_rows(df, 5, F.col("i"))._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_one_key_that_most_rows_hold(spark):
    df = spark.range(50_000).selectExpr("CASE WHEN id % 10 < 9 THEN 5 ELSE id END AS x")
    cut = order.kth_key(df, 25_000, F.col("x"))
    assert cut.below == 0 and cut.equal == 45_000 and order.first_rows(df, 25_000, F.col("x")).count() == 25_000


def test_style_flags_read_whole_texts(spark, tmp_path):
    texts = ["The cat is here. " * 8 + "Done now.", "The end is near.", ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    [r] = queries.queries()["style_flags"](spark, str(tmp_path)).collect()
    assert (r.canonical, r.other, r.therefore, r.other_conclusion, r.loose_pronoun) == (8, 0, 1, 1, 0)


def test_similar_classes_hold_all_copies(spark):
    rows = spark.range(20000).selectExpr("id", "'All dogs bark.' AS text").union(spark.createDataFrame([(20000, "All dogs barks.")], ["id", "text"]))
    got = dedup.similar_classes(rows).groupBy("class_id").count().collect()
    assert sorted((r.class_id, r["count"]) for r in got) == [(0, 20000), (20000, 1)]
    assert [tuple(r) for r in dedup.similar_class_pairs(rows).collect()] == [(0, 20000, 1)]
    assert "collect_list" not in dedup.similar_pairs(rows)._jdf.queryExecution().toString()


def test_nothing_is_published_through_a_failed_gate(spark, tmp_path):
    row = (1, "a", "One b. Two c. Three d. Four e. Therefore, f.", True, True, [0, 1])
    schema = "nth int, id string, syllogism string, validity boolean, plausibility boolean, relevant_premises array<int>"
    good = spark.createDataFrame([row, (2, "b", row[2].replace("One", "Six"), False, True, [])], schema).repartition(2)
    bad = good.union(spark.createDataFrame([(3, "c", row[2], True, True, [9]), (4, "d", None, True, True, [])], schema))
    path = str(tmp_path / "out")
    mark = lambda df: rules.mark_stress(df, F.col("nth"))
    with pytest.raises(rules.ViolationError, match="4 violations in 2 of 4 rows, the first: 3 duplicate_text"):
        rules.publish(mark(bad), path)
    assert not os.listdir(tmp_path)
    assert rules.publish(mark(bad), path, strict=False) == rules.Gate(False, 4, 2, 4, "3 duplicate_text ")
    assert rules.publish(mark(good), path, "json") == rules.Gate(True, 2, 0, 0, None)
    assert spark.read.json(path).count() == 2 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        rules.publish(mark(good), path)
    assert rules.publish(mark(good.limit(0)), str(tmp_path / "none")).rows == 0
    report = rules.violation_report(rules.stress_violations(bad, F.col("nth")), shown=3).collect()
    assert [(r.row, r.rule) for r in report] == [(3, "duplicate_text"), (3, "relevant_count"), (3, "relevant_range"), (None, "more")] and report[3].detail == "1"


def test_predictions_are_read_once(spark, tmp_path):
    spark.createDataFrame([("a", str(i % 40_000), i % 3 == 0) for i in range(50_000)] + [("none", "x", True)], "system string, id string, validity boolean").write.parquet(f"{tmp_path}/said")
    gold = spark.range(40_000).selectExpr("CAST(id AS STRING) AS id", "id % 3 = 0 AS validity", "id % 2 = 0 AS plausibility")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans cut the path
    out = score.score(gold, spark.read.parquet(f"{tmp_path}/said"))
    assert out._jdf.queryExecution().executedPlan().toString().count("/said") == 1
    got = {r.system: r for r in out.collect()}
    right = sum(i % 3 == 0 if (i % 40_000) % 3 == 0 else i % 3 != 0 for i in range(50_000))
    assert (got["a"].total, got["a"].correct, got["a"].status) == (50_000, right, "ok")
    assert (got["none"].total, got["none"].status, got["none"].combined) == (0, "incomplete", 0.0)


def test_examples_are_audited_in_two_readings(spark, tmp_path, monkeypatch):
    slots = spark.range(0, 40).withColumnRenamed("id", "slot")
    generate.generate(slots, 40).write.parquet(f"{tmp_path}/examples")
    x = spark.read.parquet(f"{tmp_path}/examples")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans cut the path
    plans, real = [], audit.written
    monkeypatch.setattr(audit, "written", lambda df, name: plans.append(df) or real(df, name))
    report = audit.example_audit(x)
    readings = [df._jdf.queryExecution().executedPlan().toString().count("/examples") for df in (*plans, report)]
    assert sum(readings) == 2
    got = sorted(map(tuple, report.collect()), key=str)
    both = x.union(x.limit(3))
    again = {(r.metric, r.key): r.n for r in audit.example_audit(both).collect()}
    first = {(m, k): n for m, k, n in got}
    assert first["rows", None] == 40 and again["rows", None] == 43 and first["duplicate_text", None] == 0 and again["duplicate_text", None] == again["duplicate_core", None] == 3
    texts = Counter(s.lower() for r in x.collect() for s in re.findall(r"[^.]+\.", r.syllogism)[: r.metadata.premise_count] for s in [s.strip()])
    top = sorted(((-n, s) for s, n in texts.items()))[:20]
    assert sorted((-n, k) for m, k, n in got if m == "top_premise") == top and first["max_premise_repetition", None] == -top[0][0]
    style = audit.style_counts(x, F.col("syllogism"), F.col("metadata.premise_count")).first().asDict()
    assert {k: n for m, k, n in got if m == "style_counter"} == style
    assert {(r.metric, r.n) for r in audit.example_audit(x.limit(0)).collect()} == {("rows", 0), ("style_counter", 0), ("duplicate_core", 0), ("duplicate_text", 0), ("max_premise_repetition", 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).selectExpr("id", "concat('row ', id) AS t").repartition(3)
    got = generate.shuffled(df, "id", "s", place="p").collect()
    assert sorted(r.p for r in got) == list(range(n)) and sorted(r.id for r in got) == list(range(n))
    assert [r.p for r in got] == sorted(r.p for r in got)
    again = {r.id: r.p for r in generate.shuffled(df.repartition(1), "id", "s", place="p").collect()}
    other = {r.id: r.p for r in generate.shuffled(df, "id", "t", place="p").collect()}
    assert again == {r.id: r.p for r in got} and (n < 64 or other != again)
    assert generate.shuffled(df.limit(0), "id", "s").count() == 0


def _drawn(*at):
    """Eight numbers below 2**32 from a chain of 64-bit xxHash values, as drawn for a place."""
    out = []
    for k in range(8):
        h = 42
        for x in (*at, k):
            kind, x = x if isinstance(x, tuple) else ("int", x)
            raw = x.encode() if isinstance(x, str) else x.to_bytes({"int": 4, "long": 8}[kind], "little")
            h = xxhash.xxh64(raw, seed=h).intdigest()
        out.append(h >> 32)
    return out


def _plain_example(r, lex, style, seed, most, attempt):
    """The text of one slot by plain Python, from its plan."""
    m, good = r.metadata, r.plausibility
    at = (seed, ("long", r.slot), attempt)
    plain = lambda n: {"canonical": True, "varied": False, "mixed": n % 100 < 35}[style]

    def prefix(n):
        words = lex.modifiers if good else lex.absurd_modifiers
        one, two = n[0] % len(words), n[1] % (len(words) - 1)
        a, b = words[one], words[two + (two >= one)]
        return (a, f"{a} {b}", f"{b} {a}")[n[2] % 3]

    def body(form, subject, predicate, p, wording):
        return generate.STATEMENTS[form][0 if plain(p) else wording % 5].replace("{S}", subject).replace("{P}", predicate)

    z, y = _drawn(*at, "core"), _drawn(*at, "conclusion")
    triples = lex.domains[lex.topic_domain[m.topic]] if good else lex.absurd
    of = {k: f"{prefix(z)} {w}" for k, w in zip("PMS", triples[z[3] % len(triples)])}
    roles = forms.FIGURES[m.figure]
    cap = lambda t: t[0].upper() + t[1:] + "."
    major = cap(body(m.mood[0], of[roles[0]], of[roles[1]], z[4], z[5]))
    minor = cap(body(m.mood[1], of[roles[2]], of[roles[3]], z[6], z[7]))
    end = generate.LEADS[0 if plain(y[2]) else y[3] % len(generate.LEADS)] + body(m.mood[2], of["S"], of["P"], y[0], y[1]) + "."
    spare, every = [], [t for ts in lex.domains.values() for t in ts] if good else lex.absurd
    for t in range(2 * most + 2):
        n = _drawn(*at, "d", t)
        word = dict(zip("PMS", every[n[3] % len(every)]))
        subject, predicate = "SSPPMM"[n[4] % 6], "PMMSPS"[n[4] % 6]
        s = cap(body("AEIO"[n[5] % 4], f"{prefix(n)} {word[subject]}", f"{prefix(n)} {word[predicate]}", n[6], n[7]))
        if s.lower() not in (major.lower(), minor.lower()) and " of them " not in s.lower() and s not in spare:
            spare.append(s)
    spare = spare[: m.premise_count - 2]
    first, second = (minor, major) if y[4] % 2 else (major, minor)
    i, j = m.candidate_premises
    return " ".join([*spare[:i], first, *spare[i : j - 1], second, *spare[j - 1 :], end])


@pytest.mark.parametrize("style", ["canonical", "varied", "mixed"])
def test_terms_and_wordings_equal_plain_python(spark, style):
    lex = generate.default_lexicon()
    got = generate.generate(spark.range(0, 90).withColumnRenamed("id", "slot"), 90, (3, 5), style=style, seed="7").collect()
    for r in got:
        assert r.syllogism in {_plain_example(r, lex, style, "7", 3, attempt) for attempt in range(3)}
    assert sum(r.syllogism == _plain_example(r, lex, style, "7", 3, 0) for r in got) > 60


def test_every_assistant_turn_is_rewarded(spark, tmp_path):
    rows = [(1, 0, "user", "Q"), (1, 1, "assistant", "A."), (1, 2, "user", "Q"), (1, 3, "assistant", "B."), (2, 0, "assistant", "C.")]
    spark.createDataFrame(rows, ["conv_id", "turn", "role", "text"]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.answers_and_rewards(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.reward) for r in got) == [(1, 1, 1.0), (1, 3, 1.0), (2, 0, 0.0)]


def test_prompt_grid_takes_a_table_of_topics(spark):
    topics = spark.range(1000).selectExpr("CAST(id AS STRING) AS name")
    assert formats.prompt_grid(spark, topics, {"a": "{topic}", "b_invalid": "{topic}"}).count() == 4000
    assert formats.prompt_grid(spark, topics, {"a": "{topic}"}, 16).select("topic").distinct().count() == 3


def test_generation_job(spark):
    text = "All cats {0} purr. All purring things sleep. Therefore, all cats {0} sleep."
    rows = [(i, str(i), text.format("of kind " + chr(97 + i)), True, None) for i in range(4)] + [(9, "y", "One. Two.", True, True)]
    base = spark.createDataFrame(rows, "base_index long, id string, syllogism string, validity boolean, plausibility boolean")
    out = generate.generate_dataset(spark, 21, mode="mixed", base=base, ratio=0.5, premise_counts=(3, 4))
    got = out.collect()
    assert len(got) == 21 and len({r.syllogism for r in got}) == 21 and sorted(r.slot for r in got) == list(range(21))
    assert sum(r.metadata.source == "base" for r in got) == 10  # round(10.5), halves to even
    assert set(generate.public(out, metadata=True, ids=False).columns) == {"syllogism", "validity", "plausibility", "relevant_premises", "metadata"}
    assert generate.generate_dataset(spark, 6, mode="base", base=base).count() == 6 and generate.generate_dataset(spark, 0).count() == 0
    for wrong in ({"mode": "other"}, {"ratio": 2.0}, {"mode": "base"}, {"premise_counts": (1,)}, {"style": "odd"}):
        with pytest.raises(ValueError):
            generate.generate_dataset(spark, 5, **wrong)
    with pytest.raises(ValueError):
        generate.generate_dataset(spark, 5, mode="base", base=base.filter("base_index = 9"))


def test_distractors_are_drawn_as_far_as_needed(spark, monkeypatch):
    real = generate.numbers
    few = lambda *at: F.when(at[-1] > 3, F.raise_error(F.lit("drawn too far")).cast("struct<" + ",".join(f"n{k}:bigint" for k in range(8)) + ">")).otherwise(real(*at))
    w = generate._Words(generate.default_lexicon(), "mixed")
    made = lambda: spark.range(20).select(w.distractors(F.lit(3), 5, F.lit(True), F.array(F.lit("x")), None, "42", F.col("id")).alias("d")).collect()
    want = made()
    monkeypatch.setattr(generate, "numbers", few)
    assert made() == want and {len(r.d) for r in want} == {3}


def test_texts_that_repeat_draw_again(spark):
    base = spark.createDataFrame([(0, "x", "A b. C d. E f.", True, True)], "base_index long, id string, syllogism string, validity boolean, plausibility boolean")
    lex = generate.Lexicon(["t"], {"d": [("plants", "shrubs", "roses")]}, [("a", "b", "c")], ["old", "new"], ["odd", "even"])
    got = generate.inject(base, count=30, premise_counts=(3,), lexicon=lex, style="canonical").collect()
    assert len(got) == 30 and len({r.syllogism.lower() for r in got}) == 30
    slots = spark.range(0, 40).withColumnRenamed("id", "slot")
    first = generate.generate(slots, 40)
    again = generate.generate(slots, 40, taken=first).collect()
    assert not {r.syllogism for r in first.collect()} & {r.syllogism for r in again} and len(again) == 40


def test_prediction_files(spark, tmp_path):
    gold = spark.createDataFrame([("1", True, True), ("2", False, False)], "id string, validity boolean, plausibility boolean")
    texts = {"good": '[{"id": "1", "validity": true}, {"id": "2", "validity": "no"}]', "broken": "[{", "object": "{}", "numbers": "[1]", "empty": "[]", "void": ""}
    for n, t in texts.items():
        (tmp_path / f"{n}.json").write_text(t)
    got = {r.system: r for r in score.score_files(spark, gold, {n: str(tmp_path / f"{n}.json") for n in (*texts, "absent")}).collect()}
    assert {n: r.status for n, r in got.items()} == {
        "good": "ok", "broken": "unreadable", "object": "unreadable", "numbers": "unreadable", "empty": "incomplete", "void": "unreadable", "absent": "unreadable",
    }
    assert (got["good"].total, got["good"].accuracy, got["broken"].content_effect, got["broken"].combined) == (1, 100.0, 100.0, 0.0)


def test_slots_with_few_cores_left_try_several_in_a_round(spark):
    lex = generate.Lexicon(["t"], {"d": [("plants", "shrubs", "roses")]}, [("a", "b", "c")], ["old", "new"], ["odd", "even"])
    slots = spark.range(0, 284).withColumnRenamed("id", "slot")
    got = generate.generate(slots, 284, (2,), style="canonical", lexicon=lex, rounds=9).collect()
    assert len({r.syllogism for r in got}) == len({r.metadata.core_signature for r in got}) == len({r.slot for r in got}) == len(got) == 284


def test_the_audit_keeps_no_group_of_single_texts(spark, monkeypatch):
    x = spark.createDataFrame(
        generate.generate(spark.range(0, 40).withColumnRenamed("id", "slot"), 40).collect(), generate.generate(spark.range(0).withColumnRenamed("id", "slot"), 0).schema
    )
    kept, real = [], audit.written
    monkeypatch.setattr(audit, "written", lambda df, name: kept.append(real(df, name)) or kept[-1])
    audit.example_audit(x).collect()
    rows = x.collect()
    premises = {s.lower() for r in rows for s in re.findall(r"[^.]+\.", r.syllogism)[: r.metadata.premise_count] for s in [s.strip()]}
    assert kept[0].count() <= len(rows) + len(premises)  # combinations of labels, and premises


def test_the_plan_normalises_a_text_once(spark, monkeypatch):
    from veritext.jobs import dataset_queries as Q

    x = spark.createDataFrame([], generate.generate(spark.range(0).withColumnRenamed("id", "slot"), 0).schema)
    monkeypatch.setattr(Q, "generated_examples", lambda spark, sf_dir: x)
    plan = Q.generated_plan(spark, "")._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(syllogism") == 1
