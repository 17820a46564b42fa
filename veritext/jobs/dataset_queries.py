"""Queries of sources and sinks, forms and generation over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.functions.shared import shared_path
from veritext.jobs.queries import SCORE_COLUMNS, SCORE_SQL, query, sentences_sql, table
from veritext.operators import audit, formats, forms, generate, rules, score
from veritext.sources import readers

# --- sources and sinks: files are written from the tables and read back ------------------------------------------------


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON-array files and back, by the type that each field has there."""
    path = shared_path(spark, "arrays")
    readers.write_arrays(table(spark, sf_dir, "documents"), path, F.col("doc_id"))
    items = readers.read_arrays(spark, path)
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return items.select(*[readers.field(F.col("v"), c, k).alias(c) for c, k in kinds.items()])


@query("SELECT doc_id, text, lang FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array files turned into JSON lines, which split, and read with a stated schema."""
    arrays, lines, schema = shared_path(spark, "arrays"), shared_path(spark, "lines"), "doc_id long, text string, lang string"
    readers.write_arrays(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), arrays, F.col("doc_id"))
    readers.to_lines(spark, arrays, lines, schema)
    return spark.read.schema(schema).json(lines)


@query("SELECT doc_id, text, lang FROM documents")
def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even and of odd ids as two sets of array files, read as one."""
    d, paths = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), []
    for k in (0, 1):
        paths.append(shared_path(spark, "training"))
        readers.write_arrays(d.filter(F.col("doc_id") % 2 == k), paths[k], F.col("doc_id"))
    return readers.read_training(spark, paths, "doc_id long, text string, lang string")


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS lang FROM documents")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through CSV to JSON records; null and the empty text stay apart."""
    i, path = F.col("doc_id"), shared_path(spark, "records")
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(i % 9 != 0, F.col("text")).alias("text"), F.when(i % 7 == 0, "").otherwise(F.col("lang")).alias("lang"))
    readers.csv_to_lines(d, shared_path(spark, "csv"), path)
    return spark.read.schema(d.schema).json(path)


def _loose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as loose JSON lines: booleans, numbers and words, lists and texts, keys that are null or absent."""
    i, q = F.col("doc_id"), F.col("quality")
    word = F.when(q == 1, " Valid ").otherwise("NO")
    validity = F.when(i % 4 == 0, (q == 1).cast("string")).when(i % 4 == 1, q.cast("string")).when(i % 4 == 2, F.concat(F.lit('"'), word, F.lit('"'))).otherwise("null")
    plaus = F.when(i % 5 == 0, "").when(i % 5 == 1, ',"plausibility":null').otherwise(F.concat(F.lit(',"plausibility":'), (F.col("toxic") == 0).cast("string")))
    a, b = (i % 6).cast("string"), (i % 3).cast("string")
    pair = F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    rel = (
        F.when(i % 3 == 0, F.concat(F.lit(',"relevant_premises":'), pair))
        .when(i % 3 == 1, F.concat(F.lit(',"relevant_premises":"premises '), a, F.lit(" and "), b, F.lit('"')))
        .otherwise(F.concat(F.lit(',"relevant":'), pair))
    )
    syllogism = F.when(i % 11 != 0, F.concat(F.lit(',"syllogism":"text '), i.cast("string"), F.lit('"'))).otherwise(',"syllogism":17')
    line = F.concat(F.lit('{"id":"'), i.cast("string"), F.lit('","validity":'), validity, plaus, rel, syllogism, F.lit("}"))
    path = shared_path(spark, "loose") + ".jsonl"
    table(spark, sf_dir, "labels").select(line.alias("value")).write.text(path)
    return readers.read_container(spark, path)


@query(
    """
SELECT doc_id::VARCHAR AS id,
  CASE WHEN doc_id % 4 = 3 THEN NULL WHEN quality = 1 THEN 'true' ELSE 'false' END AS validity,
  CASE doc_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN NULL ELSE (toxic = 0)::VARCHAR END AS plausibility,
  concat(doc_id % 6, ',', doc_id % 3) AS relevant
FROM labels
"""
)
def loose_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _loose_lines(spark, sf_dir).select(
        readers.field(v, "id", "string").alias("id"), readers.loose_label(v, "validity").alias("validity"),
        readers.loose_label(v, "plausibility", "MISSING").alias("plausibility"), T.list_text(readers.loose_indexes(v)).alias("relevant"),
    )


@query("SELECT doc_id::VARCHAR AS id, 'text ' || doc_id AS syllogism, quality = 1 AS validity FROM labels WHERE doc_id % 4 = 0 AND doc_id % 11 <> 0")
def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the loose lines those with a text and a boolean validity."""
    return readers.base_rows(_loose_lines(spark, sf_dir)).select("id", "syllogism", "validity")


@query("SELECT doc_id, replace(text, chr(65533), '') || '(' AS text FROM documents")
def valid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes, a broken character put behind each, and cleaned."""
    raw = F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xc3(")))
    return table(spark, sf_dir, "documents").select("doc_id", T.valid_text(raw).alias("text"))


# --- text expressions -----------------------------------------------------------------------------------------------------


@query(
    rf"""
WITH d AS (SELECT doc_id, {sentences_sql('text')} AS p FROM documents),
t AS (SELECT doc_id, p, array_to_string(list_transform(p, lambda s, i: CASE WHEN i % 3 = 0 THEN 'Premise ' ELSE '' END || i || CASE WHEN i % 2 = 0 THEN ') ' ELSE '. ' END || s), chr(10)) AS t FROM d)
SELECT doc_id, nullif(CASE WHEN doc_id % 2 = 0 THEN len(p) ELSE len(regexp_extract_all(t, '(?im)^\s*(?:premise\s*)?\d+\s*[.:)\-]')) END, 0)::INTEGER AS premises FROM t
"""
)
def premise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from a list of sentences for even ids, from a text with numbered lines for odd ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("p"))
    number = lambda s, i: F.concat(F.when((i + 1) % 3 == 0, "Premise ").otherwise(""), (i + 1).cast("string"), F.when((i + 1) % 2 == 0, ") ").otherwise(". "), s)
    d = d.withColumn("t", F.array_join(F.transform("p", number), "\n"))
    return d.select("doc_id", T.premise_count(F.when(F.col("doc_id") % 2 == 0, F.col("p")), F.col("t")).alias("premises"))


_PART_TEXT = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'All ' WHEN 1 THEN 'Some ' ELSE 'Most ' END || p_name || ' are ' || CASE WHEN p_partkey % 2 = 0 THEN 'not ' ELSE '' END || p_brand || '. '
  || CASE WHEN p_partkey % 7 = 0 THEN 'Few of them' ELSE 'Few of these' END || ' are ' || p_type || '. ' || CASE WHEN p_partkey % 5 = 0 THEN 'So, ' ELSE 'Therefore, ' END || 'no ' || p_name || ' are ' || p_type || '.' AS t
FROM part
"""


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sentences on each part, plain and not, marked and not."""
    i = F.col("p_partkey")
    t = F.concat(
        F.when(i % 3 == 0, "All ").when(i % 3 == 1, "Some ").otherwise("Most "), "p_name", F.lit(" are "), F.when(i % 2 == 0, "not ").otherwise(""), "p_brand", F.lit(". "),
        F.when(i % 7 == 0, "Few of them").otherwise("Few of these"), F.lit(" are "), "p_type", F.lit(". "), F.when(i % 5 == 0, "So, ").otherwise("Therefore, "),
        F.lit("no "), "p_name", F.lit(" are "), "p_type", F.lit("."),
    )
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))


@query(
    f"""
WITH t AS ({_PART_TEXT})
SELECT p_partkey, regexp_matches(regexp_extract(t, '^[^.]+[.]'), '^(All|No|Some) .+ are( not)? .+\\.$') AS plain, contains(t, '. Therefore, ') AS closes,
  contains(lower(t), ' of them ') AS loose, replace(t, ' are ', ' ') AS flat
FROM t
"""
)
def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain form of the first sentence, mark of the last, loose pronoun, and the text on one line."""
    d = _part_texts(spark, sf_dir).withColumn("p", T.sentences(F.col("t")))
    lines = F.concat(F.lit("\n\n"), F.replace("t", F.lit(" are "), F.lit("\n")), F.lit("\n"))
    return d.select(
        "p_partkey", T.is_categorical(F.get("p", F.lit(0))).alias("plain"), T.ends_with_conclusion(F.col("p")).alias("closes"),
        T.has_loose_pronoun(F.col("t")).alias("loose"), T.one_line(lines).alias("flat"),
    )


@query(
    f"""
WITH t AS ({_PART_TEXT})
SELECT count(*) FILTER (p_partkey % 3 < 2)::BIGINT AS canonical, count(*)::BIGINT * 2 - count(*) FILTER (p_partkey % 3 < 2) AS other,
  count(*) FILTER (p_partkey % 5 <> 0) AS therefore, count(*) FILTER (p_partkey % 5 = 0) AS other_conclusion, count(*) FILTER (p_partkey % 7 = 0) AS loose_pronoun
FROM t
"""
)
def style_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.style_counts(_part_texts(spark, sf_dir), F.col("t"), F.lit(2))


@query(
    f"""
WITH t AS ({_PART_TEXT}), p AS (SELECT unnest(regexp_extract_all(t, '[^.]+[.]')[1:2]) AS s FROM t)
SELECT lower(trim(s, ' ')) AS sentence, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, sentence LIMIT 20
"""
)
def top_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most repeated of the first two sentences of each text."""
    return audit.top_sentences(_part_texts(spark, sf_dir), F.col("t"), first=F.lit(2))


_WORDS_SQL = "list_filter(regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 3 AND NOT list_contains([" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "], w))"


@query(
    f"""
WITH w AS (SELECT conv_id, turn, {_WORDS_SQL.format('text')} AS w FROM conversations)
SELECT conv_id, turn, coalesce(list_has_any(w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn)), FALSE) AS shares FROM w
"""
)
def turns_that_share_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn has a content word of the turn before it."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.content_words(F.col("text")).alias("w"))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(T.overlaps(F.col("w"), before), F.lit(False)).alias("shares"))


# --- scoring ----------------------------------------------------------------------------------------------------------------


@query(SCORE_SQL.replace("FROM labels),\npred", "FROM labels WHERE toxic = 0),\npred", 1))
def score_believable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over gold rows that are believable."""
    from veritext.jobs.queries import gold_and_predictions

    gold, said = gold_and_predictions(spark, sf_dir)
    return score.score(gold, said, plausibility=True).withColumns({c: F.round(c, 9) for c in SCORE_COLUMNS})


@query(
    SCORE_SQL
    + """
UNION ALL SELECT 'absent', 0, 0, 0.0, 0.0, 0.0, 100.0, 0.0, 'unreadable'
UNION ALL SELECT 'broken', 0, 0, 0.0, 0.0, 0.0, 100.0, 0.0, 'unreadable'
UNION ALL SELECT 'empty', 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 'incomplete'
UNION ALL SELECT 'no_ids', 0, 0, 0.0, 0.0, 0.0, 100.0, 0.0, 'unreadable'
"""
)
def score_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files of all systems and of some that can't be read."""
    from veritext.jobs.queries import gold_and_predictions

    gold, said = gold_and_predictions(spark, sf_dir)
    files = {"absent": shared_path(spark, "absent")}
    for name in ("third", "believer", "gaps"):
        files[name] = shared_path(spark, name)
        rows = said.filter(F.col("system") == name).select(F.col("id").cast("string").alias("id"), "validity")
        readers.write_arrays(rows, files[name], F.col("id"))
    odd = {"broken": F.lit('[{"id": "1", "validity": tr'), "empty": F.lit("[]"), "no_ids": F.concat(F.lit("["), F.max(F.to_json(F.struct("quality"))), F.lit("]"))}
    for name, text in odd.items():
        files[name] = shared_path(spark, name)
        table(spark, sf_dir, "labels").agg(F.max("doc_id"), text.alias("value")).select("value").write.text(files[name])
    out = score.score_files(spark, gold.withColumn("id", F.col("id").cast("string")), files)
    return out.withColumns({c: F.round(c, 9) for c in SCORE_COLUMNS})


# --- forms ------------------------------------------------------------------------------------------------------------------


_LETTERS = "(VALUES ('A'), ('E'), ('I'), ('O'))"
_SPREAD = "(({0} IN ('A', 'E') AND {1} = '{3}') OR ({0} IN ('E', 'O') AND {2} = '{3}'))"
_MASK = "CASE {0} WHEN 'S' THEN 240 WHEN 'P' THEN 204 ELSE 170 END"
_HOLDS = "CASE {0} WHEN 'A' THEN {1} & ~{2} & m = 0 WHEN 'E' THEN {1} & {2} & m = 0 WHEN 'I' THEN {1} & {2} & m <> 0 ELSE {1} & ~{2} & m <> 0 END"
_MAJOR = lambda role: _SPREAD.format("fa", "ms", "mp", role)
_MINOR = lambda role: _SPREAD.format("fb", "ns", "np", role)
_END = lambda role: _SPREAD.format("fc", "'S'", "'P'", role)
#: The catalogue: cat(figure, mood, valid, name, fallacy) under Aristotelian semantics.
_CATALOG = f"""
f AS (SELECT * FROM (VALUES (1, 'M', 'P', 'S', 'M'), (2, 'P', 'M', 'S', 'M'), (3, 'M', 'P', 'M', 'S'), (4, 'P', 'M', 'M', 'S')) t(figure, ms, mp, ns, np)),
c AS (SELECT figure, a.f || b.f || c.f AS mood, a.f AS fa, b.f AS fb, c.f AS fc, ms, mp, ns, np FROM f, {_LETTERS} a(f), {_LETTERS} b(f), {_LETTERS} c(f)),
m AS (SELECT range AS m FROM range(256) WHERE range & 240 <> 0 AND range & 204 <> 0 AND range & 170 <> 0),
k AS (SELECT *, {_MASK.format('ms')} AS xms, {_MASK.format('mp')} AS xmp, {_MASK.format('ns')} AS xns, {_MASK.format('np')} AS xnp FROM c),
v AS (
  SELECT figure, mood, fa, fb, fc, ms, mp, ns, np, NOT bool_or({_HOLDS.format('fa', 'xms', 'xmp')} AND {_HOLDS.format('fb', 'xns', 'xnp')} AND NOT {_HOLDS.format('fc', '240', '204')}) AS valid
  FROM k, m GROUP BY ALL),
n AS (SELECT * FROM (VALUES {', '.join(f"('{mood}', {figure}, '{name}')" for (mood, figure), name in forms.NAMES.items())}) t(mood, figure, named)),
q AS (SELECT *, (fa IN ('E', 'O'))::INT + (fb IN ('E', 'O'))::INT AS negatives, (fa IN ('I', 'O'))::INT + (fb IN ('I', 'O'))::INT AS particulars FROM v),
cat AS (
  SELECT q.figure, q.mood, valid, coalesce(named, q.mood || '_' || q.figure) AS name,
    CASE WHEN valid THEN NULL WHEN negatives = 2 THEN 'exclusive_premises'
      WHEN negatives = 1 AND fc NOT IN ('E', 'O') THEN 'affirmative_conclusion_from_negative_premise'
      WHEN negatives = 0 AND fc IN ('E', 'O') THEN 'negative_conclusion_from_affirmative_premises'
      WHEN particulars = 2 THEN 'two_particular_premises'
      WHEN NOT ({_MAJOR('M')} OR {_MINOR('M')}) THEN 'undistributed_middle'
      WHEN {_END('P')} AND NOT {_MAJOR('P')} THEN 'illicit_major'
      WHEN {_END('S')} AND NOT {_MINOR('S')} THEN 'illicit_minor' ELSE 'other_invalid_mood_figure' END AS fallacy
  FROM q LEFT JOIN n ON q.mood = n.mood AND q.figure = n.figure)
"""


@query(
    f"""
WITH {_CATALOG},
o AS (
  SELECT substr('AEIO', (o_orderkey % 4 + 1)::INT, 1) || substr('AEIO', (o_orderkey // 4 % 4 + 1)::INT, 1) || substr('AEIO', (o_orderkey // 16 % 4 + 1)::INT, 1) AS mood,
    (o_orderkey // 64 % 5)::INTEGER AS figure FROM orders)
SELECT valid AS form_valid, name AS form_name, fallacy AS form_fallacy, count(*) AS n, count(DISTINCT (o.mood, o.figure)) AS forms
FROM o LEFT JOIN cat ON o.mood = cat.mood AND o.figure = cat.figure GROUP BY ALL
"""
)
def form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moods and figures read off the order keys (figure 0 doesn't exist), labelled by the catalogue."""
    k = F.col("o_orderkey")
    letter = lambda e: F.substring(F.lit("AEIO"), (e % 4 + 1).cast("int"), F.lit(1))
    o = table(spark, sf_dir, "orders").select(
        F.concat(letter(k), letter(F.floor(k / 4)), letter(F.floor(k / 16))).alias("mood"), (F.floor(k / 64) % 5).cast("int").alias("figure")
    )
    by = forms.label_forms(o).groupBy("form_valid", "form_name", "form_fallacy")
    return by.agg(F.count("*").alias("n"), F.countDistinct("mood", "figure").alias("forms"))


# --- formats ----------------------------------------------------------------------------------------------------------------


@query("SELECT text AS instruction, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS response FROM documents JOIN labels USING (doc_id)")
def instructions_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return formats.instruction(d, F.col("text"), F.col("quality") == 1, upper=False)


@query(
    """
SELECT item_id, 'Conclude from: ' || text AS prompt, v AS validity, p AS plausibility FROM benchmark, (VALUES (TRUE), (FALSE)) a(v), (VALUES (TRUE), (FALSE)) b(p)
"""
)
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second prompt on each text for each pair of labels."""
    b = formats.second_prompts(table(spark, sf_dir, "benchmark"), F.col("text"), "Conclude from: {text}", all_labels=True)
    return b.select("item_id", "prompt", "validity", "plausibility")


@query(
    """
SELECT doc_id AS id, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT (SELECT count(*) FROM benchmark))
UNION ALL SELECT item_id, text FROM benchmark
"""
)
def mixed_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half documents, half benchmark items, as many as there are items twice."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return generate.mix_by_ratio(d, b, 2 * b.count(), 0.5, F.col("id"), F.col("id"))


# --- generation -------------------------------------------------------------------------------------------------------------

#: plan(slot, premise_count, validity, plausibility, serial, i, j, topic_index) for {total} slots of five, six and seven premises.
_PLAN = """
t AS (SELECT ({total})::BIGINT AS total),
st AS (
  SELECT r AS s, 5 + r AS n, total // 3 + (r < total % 3)::INT AS size, r * (total // 3) + least(r, total % 3) AS start FROM t, (SELECT range AS r FROM range(3))),
pp AS (
  SELECT n, i.range AS i, j.range AS j, row_number() OVER (PARTITION BY n ORDER BY j.range DESC, i.range DESC) - 1 AS nth, n * (n - 1) // 2 AS pairs
  FROM (SELECT DISTINCT n FROM st), range(7) i, range(7) j WHERE i.range < j.range AND j.range < n),
sl AS (SELECT r.range AS slot, st.*, r.range - st.start AS local FROM range((SELECT total FROM t)) r JOIN st ON r.range >= st.start AND r.range < st.start + st.size),
plan AS (
  SELECT slot, sl.n AS premise_count, local % 4 IN (0, 2) AS validity, local % 4 IN (0, 1) AS plausibility,
    coalesce((SELECT sum((e.size - local % 4 + 3) // 4) FROM st e WHERE e.s < sl.s), 0)::BIGINT + local // 4 AS serial, pp.i, pp.j, sl.start + 2 * local + 1 AS topic_index
  FROM sl JOIN pp ON pp.n = sl.n AND pp.nth = local % pp.pairs)
"""
_TOPICS = generate.default_lexicon().topics
_DRAWN = f"""
{_CATALOG},
ranked AS (SELECT *, row_number() OVER (PARTITION BY valid ORDER BY coalesce(fallacy, ''), figure, mood, name) - 1 AS nth, count(*) OVER (PARTITION BY valid) AS forms FROM cat WHERE figure < 4),
{_PLAN},
x AS (
  SELECT plan.*, figure, mood, name, fallacy, [{','.join(f"'{t}'" for t in _TOPICS)}][(topic_index % {len(_TOPICS)} + 1)::INT] AS topic
  FROM plan JOIN ranked ON ranked.valid = plan.validity AND ranked.nth = plan.serial % ranked.forms)
"""
_ORDERS = _DRAWN.replace("{total}", "SELECT count(*) FROM orders")


@query()
def generated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example for each order, the order's rank being its slot. ``generated_plan`` has what SQL can tell of them."""
    return generate.generate_like(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    f"""
WITH {_ORDERS}
SELECT slot, premise_count::INTEGER AS premise_count, validity, plausibility, figure, mood, name, fallacy, i::INTEGER AS i, j::INTEGER AS j, topic,
  CASE WHEN validity THEN i || ',' || j ELSE '' END AS relevant, TRUE AS named_by_text, TRUE AS holds_core, TRUE AS all_differ, FALSE AS loose,
  (premise_count + 1)::INTEGER AS sentences FROM x
"""
)
def generated_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each generated example is about: labels, form, places, topic; whether its id is its text's, its core stands at
    its places and at the end, its sentences differ and are as many as they should be."""
    m, p = F.col("metadata"), F.col("p")
    at = F.array(F.get(p, m["candidate_premises"][0]), F.get(p, m["candidate_premises"][1]))
    core = (F.array_sort(at) == F.array_sort(m["core_premises"])) & (F.element_at(p, -1) == m["core_conclusion"])
    x = generated_examples(spark, sf_dir).withColumn("flat", T.normalise(F.col("syllogism"))).withColumn("p", T.normal_sentences(F.col("flat")))
    return x.select(
        "slot", m["premise_count"].alias("premise_count"), "validity", "plausibility", m["figure"].alias("figure"), m["mood"].alias("mood"),
        m["schema_name"].alias("name"), m["fallacy"].alias("fallacy"), m["candidate_premises"][0].alias("i"), m["candidate_premises"][1].alias("j"),
        m["topic"].alias("topic"), T.list_text(F.col("relevant_premises")).alias("relevant"),
        (F.col("id") == F.sha2("flat", 256)).alias("named_by_text"), core.alias("holds_core"),
        (F.size(F.array_distinct(F.transform(p, lambda s: F.lower(s)))) == F.size(p)).alias("all_differ"),
        F.contains(F.lower("flat"), F.lit(" of them ")).alias("loose"), F.size(p).alias("sentences"),
    )


@query()
def generated_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report. ``generated_histograms`` has what SQL can tell of it."""
    return audit.example_audit(generated_examples(spark, sf_dir))


_PLANNED = ("source", "style", "schema", "mood_figure", "figure", "fallacy", "premise_count", "candidate_pair", "relevant_pair_valid_only", "injected",
            "validity", "plausibility", "validity_plausibility", "duplicate_core", "duplicate_text", "rows")


@query(
    f"""
WITH {_ORDERS},
y AS (SELECT *, CASE WHEN validity THEN 'True' ELSE 'False' END AS sv, CASE WHEN plausibility THEN 'True' ELSE 'False' END AS sp, i || ',' || j AS pair FROM x),
h AS (
  SELECT 'source' AS metric, 'synthetic' AS key FROM y UNION ALL SELECT 'style', 'mixed' FROM y UNION ALL SELECT 'schema', name FROM y
  UNION ALL SELECT 'mood_figure', mood || '-' || figure FROM y UNION ALL SELECT 'figure', figure::VARCHAR FROM y
  UNION ALL SELECT 'fallacy', fallacy FROM y WHERE fallacy IS NOT NULL UNION ALL SELECT 'premise_count', premise_count::VARCHAR FROM y
  UNION ALL SELECT 'candidate_pair', pair FROM y UNION ALL SELECT 'relevant_pair_valid_only', pair FROM y WHERE validity
  UNION ALL SELECT 'injected', (premise_count - 2)::VARCHAR FROM y UNION ALL SELECT 'validity', sv FROM y UNION ALL SELECT 'plausibility', sp FROM y
  UNION ALL SELECT 'validity_plausibility', 'validity=' || sv || ',plausibility=' || sp FROM y)
SELECT metric, key, count(*) AS n FROM h GROUP BY ALL
UNION ALL SELECT 'duplicate_core', NULL, 0 UNION ALL SELECT 'duplicate_text', NULL, 0 UNION ALL SELECT 'rows', NULL, count(*) FROM y
"""
)
def generated_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counts that don't hang on the wording."""
    return audit.example_audit(generated_examples(spark, sf_dir)).filter(F.col("metric").isin(*_PLANNED))


@query("SELECT count(*) AS rows, 0::BIGINT AS violations FROM orders")
def generated_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many generated rows there are and how many break a rule (none)."""
    x = generated_examples(spark, sf_dir)
    bad = rules.example_violations(x, F.col("slot"))
    return x.agg(F.count("*").alias("rows")).crossJoin(bad.agg(F.count("*").alias("violations")))


@query(
    """
WITH c AS (SELECT count(*) AS n, greatest(2, length(bin(greatest(count(*), 1) - 1))) AS bits FROM documents),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, n, bits // 2 AS low, (1 << (bits // 2)) - 1 AS lower, (1 << (bits - bits // 2)) - 1 AS upper FROM documents, c)
SELECT doc_id, list_reduce(list_prepend(i, range(120)), lambda s, w: CASE WHEN w > 0 AND s < n THEN s ELSE
  list_reduce(list_prepend(s, range(6)), lambda x, k: CASE WHEN k % 2 = 0
    THEN xor(x, (('0x' || substr(md5('order-1:' || k || ':' || (x & lower)), 1, 15))::BIGINT & upper) << low)
    ELSE xor(x, ('0x' || substr(md5('order-1:' || k || ':' || (x >> low)), 1, 15))::BIGINT & lower) END) END)::BIGINT AS place
FROM d
"""
)
def shuffled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in a keyed permutation of all documents, whose ids count from 0."""
    return generate.shuffled(table(spark, sf_dir, "documents"), "doc_id", "order-1", F.col("doc_id"), "place").select("doc_id", "place")


def _part_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return _part_texts(spark, sf_dir).select(
        i.alias("base_index"), i.cast("string").alias("id"), F.col("t").alias("syllogism"), (i % 2 == 0).alias("validity"), (i % 3 == 0).alias("plausibility")
    )


@query(
    """
WITH s AS (SELECT p_partkey % 2 = 0 AS validity, count(*) AS n FROM part GROUP BY 1)
SELECT validity, n, n AS with_all_sentences, n AS with_right_size, n AS bases FROM s
"""
)
def injected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors put into a text on each part: rows by label, those that hold all three sentences of their base, and the bases used."""
    x = generate.inject(_part_base(spark, sf_dir))
    held = F.forall(T.sentences(F.col("base_syllogism")), lambda s: F.contains("syllogism", s))
    size = (F.size(T.sentences(F.col("syllogism"))) == F.col("premise_count") + 1) & (F.size("relevant_premises") == F.when(F.col("validity"), 2).otherwise(0))
    return x.groupBy("validity").agg(
        F.count("*").alias("n"), F.count_if(held).alias("with_all_sentences"), F.count_if(size).alias("with_right_size"), F.countDistinct("base_index").alias("bases")
    )


@query()
def injected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors put into the documents that have exactly three sentences."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    base = d.select(
        F.col("doc_id").alias("base_index"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("syllogism"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("validity"), (F.col("toxic") == 0).alias("plausibility"),
    )
    return generate.inject(base)


@query(
    f"""
WITH {_PLAN.replace("{total}", "SELECT (SELECT count(*) FROM part) - n FROM (SELECT round_even((SELECT count(*) FROM part) * 0.3, 0)::BIGINT AS n)")},
b AS (SELECT 5 + range % 3 AS premise_count FROM range((SELECT round_even((SELECT count(*) FROM part) * 0.3, 0)::BIGINT))),
a AS (SELECT 'synthetic' AS source, premise_count FROM plan UNION ALL SELECT 'base', premise_count FROM b)
SELECT source, premise_count::INTEGER AS premises, count(*) AS n, count(*) AS texts FROM a GROUP BY ALL
"""
)
def generated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many examples as there are parts, three in ten made from texts on parts, checked and published; rows and distinct texts."""
    base = _part_base(spark, sf_dir)
    out = generate.public(generate.generate_dataset(spark, base.count(), mode="mixed", base=base, ratio=0.3), metadata=True)
    by = out.groupBy(F.col("metadata.source").alias("source"), F.col("metadata.premise_count").alias("premises"))
    return by.agg(F.count("*").alias("n"), F.countDistinct(F.sha2(T.signature(F.col("syllogism")), 256)).alias("texts"))
