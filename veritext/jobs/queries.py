"""Queries over the given tables, one for each operator or family of operators, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import text as T
from veritext.functions.shared import shared_path
from veritext.operators import audit, dedup, formats, published, rules, score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB forms of the shared text expressions.
_NORM = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'), ' ')"
_PARTS = "list_transform(regexp_extract_all({}, '[^.!?]+[.!?]'), lambda s: trim(s, ' '))"
SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def norm_sql(c: str) -> str:
    return _NORM.format(c)


def sentences_sql(c: str) -> str:
    flat = norm_sql(c)
    rough = f"list_filter(list_transform(string_split_regex({flat}, '\\.\\s*'), lambda s: trim(s, ' ')), lambda s: s <> '')"
    rough = f"list_transform({rough}, lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"
    return f"CASE WHEN len({_PARTS.format(flat)}) > 0 THEN {_PARTS.format(flat)} ELSE {rough} END"


# --- scoring -------------------------------------------------------------------------------------------------------


def _predictions(labels: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    rows = [
        labels.select(F.lit("third").alias("system"), i.alias("id"), (i % 3 != 0).alias("validity")),
        labels.select(F.lit("believer").alias("system"), i.alias("id"), F.when(i % 11 != 0, F.col("toxic") == 0).alias("validity")),
        labels.filter(i % 7 != 0).select(F.lit("gaps").alias("system"), i.alias("id"), F.lit(True).alias("validity")),
        labels.filter(i % 5 == 0).select(F.lit("third").alias("system"), i.alias("id"), F.lit(True).alias("validity")),
    ]
    return reduce(DataFrame.union, rows)


def gold_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    gold = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("validity"), (F.col("toxic") == 0).alias("plausibility"))
    return gold, _predictions(labels)


SCORE_COLUMNS = ("accuracy", "intra", "inter", "content_effect", "combined")
SCORE_SQL = """
WITH gold AS (SELECT doc_id AS id, quality = 1 AS v, toxic = 0 AS p FROM labels),
pred AS (
  SELECT 'third' AS system, doc_id AS id, doc_id % 3 <> 0 AS said FROM labels
  UNION ALL SELECT 'believer', doc_id, CASE WHEN doc_id % 11 <> 0 THEN toxic = 0 END FROM labels
  UNION ALL SELECT 'gaps', doc_id, TRUE FROM labels WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'third', doc_id, TRUE FROM labels WHERE doc_id % 5 = 0),
j AS (SELECT system, id, said, v, p FROM pred JOIN gold USING (id)),
c AS (
  SELECT system, count(DISTINCT id) AS covered, count(*) FILTER (said IS NOT NULL) AS total, count(*) FILTER (said = v) AS correct,
    count(*) FILTER (said = v AND v AND p) AS c_vp, count(*) FILTER (said IS NOT NULL AND v AND p) AS n_vp,
    count(*) FILTER (said = v AND v AND NOT p) AS c_vi, count(*) FILTER (said IS NOT NULL AND v AND NOT p) AS n_vi,
    count(*) FILTER (said = v AND NOT v AND p) AS c_ip, count(*) FILTER (said IS NOT NULL AND NOT v AND p) AS n_ip,
    count(*) FILTER (said = v AND NOT v AND NOT p) AS c_ii, count(*) FILTER (said IS NOT NULL AND NOT v AND NOT p) AS n_ii
  FROM j GROUP BY system),
a AS (
  SELECT *, covered = (SELECT count(*) FROM gold) AS ok FROM c),
s AS (
  SELECT system, total, correct, ok,
    CASE WHEN ok AND total > 0 THEN correct / total * 100 ELSE 0.0 END AS accuracy,
    CASE WHEN ok AND n_vp > 0 THEN c_vp / n_vp * 100 ELSE 0.0 END AS vp, CASE WHEN ok AND n_vi > 0 THEN c_vi / n_vi * 100 ELSE 0.0 END AS vi,
    CASE WHEN ok AND n_ip > 0 THEN c_ip / n_ip * 100 ELSE 0.0 END AS ip, CASE WHEN ok AND n_ii > 0 THEN c_ii / n_ii * 100 ELSE 0.0 END AS ii
  FROM a),
e AS (SELECT *, (abs(vp - vi) + abs(ip - ii)) / 2 AS intra, (abs(vp - ip) + abs(vi - ii)) / 2 AS inter FROM s)
SELECT system, total, correct, round(accuracy, 9) AS accuracy, round(intra, 9) AS intra, round(inter, 9) AS inter,
  round((intra + inter) / 2, 9) AS content_effect,
  round(CASE WHEN ok THEN accuracy / (1 + ln(1 + (intra + inter) / 2)) ELSE 0.0 END, 9) AS combined,
  CASE WHEN ok THEN 'ok' ELSE 'incomplete' END AS status
FROM e
"""


@query(SCORE_SQL)
def score_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score(*gold_and_predictions(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in SCORE_COLUMNS})


_ANSWER = "CASE conv_id % 5 WHEN 0 THEN ' It is valid' WHEN 1 THEN ' It is invalid' WHEN 2 THEN ' So this isn''t valid' WHEN 3 THEN ' valid or invalid' ELSE ' TRUE' END"


@query(
    f"""
WITH a AS (SELECT conv_id, turn, text || {_ANSWER} AS answer FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, list_last(string_split(trim(answer, E' \\n\\t'), '.')) AS part, list_last(string_split(trim(lower(answer), E' \\n\\t'), '.')) AS low FROM a)
SELECT conv_id, turn, contains(answer, 'TRUE') AS said_true, regexp_matches(part, '\\bvalid\\b') AS said_valid,
  CASE WHEN regexp_matches(low, '\\bnot\\b|n''t\\b') OR NOT (regexp_matches(low, '\\bvalid\\b') OR regexp_matches(low, '\\binvalid\\b')) THEN 0.0
       WHEN CASE WHEN conv_id % 2 = 0 THEN regexp_matches(low, '\\bvalid\\b') ELSE regexp_matches(low, '\\binvalid\\b') END THEN 1.0 ELSE -1.0 END::DOUBLE AS reward
FROM p
"""
)
def answers_and_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and rewards of every assistant turn."""
    return _rewarded(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn")


def _rewarded(turns: DataFrame, *keys: str) -> DataFrame:
    k = F.col("conv_id") % 5
    verdict = F.when(k == 0, " It is valid").when(k == 1, " It is invalid").when(k == 2, " So this isn't valid").when(k == 3, " valid or invalid").otherwise(" TRUE")
    a = turns.select(*keys, F.concat("text", verdict).alias("answer"))
    answer = F.col("answer")
    return a.select(
        *keys, score.parse_word(answer).alias("said_true"), score.parse_reasoned(answer).alias("said_valid"),
        score.reward(answer, F.col("conv_id") % 2 == 0).alias("reward"),
    )


# --- ids and duplicates --------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({norm_sql('text')}) AS id, sha256(lower({norm_sql('text')})) AS key FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.content_id(F.col("text")).alias("id"), F.sha2(T.signature(F.col("text")), 256).alias("key"))


@query(
    """
WITH f AS (SELECT text, min((source, doc_id)) AS m, count(*) AS n FROM documents GROUP BY text)
SELECT sha256(d.text) AS key, source AS file, doc_id AS pos, struct_extract(m, 1) AS first_file, struct_extract(m, 2) AS first_pos
FROM documents d JOIN f ON d.text = f.text WHERE n > 1 AND (source, doc_id) <> m
"""
)
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_report(table(spark, sf_dir, "documents"), F.sha2("text", 256), "source", "doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat FROM documents")
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flag_repeats(table(spark, sf_dir, "documents"), F.col("text"), [F.col("doc_id")]).select("doc_id", "is_repeat")


@query("SELECT min(doc_id) AS doc_id, any_value(source) AS source FROM documents GROUP BY text HAVING count(*) = 1")
def without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_all_copies(table(spark, sf_dir, "documents"), F.col("text")).select("doc_id", "source")


@query(f"SELECT count(*) - count(DISTINCT lower({norm_sql('text')})) AS repeats FROM documents")
def repeat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeat_count(table(spark, sf_dir, "documents"), T.signature(F.col("text")))


@query(
    """
WITH p AS (SELECT DISTINCT p_name AS n FROM part)
SELECT least(a.n, b.n) AS id_a, greatest(a.n, b.n) AS id_b, levenshtein(a.n, b.n)::INTEGER AS distance
FROM p a JOIN p b ON a.n < b.n AND levenshtein(a.n, b.n) <= 3
"""
)
def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id")).distinct()
    return dedup.similar_pairs(names, "id", "id", k=3)


#: One byte for each character of the tables' sentences, as the SQL function counts edits in bytes; lower-cased texts hold no capitals.
_BYTES = "translate(s, 'ßàâäçèéêëíîïñóôöùûüœ', 'ABCDEFGHIJKLMNOPQRSTU')"
_COUNTS = [f"len(s) - len(replace(s, '{c}', ''))" for c in "eatinosr"]
#: Pairs of rows of d (s, and what ``cols`` names) within three edits; counts of letters part most pairs before edits are counted.
_SIMILAR = f"""
u AS (SELECT *, {_BYTES} AS b, len(s) AS n, [{", ".join(_COUNTS)}] AS c FROM d),
v AS (SELECT *, unnest(range(n - 3, n + 1)) AS m FROM u),
w AS (
  SELECT x.* EXCLUDE (b, n, c, m), y.* EXCLUDE (b, n, c), levenshtein(x.b, y.b)::INTEGER AS distance
  FROM v x JOIN u y ON x.m = y.n AND (x.n > y.n OR x.s > y.s)
  WHERE abs(x.c[1] - y.c[1]) + abs(x.c[2] - y.c[2]) + abs(x.c[3] - y.c[3]) + abs(x.c[4] - y.c[4])
      + abs(x.c[5] - y.c[5]) + abs(x.c[6] - y.c[6]) + abs(x.c[7] - y.c[7]) + abs(x.c[8] - y.c[8]) <= 6 AND levenshtein(x.b, y.b) <= 3)
"""
_SENTENCES = f"SELECT doc_id, unnest(range(len(p)))::INTEGER AS pos, lower(unnest(p)) AS s FROM (SELECT doc_id, {sentences_sql('text')} AS p FROM documents)"


@query(
    f"""
WITH d AS (SELECT DISTINCT s FROM ({_SENTENCES})), {_SIMILAR}
SELECT least(s, s_1) AS id_a, greatest(s, s_1) AS id_b, distance FROM w
"""
)
def similar_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct sentences within three edits."""
    s = table(spark, sf_dir, "documents").select(F.explode(T.sentences(F.col("text"))).alias("s"))
    s = s.select(T.signature(F.col("s")).alias("id")).distinct()
    return dedup.similar_pairs(s, "id", "id", k=3)


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS class_id FROM part")
def similar_part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_classes(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query(
    """
WITH p AS (SELECT p_name AS n, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT least(a.id, b.id) AS class_a, greatest(a.id, b.id) AS class_b, levenshtein(a.n, b.n)::INTEGER AS distance
FROM p a JOIN p b ON a.n < b.n AND levenshtein(a.n, b.n) <= 3
"""
)
def similar_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_class_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", k=3)


@query(
    """
WITH w AS (
  SELECT least((a.p_brand, a.p_partkey), (b.p_brand, b.p_partkey)) AS x, greatest((a.p_brand, a.p_partkey), (b.p_brand, b.p_partkey)) AS y,
         levenshtein(a.p_name, b.p_name)::INTEGER AS distance
  FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND levenshtein(a.p_name, b.p_name) <= 3)
SELECT struct_extract(x, 1) AS file_a, struct_extract(x, 2) AS pos_a, struct_extract(y, 1) AS file_b, struct_extract(y, 2) AS pos_b, distance FROM w
"""
)
def similar_part_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts with similar names by both places, the brand as the file."""
    return dedup.similar_places(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name", k=3)


@query(
    f"""
WITH d AS (SELECT s, count(*) AS copies FROM ({_SENTENCES}) GROUP BY s), {_SIMILAR}
SELECT distance, sum(n)::BIGINT AS pairs FROM (
  SELECT 0 AS distance, copies * (copies - 1) // 2 AS n FROM d WHERE copies > 1 UNION ALL SELECT distance, copies * copies_1 FROM w)
GROUP BY distance
"""
)
def similar_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of sentences, all their places counted, lie within three edits, by distance."""
    return dedup.similar_counts(_placed_sentences(spark, sf_dir), "id", "s", k=3)


def _placed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return d.select(F.struct("doc_id", "pos").alias("id"), "s")


@query(
    f"""
WITH d AS (SELECT doc_id, {sentences_sql('text')} AS p FROM documents),
s AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS pos, lower(unnest(p)) AS s FROM d),
f AS (SELECT s, min((doc_id, pos)) AS m FROM s GROUP BY s)
SELECT doc_id, pos, struct_extract(m, 1) AS class_doc_id, struct_extract(m, 2) AS class_pos FROM s JOIN f USING (s)
"""
)
def similar_sentence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each sentence of each document, by the place (doc_id, position) of its first occurrence."""
    c = dedup.similar_classes(_placed_sentences(spark, sf_dir), "id", "s")
    return c.select("id.doc_id", "id.pos", F.col("class_id.doc_id").alias("class_doc_id"), F.col("class_id.pos").alias("class_pos"))


@query(
    f"""
WITH d AS (SELECT min((doc_id, pos)) AS place, s FROM ({_SENTENCES}) GROUP BY s), {_SIMILAR}
SELECT struct_extract(least(place, place_1), 1) AS doc_id_a, struct_extract(least(place, place_1), 2) AS pos_a,
       struct_extract(greatest(place, place_1), 1) AS doc_id_b, struct_extract(greatest(place, place_1), 2) AS pos_b, distance FROM w
"""
)
def similar_sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the classes of ``similar_sentence_classes`` within three edits."""
    c = dedup.similar_class_pairs(_placed_sentences(spark, sf_dir), "id", "s", k=3)
    a, b = F.col("class_a"), F.col("class_b")
    return c.select(
        a["doc_id"].alias("doc_id_a"), a["pos"].alias("pos_a"), b["doc_id"].alias("doc_id_b"), b["pos"].alias("pos_b"), "distance"
    )


@query(
    """
WITH u AS (SELECT doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT item_id::VARCHAR, text FROM benchmark),
a AS (SELECT id AS v, count(*) AS n FROM u GROUP BY 1), b AS (SELECT text AS v, count(*) AS n FROM u GROUP BY 1)
SELECT 'id' AS field, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS repeated_values, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS surplus_rows FROM a
UNION ALL
SELECT 'text', sum(n)::BIGINT, count(*) FILTER (n > 1), coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT FROM b
"""
)
def merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return dedup.merge_report([d, b], ("id", "text"))


@query(
    """
WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0),
f AS (SELECT text, min(doc_id) AS first_pos FROM a GROUP BY text HAVING count(*) = 1)
SELECT b.doc_id AS pos, 'a' AS first_file, f.first_pos FROM b JOIN f USING (text)
"""
)
def known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one part whose text an indexed part, that of the texts that occur once in it, holds already, with the first place."""
    d, root = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_path(spark, "published")
    published.append(dedup.drop_all_copies(d.filter("doc_id % 3 = 0"), F.col("text")), root, F.lit("a"), F.col("doc_id"), ("text",))
    new = d.filter("doc_id % 3 <> 0")
    return published.later_places(new, root, F.lit("b"), F.col("doc_id"), ("text",)).select("pos", "first_file", "first_pos")


# --- audits --------------------------------------------------------------------------------------------------------


@query(
    f"""
WITH p AS (SELECT unnest({sentences_sql('text')}) AS s FROM documents)
SELECT lower({norm_sql('s')}) AS sentence, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, sentence LIMIT 20
"""
)
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_sentences(table(spark, sf_dir, "documents"), F.col("text"))


@query(
    """
SELECT quality AS a, toxic AS b, grouping(quality)::INTEGER AS all_a, grouping(toxic)::INTEGER AS all_b, count(*) AS n
FROM labels GROUP BY GROUPING SETS ((quality, toxic), (quality), (toxic))
"""
)
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.crosstab(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))


@query(
    f"""
WITH d AS (SELECT lang, source, quality, toxic, len({sentences_sql('text')}) AS k FROM documents LEFT JOIN labels USING (doc_id)),
m AS (
  SELECT 'lang' AS metric, lang AS key FROM d UNION ALL SELECT 'source', source FROM d
  UNION ALL SELECT 'quality', CASE quality WHEN 1 THEN 'true' WHEN 0 THEN 'false' END FROM d
  UNION ALL SELECT 'toxic', toxic::VARCHAR FROM d WHERE toxic IS NOT NULL UNION ALL SELECT 'sentences', k::VARCHAR FROM d)
SELECT metric, key, count(*) AS n FROM m GROUP BY ALL
"""
)
def audit_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    metrics = {
        "lang": F.col("lang"), "source": F.col("source"), "quality": T.label_key(F.col("quality").cast("string")), "toxic": F.col("toxic"),
        "sentences": F.size(T.sentences(F.col("text"))),
    }
    return audit.histograms(d, metrics, skip_null=("toxic",))


def _index_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the line numbers (from 0) that were returned."""
    li = table(spark, sf_dir, "lineitem")
    x = F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", (F.col("l_linenumber") - 1).cast("int"))))
    return li.groupBy("l_orderkey").agg(x.alias("x"))


_SETS = """
WITH o AS (
  SELECT l_orderkey, coalesce(list(l_linenumber - 1 ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), []) AS x FROM lineitem GROUP BY 1)
"""
_GAP = "list_bool_or(list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i] > 1))"


@query(
    _SETS
    + f"""
SELECT count(*) AS rows, count(*) FILTER (len(x) = 0) AS missing, count(*) FILTER (len(x) > 0 AND list_max(x) >= 3) AS late,
  count(*) FILTER (len(x) > 0 AND list_max(x) < 3) AS only_early, count(*) FILTER (len(x) > 1 AND {_GAP}) AS non_adjacent,
  coalesce(max(list_max(x)), -1)::INTEGER AS max_index
FROM o
"""
)
def index_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.position_counts(_index_sets(spark, sf_dir), F.col("x"))


@query(_SETS + ", i AS (SELECT unnest(x) AS i FROM o) SELECT i::INTEGER AS index, count(*) AS n FROM i GROUP BY 1")
def index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.index_histogram(_index_sets(spark, sf_dir), F.col("x"))


@query(_SETS + "SELECT array_to_string(x, ',') AS key, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def top_index_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_sets(_index_sets(spark, sf_dir), F.col("x"))


@query(
    _SETS
    + """
SELECT count(*) FILTER (l_orderkey % 2 = 0) AS valid_rows, count(*) FILTER (l_orderkey % 2 = 0 AND len(x) = 2 AND list_max(x) >= 3) AS late,
  count(*) FILTER (l_orderkey % 2 = 0 AND len(x) = 2 AND abs(x[1] - x[2]) > 1) AS non_adjacent
FROM o
"""
)
def valid_index_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.valid_position_counts(_index_sets(spark, sf_dir), F.col("l_orderkey") % 2 == 0, F.col("x"))


@query(
    _SETS
    + """
, k AS (SELECT array_to_string(x, ',') AS k, count(*) AS n FROM o WHERE len(x) > 0 GROUP BY 1),
l AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'no_late_index' AS warning, 0.0::DOUBLE AS value FROM o HAVING count(*) FILTER (list_max(x) >= 3) = 0
UNION ALL SELECT 'dominant_set', max(n) / sum(n) FROM k HAVING max(n) / sum(n) > 0.05
UNION ALL SELECT 'unbalanced_labels', min(n) / sum(n) FROM l HAVING count(*) = 2 AND min(n) / sum(n) < 0.35
"""
)
def artifact_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _index_sets(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return audit.artifact_warnings(o, F.col("x"), F.col("o_orderstatus"), most=0.05)


def _style_sql(plain: str, marker: str, pronoun: str) -> str:
    return f"""
WITH d AS (SELECT {sentences_sql('text')} AS p, lower({norm_sql('text')}) AS low FROM documents),
h AS (SELECT p, low, CASE WHEN len(p) > 1 THEN list_slice(p, 1, len(p) - 1) ELSE [] END AS h FROM d),
c AS (SELECT *, len(list_filter(h, lambda s: regexp_matches(s, '{plain}'))) AS k, len(p) > 0 AND starts_with(p[-1], '{marker}') AS closes FROM h)
SELECT sum(k)::BIGINT AS canonical, sum(len(h) - k)::BIGINT AS other, count(*) FILTER (closes) AS therefore,
  count(*) FILTER (NOT closes AND len(p) > 0) AS other_conclusion, count(*) FILTER (contains(low, '{pronoun}')) AS loose_pronoun
FROM c
"""


_PLAIN = r"^(Is|The|On) .+ [a-z]+\.$"


def _premises() -> Column:
    """All sentences but the last are premises."""
    return F.greatest(F.size("parts") - 1, F.lit(0))


@query(_style_sql(_PLAIN, "The ", " of the "))
def style_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style counters with patterns that these texts hold (they have no syllogisms)."""
    return audit.style_counts(table(spark, sf_dir, "documents"), F.col("text"), _premises(), _PLAIN, "The ", " of the ")


@query(_style_sql(T.CATEGORICAL, "Therefore,", " of them "))
def style_flags_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style counters with their own patterns."""
    return audit.style_counts(table(spark, sf_dir, "documents"), F.col("text"), _premises())


@query(
    r"""
SELECT item_id AS doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 3
  AND NOT list_contains(['from', 'some', 'that', 'there', 'this', 'with', 'every', 'single', 'thing', 'things', 'item', 'items', 'member', 'members',
  'among', 'included', 'classified', 'considered', 'known', 'therefore', 'consequently', 'thus', 'follows', 'conclusion', 'conclude', 'must', 'case',
  'true', 'fact'], w)))), ' ') AS words,
  len(regexp_extract_all(text, '[0-9]+')) AS numbers, upper(text[1]) || text[2:] AS capital
FROM benchmark
"""
)
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("doc_id"), F.array_join(F.sort_array(T.content_words(F.col("text"))), " ").alias("words"),
        F.size(T.index_list(F.col("text"))).cast("long").alias("numbers"), T.capitalise(F.col("text")).alias("capital"),
    )


# --- rules ---------------------------------------------------------------------------------------------------------


@query(
    r"""
WITH d AS (
  SELECT doc_id AS r, text, CASE WHEN doc_id % 17 <> 0 THEN quality = 1 END AS v, CASE WHEN doc_id % 13 <> 0 THEN toxic = 0 END AS p,
    CASE WHEN doc_id % 3 = 0 THEN [doc_id % 7, doc_id % 5 - 1] ELSE [] END AS rel
  FROM documents LEFT JOIN labels USING (doc_id)),
e AS (
  SELECT *, v IS NOT NULL AND p IS NOT NULL AS ok, concat_ws(',', CASE WHEN v IS NULL THEN 'validity' END, CASE WHEN p IS NULL THEN 'plausibility' END) AS missing,
    instr(text, ' the ') AS found_at,
    len(list_filter(list_transform(list_filter(list_transform(string_split_regex(trim(text[1:instr(text, ' the ') - 1], E' \n'), '\.\s+'),
      lambda s: trim(s, ' ')), lambda s: s <> ''), lambda s: trim(regexp_replace(s, '\.$', ''), ' ')), lambda s: s <> '')) AS n0
  FROM d),
f AS (
  SELECT *, CASE WHEN found_at > 0 THEN n0 ELSE 0 END AS n, ok AND row_number() OVER (PARTITION BY text, ok ORDER BY r) > 1 AS again FROM e),
x AS (
  SELECT r AS row, 'missing_fields' AS rule, missing AS detail FROM f WHERE NOT ok
  UNION ALL SELECT r, 'duplicate_text', '' FROM f WHERE again
  UNION ALL SELECT r, 'premise_count', n::VARCHAR FROM f WHERE ok AND n NOT IN (4, 5, 6)
  UNION ALL SELECT r, 'relevant_count', len(rel)::VARCHAR FROM f WHERE ok AND v AND len(rel) <> 2
  UNION ALL SELECT r, 'relevant_not_empty', len(rel)::VARCHAR FROM f WHERE ok AND NOT v AND len(rel) > 0
  UNION ALL SELECT r, 'relevant_range', i::VARCHAR FROM (SELECT r, n, unnest(rel) AS i FROM f WHERE ok) WHERE i < 0 OR i >= n)
SELECT row, rule, detail FROM x
"""
)
def stress_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stress_violations(_stress_rows(spark, sf_dir), F.col("doc_id"), marker=" the ").select("row", "rule", "detail")


def _stress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    rel = F.when(i % 3 == 0, F.array((i % 7).cast("int"), (i % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.select(
        "doc_id", i.cast("string").alias("id"), F.col("text").alias("syllogism"), F.when(i % 17 != 0, F.col("quality") == 1).alias("validity"),
        F.when(i % 13 != 0, F.col("toxic") == 0).alias("plausibility"), rel.alias("relevant_premises"),
    )


@query(
    f"""
WITH v AS ({SQL["stress_violations"]}),
w AS (SELECT min((row, rule)) AS f FROM v)
SELECT 'all' AS part, false AS published, (SELECT count(*) FROM documents) AS rows, count(DISTINCT row) AS broken, count(*) AS violations,
       min(row)::VARCHAR AS first_row, 0::BIGINT AS readable FROM v
UNION ALL SELECT 'clean', true, count(*), 0, 0, NULL, count(*) FROM documents WHERE doc_id NOT IN (SELECT row FROM v)
"""
)
def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published through the gate of the stress rules: all of them, which break rules, and those that don't; and what can be read afterwards."""
    marked, rows = rules.mark_stress(_stress_rows(spark, sf_dir), F.col("doc_id"), marker=" the "), []
    for part, some in (("all", marked), ("clean", marked.filter(F.size("violations") == 0))):
        path = shared_path(spark, "gated")
        g = rules.publish(some, path, strict=False)
        readable = spark.read.parquet(path).count() if g.published else 0
        rows.append((part, g.published, g.rows, g.broken, g.violations, g.first.split(" ")[0] if g.first else None, readable))
    return spark.createDataFrame(rows, "part string, published boolean, rows long, broken long, violations long, first_row string, readable long")


@query(
    f"""
WITH v AS ({SQL["stress_violations"]}), n AS (SELECT rule, count(*) AS n FROM v GROUP BY rule)
SELECT 'more' AS rule, (sum(n) - 100)::VARCHAR AS detail, 1::BIGINT AS n FROM n HAVING sum(n) > 100
UNION ALL SELECT 'shown', NULL, least(sum(n), 100)::BIGINT FROM n
"""
)
def stress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first 100 violations: how many it shows, and the number of the rest that it tells."""
    report = rules.violation_report(rules.stress_violations(_stress_rows(spark, sf_dir), F.col("doc_id"), marker=" the "))
    by = report.groupBy(F.when(F.col("rule") == "more", "more").otherwise("shown").alias("rule"), F.when(F.col("rule") == "more", F.col("detail")).alias("detail"))
    return by.agg(F.count("*").alias("n"))


# --- forms ---------------------------------------------------------------------------------------------------------


# --- splits and formats --------------------------------------------------------------------------------------------


@query(
    """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split-1:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.15) THEN 'validation' ELSE 'train' END AS part FROM d
"""
)
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.split_exact(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "part")


@query(
    """
SELECT text AS instruction, CASE WHEN quality = 1 THEN 'TRUE' ELSE 'FALSE' END AS response,
  '<user>' || text || '<assistant>' || CASE WHEN quality = 1 THEN 'TRUE' ELSE 'FALSE' END || '<end>' AS prompt
FROM documents JOIN labels USING (doc_id)
"""
)
def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = formats.instruction(d, F.col("text"), F.col("quality") == 1)
    return out.withColumn("prompt", formats.prompt_string(F.col("instruction"), F.col("response"), "<user>", "<assistant>", "<end>"))


@query(
    """
SELECT doc_id, 'system=Judge.|user=' || text AS prompt, quality = 1 AS validity FROM documents JOIN labels USING (doc_id)
"""
)
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    messages = formats.chat(F.col("text"), "Judge.")
    said = F.array_join(F.transform(messages, lambda m: F.concat_ws("=", m["role"], m["content"])), "|")
    return d.select("doc_id", said.alias("prompt"), (F.col("quality") == 1).alias("validity"))


@query("SELECT conv_id, string_agg(role || '=' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = formats.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@query(
    """
WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation),
f AS (SELECT * FROM (VALUES ('valid_short', 'A {plausibility} case on {topic}.'), ('invalid_short', 'A broken {plausibility} case on {topic}.')) t(format, template)),
p AS (SELECT * FROM (VALUES ('plausible'), ('implausible')) t(plausibility))
SELECT n_name AS topic, format, plausibility, replace(replace(template, '{topic}', n_name), '{plausibility}', plausibility) AS prompt,
  NOT contains(format, 'invalid') AS validity
FROM n, f, p WHERE r <= 13
"""
)
def prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over the first 13 nations by name, as n = 100 asks for; ``prompt_grid_parts`` takes all distinct part names."""
    shapes = {"valid_short": "A {plausibility} case on {topic}.", "invalid_short": "A broken {plausibility} case on {topic}."}
    return formats.prompt_grid(spark, table(spark, sf_dir, "nation").select("n_name"), shapes, 100)


@query(
    """
WITH t AS (SELECT DISTINCT p_name AS topic FROM part),
f AS (SELECT * FROM (VALUES ('valid_short', 'A {plausibility} case on {topic}.'), ('invalid_short', 'A broken {plausibility} case on {topic}.')) t(format, template)),
p AS (SELECT * FROM (VALUES ('plausible'), ('implausible')) t(plausibility))
SELECT topic, format, plausibility, replace(replace(template, '{topic}', topic), '{plausibility}', plausibility) AS prompt,
  NOT contains(format, 'invalid') AS validity
FROM t, f, p
"""
)
def prompt_grid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid over the distinct names of all parts."""
    shapes = {"valid_short": "A {plausibility} case on {topic}.", "invalid_short": "A broken {plausibility} case on {topic}."}
    return formats.prompt_grid(spark, table(spark, sf_dir, "part").select("p_name").distinct(), shapes)


from veritext.jobs import dataset_queries as _more  # noqa: E402, F401  (registers its queries)


def queries() -> dict:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
