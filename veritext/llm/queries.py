"""Queries that apply each operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / norm) AS e FROM g WHERE norm > 0 AND isfinite(norm)),
e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS reach FROM v UNION SELECT r.vec_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _not_held(remainder: int, of: int):
    """Rows that may teach: crc32 of the id as text, modulo ``of``, isn't ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of != remainder


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"), _not_held(2, 4))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.pii import pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), key="corpus-key-1")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.html_blocks import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _not_held(1, 3))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.token_files import read_token_files, write_token_files

    folder, manifest = write_token_files(_table(spark, sf_dir, "documents"))
    return read_token_files(spark, folder, manifest)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS sh
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared_n
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * shared_n >= 85 * (nx.n + ny.n - shared_n)),
r AS (
  SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d0 AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM documents),
d AS (SELECT *, length(bin(size + 1)) - 1 AS k FROM d0),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
s1 AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER fill AS nth,
         coalesce(sum(3 * source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_total
  FROM s0 WINDOW fill AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST)),
s2 AS (
  SELECT *, (total - cap_before)::DOUBLE / (w_total - w_before)::DOUBLE AS level0 FROM s1),
s3 AS (
  SELECT *, (SELECT level0 FROM s2 WHERE level0 * w <= cap ORDER BY nth LIMIT 1) AS level FROM s2),
s4 AS (
  SELECT source, source_size, CASE WHEN level * w < cap THEN level * w ELSE cap::DOUBLE END AS target FROM s3),
c0 AS (SELECT source, k, sum(size)::BIGINT AS words FROM d GROUP BY source, k),
c1 AS (
  SELECT c0.source, k, words, source_size, target, 3 * words AS cap, (4 + k) * words AS w
  FROM c0 JOIN s4 ON c0.source IS NOT DISTINCT FROM s4.source),
c2 AS (
  SELECT *, row_number() OVER fill AS nth,
         (target - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level0
  FROM c1 WHERE words > 0 WINDOW fill AS (PARTITION BY source ORDER BY k DESC)),
c3 AS (SELECT source, arg_min(level0, nth) FILTER (level0 * w <= cap) AS level FROM c2 GROUP BY source),
c4 AS (
  SELECT c1.*, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN level * (4 + k) < 3 THEN level * (4 + k) ELSE 3.0::DOUBLE END AS copies
  FROM c1 LEFT JOIN c3 ON c1.source IS NOT DISTINCT FROM c3.source),
c5 AS (
  SELECT *, floor(copies)::BIGINT AS base, copies - floor(copies) AS f,
         target - (sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS missing
  FROM c4),
j AS (
  SELECT d.doc_id, d.size, c5.source, c5.source_size, c5.target, c5.base, c5.f, c5.missing,
         CASE WHEN c5.f > 0 THEN (d.u / (1 - d.u)) / (c5.f / (1 - c5.f)) END AS q
  FROM d JOIN c5 ON d.source IS NOT DISTINCT FROM c5.source AND d.k = c5.k),
r AS (
  SELECT *, sum(CASE WHEN f > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM j)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN f > 0 AND upto - size / 2 <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    from veritext.llm.license_scan import templates

    known = templates()
    places = ", ".join(f"('{g}', {t}, {i}, {k.k})" for t, k in enumerate(known) for i, g in enumerate(k.grams))
    facts = ", ".join(f"({t}, {len(k.grams)}, {len(k.text.split(' '))}, {k.exact}, '{k.label}')" for t, k in enumerate(known))
    grams = " UNION ALL ".join(
        f"SELECT doc_id, unnest(range(0, len(w) - {k - 1})) AS pos, unnest(list_transform(range(1, len(w) - {k - 2}),"
        f" lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM d"
        for k in sorted({t.k for t in known})
    )
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p(gram, template, place, k) AS (VALUES {places}),
f(template, n_grams, length, exact, label) AS (VALUES {facts}),
g AS ({grams}),
a AS (
  SELECT doc_id, template, pos - place AS diagonal, list(place) AS places, min(place) AS low, max(place + k) AS high
  FROM g JOIN p USING (gram) GROUP BY ALL),
b AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER along > CASE WHEN exact THEN 0 ELSE 8 END, true) AS far
  FROM a JOIN f USING (template) WINDOW along AS (PARTITION BY doc_id, template ORDER BY diagonal)),
c AS (SELECT *, sum(far::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS nth FROM b),
m AS (
  SELECT doc_id, template, label, exact, n_grams, length, min(diagonal + low) AS start, max(diagonal + high) AS stop,
         len(list_distinct(flatten(list(places)))) AS held
  FROM c GROUP BY doc_id, template, nth, label, exact, n_grams, length),
v AS (
  SELECT *, held / n_grams AS share,
         CASE WHEN exact THEN held = n_grams ELSE held / n_grams >= 0.6 AND 2 * (stop - start) <= 3 * length END AS verified
  FROM m)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (verified AND exact) AS n_base,
       min(start) FILTER (verified AND exact) AS first_word, max(start) FILTER (verified AND exact) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND exact), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
       coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id, w
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.prefix_trie import prefix_trie, rebuild

    return prefix_trie(rebuild(_table(spark, sf_dir, "conversations")), "base").drop("digest")


OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h
  FROM t),
r AS (
  SELECT i.c, 1 AS part, t.pos, t.said FROM ids i JOIN t ON t.c = i.c - i.c % 5 AND t.pos <= i.h
  UNION ALL SELECT i.c, 2, t.pos, t.said FROM ids i JOIN t ON t.c = i.c AND t.pos > i.h),
q AS (SELECT i.c, coalesce(list(r.said ORDER BY part, pos) FILTER (part > 0), []) AS s FROM ids i LEFT JOIN r USING (c) GROUP BY i.c),
e AS (SELECT c, s[1:d] AS p, d AS depth, d = len(s) AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM q)),
n AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM e GROUP BY p, depth),
m AS (
  SELECT n.*, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(p[-1].text)) END AS saved,
         (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children
  FROM n)
SELECT m.conv_id, m.depth::BIGINT AS depth, (SELECT u.conv_id FROM n u WHERE u.depth = m.depth - 1 AND u.p = m.p[1:m.depth - 1]) AS parent_conv_id,
       m.n_convs, m.n_children, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN m x ON x.depth >= m.depth AND x.p[1:m.depth] = m.p
GROUP BY ALL
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritext.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_language_id": op2_language_id,
        "op3_pii_pseudonyms": op3_pii_pseudonyms,
        "op4_html_text": op4_html_text,
        "op5_token_files": op5_token_files,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_packing": op7_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_mixing": op9_mixing,
        "op10_toxicity": op10_toxicity,
        "op11_license_scan": op11_license_scan,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": OP1_SQL,
        "op6_minhash_dedup": OP6_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_mixing": OP9_SQL,
        "op11_license_scan": _op11_sql(),
        "op12_prefix_trie": OP12_SQL,
    }
