import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as S

import __spark_entry__ as entry
import corpus_pipeline
from veritext.llm import queries

SF = "/root/testdata/sf0.001"
DOCS = S.StructType([S.StructField(n, t) for n, t in (("doc_id", S.LongType()), ("text", S.StringType()), ("lang", S.StringType()), ("source", S.StringType()), ("n_chars", S.LongType()))])


def raw_corpus():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(600)]
    bad = ["grumblefoo", "nastybar", "vilebaz"]
    rows, toxic, labels = [], set(), []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randrange(20, 90))]
        if r.random() < 0.2:
            toxic.add(i)
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en", r.choice(["a", "a", "a", "b", None]), 0))
        labels.append((i, 1, int(i in toxic)))
    clean = [x for x in rows if x[0] not in toxic]
    rows += [(1000 + k, clean[k][1], "en", "b", 0) for k in range(40)]  # equal copies
    rows += [(2000 + k, clean[50 + k][1] + " extra", "en", "b", 0) for k in range(40)]  # near copies
    return rows + [(5000, None, None, None, None), (5001, "", "en", "a", 0)], toxic, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    rows, toxic, labels = raw_corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_take_effect(spark, folder):
    rows, toxic, _ = raw_corpus()
    text = {r[0]: r[1] or "" for r in rows}
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "t")
        assert docs.columns == DOCS.names
        kept.append(Counter(r.doc_id for r in docs.collect()))
    first, exact, near, mixed = kept
    assert set(text) - set(first) == toxic
    by = defaultdict(list)
    for i in first:
        by[text[i]].append(i)
    assert set(exact) == {max(g) for g in by.values()}
    assert {2000 + k for k in range(40)} & set(near) == set() and len(near) == len(exact) - 40
    assert set(near.values()) == {1} and set(mixed) <= set(near) and max(mixed.values()) <= 3
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_repeated_and_null_ids(spark, folder):
    rows = [(1, "a b c", "en", "s", 0)] * 3 + [(None, "x y z", "en", "s", 0), (None, None, None, None, None), (2, "a b c", "en", "t", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.drop_copies(spark, docs, folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "x y z"), (2, "a b c")]
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id is null"), folder).count() == 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs.filter("doc_id = 1"), folder).collect()) == [1]


def test_clashing_names_and_empty_tables(spark, folder):
    names = ["_id", "_ID_", "_nth", "_copies", "_k", "id", "kept", "copies", "src", "piece"]
    rows = [(1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (2, "a b c", "en", "t", 0), (3, None, None, None, None), (None, "x y", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], S.StructType([*DOCS.fields, *[S.StructField(n, S.IntegerType()) for n in names]]))
    for start in (docs, docs.limit(0)):
        d = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = corpus_pipeline.materialise(stage(spark, d, folder), "t")
            assert d.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, d, folder)
        assert (packed.count() > 0) == (start is docs)


def test_registered_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in c.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want))
