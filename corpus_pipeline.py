"""A training corpus from raw documents: clean, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next one's docs. Every stage works on all that its predecessor kept; all but the last
return the columns of documents.

* toxicity: documents that the classifier rejects go; it learns from all labels.
* exact_dedup: of equal texts, the row with the largest doc_id stays.
* near_dedup: of documents linked by five-word shingles at a similarity of 0.8 or more, the one
  with the smallest doc_id stays.
* mixing: a document is repeated as often as the mix takes it, or goes.
* packing: pieces of at most 2,048 tokens and their places in sequences.

A doc_id stands for one document: rows that repeat it share its fate, and where id and text are
both equal one row is left after exact_dedup. A null doc_id is an id like any other, and rows with
it are linked with nothing. A null text counts as an empty one. Texts are read whole, however long. An
empty table gives an empty table at every stage. Further columns of documents are carried through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm.common import free_name, materialise, new_dir, remove, rows_with_ids
from veritext.llm.exact_dedup import exact_dedup
from veritext.llm.minhash_dedup import near_duplicates
from veritext.llm.mixing import mix
from veritext.llm.packing import pack
from veritext.llm.toxicity import toxicity

#: Toxicity comes from training, so no SQL gives these rows; tests compare with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = toxicity(docs, labels, F.lit(True)).filter("predicted = 1").select("doc_id")
    return rows_with_ids(docs, rejected, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialise(exact_dedup(docs, keep="max").select("doc_id", "kept"), "stage-exact")
    dropped = found.groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).filter("not stays").select("doc_id")
    out = rows_with_ids(docs, dropped, "left_anti")
    again = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    # rows that repeat an id: the first of those that are equal
    single, nth = rows_with_ids(out, again, "left_anti"), free_name(docs, "_nth")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[c for c in docs.columns if c != "doc_id"])
    repeated = rows_with_ids(out, again, "left_semi").withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1)
    return single.unionByName(repeated.drop(nth))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs, words=5, percent=80).filter("not kept").select("doc_id")
    return rows_with_ids(docs, dropped, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ident, times = free_name(docs, "_id"), free_name(docs, "_copies")
    copies = mix(docs).groupBy(F.col("doc_id").alias(ident)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(ident)))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(ident)).drop(ident)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", path)
        if before:  # a stage's table is read by the next one only
            remove(spark, before)
        before = path
    return docs
