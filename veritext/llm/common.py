"""Helpers shared by the training-data operators: shared storage, Arrow settings, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.shared import shared_path

#: Runs of anything but these six characters are words (space, tab, newline, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"

#: So many ids may be broadcast; as a hash table they take about 100 bytes each.
BROADCAST_IDS = 250_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_dir(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: what follows reads files that outlive any executor. The shuffle
    files behind the write aren't needed any more and are released when it ends.
    """
    spark = df.sparkSession
    path = path or new_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500, mb: int = 32) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes; long texts make the default of 10,000 rows too large.

    Tables are evaluated after the operator returns, so the setting stays with the session; a
    smaller one that is there already is left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it, be it in another case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each vertex of ``edges`` (columns a, b, both long and not null).

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A round is a grouped
    minimum, combined on the map side, and a join back on the vertex. Hot vertices, those with more
    than a thousandth of all edges, are 2,000 at most by counting; their minima are broadcast, so that
    their edges are neither shuffled by the vertex nor meet in one task. Each round is a written
    table, and the vertex with most edges is looked up in it, so that rounds without a hot vertex join
    plainly. Returns (id, component); ids without edges don't occur.
    """
    e = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )

    def mark(t: DataFrame):
        return t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(e)
    # few edges need few tasks, whatever the number of shuffle partitions
    few = lambda t: t.coalesce(max(1, -(-seen[0] // 100_000)))

    def with_least(t: DataFrame, least: DataFrame) -> DataFrame:
        """(u, v, m) for the rows of t, m from least (u, m, n), n the number of edges at u."""
        if most <= many:  # no vertex is hot, here or in what a round makes of the edges
            return t.join(least.select("u", "m"), "u").select("u", "v", "m")
        hot = least.filter(F.col("n") > many).select(F.col("u").alias("h"), F.col("m").alias("hm"))
        marked = t.join(F.broadcast(hot), F.col("u") == F.col("h"), "left")
        cold = marked.filter("h is null").select("u", "v").join(least.select("u", "m"), "u")
        return marked.filter("h is not null").select("u", "v", F.col("hm").alias("m")).union(cold.select("u", "v", "m"))

    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = max(500, seen[0] // 1000)
        most = both.groupBy("u").count().agg(F.max("count")).first()[0] if seen[0] > many else 0
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.filter("u <> v").distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = with_least(large, least)
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        e = materialise(few(small), name)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def more_components(comp: DataFrame, links: DataFrame, name: str = "cc") -> DataFrame:
    """``comp`` (id, component) after more ``links`` (a, b): only links between components go through the rounds again."""
    of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias("c" + c))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = materialise(connected_components(between, name), name + "-joined").toDF("root", "least")
    old = comp.join(joined, F.col("component") == F.col("root"), "left").select("id", F.coalesce("least", "component").alias("component"))
    new = joined.join(comp, F.col("root") == F.col("id"), "left_anti").select(F.col("root").alias("id"), F.col("least").alias("component"))
    return old.union(new)


def rows_with_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or isn't (``left_anti``) among ``ids``'s only column; null is an id.

    The ids go to every executor only after a count showed that they are at most ``most`` (about
    25 MB); more of them are joined by a shuffle. ``docs`` may have columns of any names.
    """
    name = free_name(docs, "_id")
    ids = materialise(ids.toDF(name).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(side, F.col(id_col).eqNullSafe(F.col(name)), how)
