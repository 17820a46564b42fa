"""A published dataset that grows by parts, with an index of its unique values, so that a new part isn't compared with all rows again.

Under ``root``: ``rows`` (a folder for each part), ``keys`` (128-bit hashes of each unique field's values with
their first place) and ``bloom`` (bitmaps of these hashes), the last two in folders of buckets by hash, about ten thousand keys
of the first part to each and ``BUCKETS`` at most; their number is the name of a file in ``buckets``. A new
part looks into the bitmaps of the buckets that its values fall into, and into the keys of those buckets
only where a bitmap doesn't rule a value out. A part is visible once its number is in ``parts``, which is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.shared import written
from veritext.operators.dedup import DuplicateError

BUCKETS, _KEYS_EACH = 4_096, 10_000
#: Keys that share a bitmap of 32,768 bits, of which each sets two: some 1.4 % of other values aren't ruled out.
_SHARE = 2_048
_KEYS = "field string, h long, g long, file string, pos long, bucket int, part int"
_BLOOM = "field string, block int, blocks int, bits binary, bucket int, part int"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _named(spark: SparkSession, folder: str) -> list[int]:
    store, at = _path(spark, folder)
    return sorted(int(s.getPath().getName()) for s in store.listStatus(at)) if store.exists(at) else []


def _mark(spark: SparkSession, path: str) -> None:
    store, at = _path(spark, path)
    store.create(at, False).close()


def parts(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the parts that are visible."""
    return _named(spark, f"{root}/parts")


def read(spark: SparkSession, root: str) -> DataFrame:
    """All visible rows."""
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/rows/{p}" for p in parts(spark, root)])


def _hashed(rows: DataFrame, unique: tuple[str, ...], file: Column, pos: Column, buckets: int = 1) -> DataFrame:
    """(field, value, h, g, file, pos, bucket) for each non-null value of each unique field."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in unique])
    x = rows.select(F.explode(pairs).alias("x"), file.cast("string").alias("file"), pos.cast("long").alias("pos")).select("x.*", "file", "pos").filter("value is not null")
    x = x.withColumns({"h": F.xxhash64("field", "value"), "g": F.xxhash64(F.lit(1), "field", "value")})
    return x.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(h, 12), blocks).cast("int")


def _bits() -> Column:
    """The two places of a value in its bitmap, from its second hash."""
    return F.array(*[F.shiftrightunsigned("g", 15 * k).bitwiseAND(F.lit(32_767)).cast("long") for k in (0, 1)])


def _in_buckets(table: DataFrame, buckets: DataFrame, seen: list[int]) -> DataFrame:
    """Rows of ``table`` in these buckets (``BUCKETS`` at most come to the driver), so that other folders aren't listed or read."""
    return table.filter(F.col("bucket").isin([r.bucket for r in buckets.select("bucket").distinct().collect()]) & F.col("part").isin(seen))


def known_before(spark: SparkSession, root: str, values: DataFrame) -> DataFrame:
    """``values`` (as ``_hashed`` makes them) that visible parts hold already, with first_file and first_pos."""
    seen, none = parts(spark, root), {"first_file": F.lit(None).cast("string"), "first_pos": F.lit(None).cast("long")}
    if not seen:
        return values.limit(0).withColumns(none)
    bloom = _in_buckets(spark.read.schema(_BLOOM).parquet(f"{root}/bloom"), values, seen)
    sizes = bloom.select("field", "bucket", "part", "blocks").distinct()
    asked = values.join(sizes, ["field", "bucket"]).withColumn("block", _block(F.col("h"), F.col("blocks")))
    maybe = asked.join(bloom.select("field", "bucket", "part", "block", "bits"), ["field", "bucket", "part", "block"])
    bit = lambda p: F.conv(F.hex(F.substring("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) != 0
    maybe = maybe.withColumn("_p", _bits()).filter(bit(F.get("_p", F.lit(0))) & bit(F.get("_p", F.lit(1))))
    maybe = written(maybe.select(*values.columns).distinct(), "maybe-known")
    if maybe.isEmpty():
        return maybe.withColumns(none)
    keys = _in_buckets(spark.read.schema(_KEYS).parquet(f"{root}/keys"), maybe, seen)
    first = F.min(F.struct("part", "file", "pos"))
    found = maybe.select("field", "h", "g").distinct().join(keys, ["field", "h", "g"]).groupBy("field", "h", "g").agg(first.alias("f"))
    return maybe.join(found.select("field", "h", "g", F.col("f.file").alias("first_file"), F.col("f.pos").alias("first_pos")), ["field", "h", "g"])


def append(rows: DataFrame, root: str, file: Column, pos: Column, unique: tuple[str, ...] = ("id", "syllogism")) -> int:
    """Publish ``rows`` as the next part, whose number is returned; a value of a ``unique`` field that is there already, in this part or before, is a DuplicateError.

    ``file`` and ``pos`` say where a row comes from. Null values occur any number of times. What is read of earlier parts
    are the bitmaps and, for values they don't rule out, the keys of the new part's buckets. One writer at a time.
    """
    spark = rows.sparkSession
    number = max(parts(spark, root), default=-1) + 1
    buckets = _named(spark, f"{root}/buckets")
    if not buckets:
        buckets = [1 << max(3, min(BUCKETS, rows.count() * len(unique) // _KEYS_EACH).bit_length())]
        _mark(spark, f"{root}/buckets/{buckets[0]}")
    values = written(_hashed(rows, unique, file, pos, buckets[0]), "new-values")
    again = values.groupBy("field", "h", "g").agg(F.count("*").alias("n"), F.min("value").alias("value")).filter("n > 1").select("field", "value")
    first = again.union(known_before(spark, root, values).select("field", "value")).groupBy("field").agg(F.min("value").alias("value")).collect()
    for c in unique:
        for r in first:
            if r.field == c:
                raise DuplicateError(f"{c} isn't unique: {r.value!r}")
    tagged = values.withColumn("part", F.lit(number))
    by_bucket = {"partitionBy": ["bucket", "part"], "mode": "append"}
    tagged.select(*[c.split()[0] for c in _KEYS.split(", ")]).repartition("bucket").sortWithinPartitions("bucket", "field", "h").write.parquet(f"{root}/keys", **by_bucket)
    sizes = tagged.groupBy("field", "bucket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / _SHARE)).cast("int").alias("blocks"))
    placed = tagged.join(sizes, ["field", "bucket"]).withColumn("block", _block(F.col("h"), F.col("blocks")))
    bloom = placed.select("field", "block", "blocks", "bucket", "part", F.explode(_bits()).alias("p"))
    bloom = bloom.groupBy("field", "block", "blocks", "bucket", "part").agg(F.bitmap_construct_agg("p").alias("bits"))
    bloom.select(*[c.split()[0] for c in _BLOOM.split(", ")]).repartition("bucket").write.parquet(f"{root}/bloom", **by_bucket)
    rows.write.mode("overwrite").parquet(f"{root}/rows/{number}")
    _mark(spark, f"{root}/parts/{number}")
    return number


def later_places(rows: DataFrame, root: str, file: Column, pos: Column, unique: tuple[str, ...] = ("id", "syllogism")) -> DataFrame:
    """(field, value, file, pos, first_file, first_pos) of values of ``rows`` that visible parts hold already, with their first place there."""
    spark = rows.sparkSession
    values = written(_hashed(rows, unique, file, pos, *_named(spark, f"{root}/buckets")), "new-values")
    return known_before(spark, root, values).select("field", "value", "file", "pos", "first_file", "first_pos")
