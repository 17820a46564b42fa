"""Reading JSON datasets with the types that they really have, and writing them.

A loose reader must tell an absent key from an explicit null, and a boolean from the word "yes", so
values are kept as VARIANT until they are asked for by type. A file that is one JSON array is read
in byte ranges by several tasks (``arrays``); only in a store that pyarrow can't open, and in the
other loose forms, is a file one string in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from veritext.functions import text as T
from veritext.sources import arrays
from veritext.sources.arrays import InputError

#: Keys under which a container may hold its rows, in the order in which they are tried.
CONTAINERS = ("data", "examples", "train", "validation", "items")


def _kind(v: Column) -> Column:
    """The JSON type of a variant: OBJECT<...>, ARRAY<...>, STRING, BOOLEAN, BIGINT, ..., VOID for null; SQL null where absent."""
    return F.schema_of_variant(v)


def _files(spark: SparkSession, paths: str | list[str], name: str | None) -> list[tuple[str, int]]:
    """(path, bytes) of all files in ``paths``, in directories as well."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:  # a path that is named twice is read twice
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        try:
            found += (listed.option("pathGlobFilter", name) if name else listed).load(path).select("path", "length").collect()
        except AnalysisException as e:
            raise InputError(f"no such path: {path}") from e
    return [(r.path, r.length) for r in found]


def _array_items(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(file, pos, v, error): items of array files in ranges; of stores that pyarrow can't open, whole files."""
    try:
        for f, _ in files:
            arrays.opened(f)
    except (OSError, ValueError, ImportError):
        raw = spark.read.text([f for f, _ in files], wholetext=True)
        doc = raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
        is_array = F.coalesce(_kind(F.col("doc")).startswith("ARRAY"), F.lit(False))
        doc = doc.withColumn("a", F.when(is_array, F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant"))))
        out = doc.select("file", is_array.alias("fine"), F.posexplode("a").alias("pos", "v"))
        pos = F.when(F.col("fine"), F.col("pos")).otherwise(-1).cast("long")
        return out.select("file", pos.alias("pos"), "v", F.when(~F.col("fine"), "isn't a JSON array").alias("error"))
    rows = arrays.array_items(spark, files)
    return rows.select("file", "pos", F.try_parse_json("json").alias("v"), "error")


def read_arrays(spark: SparkSession, paths: str | list[str], check: bool = True, name: str | None = "*.json") -> DataFrame:
    """(file, pos, v): the items of JSON-array files, found in directories as well; v is a VARIANT.

    A file that isn't an array, or an item that isn't an object, is an error with ``check``, and left
    out without (such an item is null or what it is); finding no file always is an error. Large files are read
    in ranges by several tasks; a wrong file may give those of its items that were read before the fault.
    """
    files = _files(spark, paths, name)
    if not files:
        raise InputError(f"no {name or 'file'} in {paths}")
    rows = _array_items(spark, files)
    if check:
        _checked(rows)
    return rows.filter("error is null").select("file", "pos", "v")


def _checked(rows: DataFrame) -> None:
    """The first wrong file, or item that isn't an object, is an error."""
    bad = rows.filter(F.col("error").isNotNull() | ~F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False))).select("file", "pos", "error")
    for r in bad.limit(1).collect():
        raise InputError(f"{r.file} {r.error}" if r.error else f"item {r.pos} of {r.file} isn't an object")


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """(pos, v) from a flexible file: lines of objects (.jsonl), an array, an object that holds an array under a known key,
    or one object. An empty file has no rows; anything else is an error. Lines and arrays are read by several tasks."""
    if path.rstrip("/").endswith(".jsonl"):
        lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("pos", F.monotonically_increasing_id())
        return _objects(lines.select("pos", F.try_parse_json("value").alias("v")), path)
    files = _files(spark, path, None)
    rows = _array_items(spark, files)
    if files and rows.filter("error is not null").isEmpty():
        _checked(rows)
        return rows.select("pos", "v")
    doc = spark.read.text(path, wholetext=True).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    doc = doc.select(F.try_parse_json("value").alias("doc"))
    if not doc.filter(~F.coalesce(_kind(F.col("doc")).rlike("^(ARRAY|OBJECT)"), F.lit(False))).isEmpty():
        raise InputError(f"{path} is neither an array nor an object")
    inside = [F.try_variant_get("doc", f"$.{k}", "variant") for k in CONTAINERS]
    found = F.coalesce(*[F.when(_kind(x).startswith("ARRAY"), x) for x in inside], F.when(_kind(F.col("doc")).startswith("ARRAY"), F.col("doc")))
    items = F.when(found.isNotNull(), F.try_variant_get(found, "$", "array<variant>")).otherwise(F.array("doc"))
    return _objects(doc.select(F.posexplode(items).alias("pos", "v")).select(F.col("pos").cast("long").alias("pos"), "v"), path)


def _objects(items: DataFrame, path: str) -> DataFrame:
    """``items`` (pos, v), all of which must be objects."""
    bad = items.filter(~F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False))).select("pos").limit(1).collect()
    if bad:
        raise InputError(f"item {bad[0].pos} of {path} isn't an object")
    return items


def field(v: Column, name: str, kind: str) -> Column:
    """A field of a variant if it is of this JSON type (string, boolean, bigint, ...), else null."""
    is_kind = _kind(F.try_variant_get(v, f"$.{name}", "variant")) == kind.upper()
    return F.when(is_kind, F.try_variant_get(v, f"$.{name}", kind))


def has_field(v: Column, name: str) -> Column:
    """The key is there, be its value null."""
    return F.try_variant_get(v, f"$.{name}", "variant").isNotNull()


def loose_label(v: Column, name: str, absent: str | None = None) -> Column:
    """A label as a key: true, false, the value as it stands, null where it is null or, without ``absent``, not there."""
    raw = F.try_variant_get(v, f"$.{name}", "variant")
    said = F.when(_kind(raw) == "VOID", F.lit(None).cast("string")).otherwise(T.label_key(F.try_variant_get(v, f"$.{name}", "string")))
    return said if absent is None else F.when(raw.isNull(), F.lit(absent)).otherwise(said)


def loose_indexes(v: Column, name: str = "relevant_premises", fallback: str = "relevant") -> Column:
    """An index list: a list of ints, or the digit runs of a string; the fallback key counts only where the first is absent."""

    def of(key: str) -> Column:
        raw = F.try_variant_get(v, f"$.{key}", "variant")
        as_list = F.try_variant_get(v, f"$.{key}", "array<int>")
        text = F.when(_kind(raw) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
        return F.when(_kind(raw).startswith("ARRAY"), F.coalesce(as_list, F.array().cast("array<int>"))).otherwise(T.index_list(text))

    return F.when(has_field(v, name), of(name)).otherwise(of(fallback))


def base_rows(items: DataFrame) -> DataFrame:
    """(base_index, id, syllogism, validity, plausibility) of the rows with a text and a boolean validity; none is an error."""
    v = F.col("v")
    out = items.select(
        F.col("pos").cast("long").alias("base_index"), field(v, "id", "string").alias("id"), field(v, "syllogism", "string").alias("syllogism"),
        field(v, "validity", "boolean").alias("validity"), field(v, "plausibility", "boolean").alias("plausibility"),
    ).filter("syllogism is not null and validity is not null")
    if out.isEmpty():
        raise InputError("no row has a text and a boolean validity")
    return out


def read_training(spark: SparkSession, paths: list[str], schema: StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """Several JSON-array files, or folders of them, as one set with a stated schema.

    A file that isn't an array, an item that isn't an object, and an object without one of the ``required`` keys
    are errors, found in one reading before the rows are returned; a value of another type is null.
    """
    files = _files(spark, paths, None)
    if not files:
        raise InputError(f"no file in {paths}")
    rows = arrays.array_items(spark, files).withColumn("v", F.try_parse_json("json"))
    _checked(rows)
    absent = reduce(lambda a, b: a | b, [F.try_variant_get("v", f"$.{c}", "variant").isNull() for c in required], F.lit(False))
    for r in rows.filter(absent).select("file", "pos").limit(1).collect() if required else []:
        raise InputError(f"item {r.pos} of {r.file} lacks one of {', '.join(required)}")
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object for each line, UTF-8."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_arrays(df: DataFrame, path: str, key: Column, rows_per_file: int = 10_000) -> None:
    """JSON-array files of about ``rows_per_file`` rows each, UTF-8, dealt and ordered by a hash of ``key``.

    Rows are streamed into their file, however long they are, and the files are renamed when all are
    written. A table without rows gives one empty array.
    """
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    arrays.write_array_files(df, path, text, key, max(1, -(-df.count() // rows_per_file)))


def to_lines(spark: SparkSession, array_path: str, path: str, schema: StructType | str) -> None:
    """A JSON-array file, or a folder of them, as JSON lines."""
    write_lines(read_training(spark, [array_path], schema), path)


#: Stands for a quoted empty text while a CSV file is read, where null is an empty text without quotes.
_EMPTY = "\u0000empty\u0000"
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as CSV with a header and read back with its schema.

    Texts may hold quotes, line ends and outer white space; an empty text stays empty and null stays null.
    """
    df.write.options(**_CSV, emptyValue='""').csv(path)
    back = df.sparkSession.read.schema(df.schema).options(**_CSV, multiLine="true", emptyValue=_EMPTY).csv(path)
    texts = [f.name for f in df.schema.fields if f.dataType == StringType()]
    return back.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in texts})


def csv_to_lines(df: DataFrame, csv_path: str, path: str) -> None:
    """``df`` through CSV to JSON records, one a line."""
    write_lines(csv_round_trip(df, csv_path), path)
