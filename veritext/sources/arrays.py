"""Files that are one JSON array, read by byte ranges in many tasks and written by streaming, as Python data sources.

Reading: a file is cut into byte ranges. Where a range lies (in a string or not, how deep, behind how
many items) depends on all bytes before, so files of several ranges are summed up first: each range
reports, for both cases of its start, how the state changes, and the few numbers of each range are
put one after another. A range then returns the items that begin in it, reading on behind its end
for the last one. Items are texts, parsed behind the source.

Writing: a task streams its rows into one file of a hidden name; the commit renames the files.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS); ``opened`` tells whether a
path is in one of them.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range at least, ranges at most (beyond, ranges grow), and bytes read at a time.
RANGE, RANGES, CHUNK = 64 << 20, 100_000, 4 << 20
SCHEMA = "file string, pos long, json string, error string"
_TOKEN = re.compile(rb'\\.|["\[\]{},]', re.DOTALL)


class InputError(ValueError):
    """An input has no rows, or isn't made of the objects it should be made of."""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; an error where pyarrow has none for it."""
    if path.startswith("file:") or path.startswith("/"):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//(?=/))?", "", path)
    return pafs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file of ``size`` bytes, and what lies before: in a string, depth, items begun, whether the array has begun."""

    file: str
    size: int
    start: int
    end: int
    inside: bool = False
    depth: int = 0
    pos: int = 0
    begun: bool = False


@dataclass
class Task(InputPartition):
    ranges: list[Range]

    def __init__(self, ranges: list[Range]):
        super().__init__(ranges)
        self.ranges = ranges


def _chunks(file: str, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) from ``start`` on; no chunk parts a backslash from what it escapes, and an escaped first byte is left out."""
    fs, path = opened(file)
    with fs.open_input_file(path) as f:
        back = start
        while back and f.read_at(1, back - 1) == b"\\":
            back -= 1
        at = start + (start - back) % 2
        f.seek(at)
        held = b""
        while at < size:
            got = f.read(CHUNK)
            chunk = held + got
            held = b"\\" if got and (len(chunk) - len(chunk.rstrip(b"\\"))) % 2 else b""
            chunk = chunk[: len(chunk) - len(held)] if held else chunk
            if not got and not chunk:
                return
            yield at, chunk
            at += len(chunk)


def changes(r: Range) -> dict:
    """How the state changes over a range: whether a string opens or ends, and for a start outside (0) and inside (1) of one the depth's change,
    brackets seen, and commas by depth, relative to the start's."""
    inside, depth, seen, commas = 0, [0, 0], [0, 0], (Counter(), Counter())
    for at, chunk in _chunks(r.file, r.start, r.size):
        for m in _TOKEN.finditer(chunk, 0, min(len(chunk), r.end - at)):
            c = chunk[m.start()]
            if c == 0x22:
                inside ^= 1
            elif c == 0x2C:
                commas[inside][depth[inside]] += 1
            elif c != 0x5C:
                depth[inside] += 1 if c in b"[{" else -1
                seen[inside] += 1
        if at + len(chunk) >= r.end:
            break
    return {"inside": inside, "depth": depth, "seen": seen, "commas": [dict(c) for c in commas]}


def items(r: Range) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(file, pos, json, error) for each item whose comma or bracket lies in the range; an error has pos -1."""
    inside, depth, pos, begun, item, held = r.inside, r.depth, r.pos, r.begun, None, []
    wrong = lambda why: (r.file, -1, None, why)
    last, mark, values = r.start, 0, 0

    def whole(chunk: bytes, i: int) -> str | None:
        """The item's text, null where it is more than one value, which a parser that stops behind the first one wouldn't notice."""
        text = b"".join([*held, chunk[mark:i]]).decode("utf-8", "replace")
        bare = text.strip()
        return text if values == 0 or (values == 1 and bare[0] in "{[" and bare[-1] in "}]") else None

    for at, chunk in _chunks(r.file, r.start, r.size):
        mark, last = 0, at + len(chunk)
        if not begun and not depth:
            first = chunk.lstrip()[:1]
            if first and first != b"[":
                yield wrong("isn't a JSON array")
                return
        outside = 0 if begun and not depth else None  # from where on the chunk lies behind the array
        for m in _TOKEN.finditer(chunk):
            i = m.start()
            c = chunk[i]
            if c == 0x5C:
                continue
            if c == 0x22:
                inside = not inside
                continue
            if inside or (outside is not None):
                continue
            here = at + i
            if c in b"[{":
                depth += 1
                if depth == 1:
                    begun = True
                    if here < r.end:
                        item, mark = 0, i + 1
            elif c in b"]}":
                depth -= 1
                if depth == 0:
                    if item is not None:
                        text = whole(chunk, i)
                        if item or text is None or text.strip():
                            yield r.file, item, text, None
                    item, held, outside, values = None, [], i + 1, 0
                elif depth == 1:
                    values += 1
            elif depth == 1:
                if item is not None:
                    yield r.file, item, whole(chunk, i), None
                item, held, pos, values = None, [], pos + 1, 0
                if here >= r.end:
                    return
                item, mark = pos, i + 1
        if outside is not None and chunk[outside:].strip():
            yield wrong("has more than one value")
            return
        if item is not None:
            held.append(chunk[mark:])
        elif last >= r.end and depth:
            return
    if last >= r.size and (depth or inside or not begun) and (item is not None or r.end == r.size):
        yield wrong("ends before its array does" if begun else "isn't a JSON array")


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[list[Range]]):
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        return [Task(r) for r in self.ranges]

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        names = ["file", "pos", "json", "error"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for r in partition.ranges:
            for row in items(r):
                rows.append(row)
                size += len(row[2] or "")
                if len(rows) == 1_000 or size > 8 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = opened(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.json"
        temporary, out = f"{root}/_{name}.{task.taskAttemptId()}", None
        for b in iterator:
            for text in b.column(0):
                if out is None:
                    fs.create_dir(root)
                    out = fs.open_output_stream(temporary)
                    out.write(b"[")
                else:
                    out.write(b",\n")
                out.write(text.as_buffer())
        if out is None:
            return _Written(None, None)
        out.write(b"]")
        out.close()
        return _Written(temporary, f"{root}/{name}")

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        done = [m for m in messages if m and m.name]
        for m in done:
            fs.move(m.temporary, m.name)
        if not done:
            fs.create_dir(root)
            with fs.open_output_stream(f"{root}/part-000000.json") as f:
                f.write(b"[]")

    def abort(self, messages: list) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m and m.temporary:
                fs.delete_file(m.temporary)


class ArraySource(DataSource):
    """Items of JSON-array files (option ranges), or one file of texts for each task (option path)."""

    @classmethod
    def name(cls) -> str:
        return "json_array_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader([[Range(*r) for r in task] for task in json.loads(self.options["ranges"])])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need nothing installed


def _states(spark: SparkSession, parts: list[Range]) -> None:
    """Fill in what lies before each range of files that have several, from one job over these ranges."""
    several = Counter(r.file for r in parts)
    asked = [(i, r.file, r.size, r.start, r.end) for i, r in enumerate(parts) if several[r.file] > 1]
    if not asked:
        return
    table = spark.createDataFrame(asked, "i long, file string, size long, start long, end long").repartition(min(len(asked), 4_096), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            said = [json.dumps(changes(Range(x["file"], x["size"], x["start"], x["end"]))) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x["i"] for x in rows], pa.int64()), pa.array(said, pa.string())], names=["i", "said"])

    found = {r.i: json.loads(r.said) for r in table.mapInArrow(run, "i long, said string").collect()}  # a few numbers for each range
    inside = depth = pos = begun = 0
    for i, r in enumerate(parts):
        if i not in found:
            continue
        if not r.start:
            inside = depth = pos = begun = 0
        r.inside, r.depth, r.pos, r.begun = bool(inside), depth, pos, bool(begun)
        x = found[i]
        pos += x["commas"][inside].get(str(1 - depth), 0)
        begun += x["seen"][inside]
        depth += x["depth"][inside]
        inside ^= x["inside"]


def array_items(spark: SparkSession, files: list[tuple[str, int]], least: int = RANGE) -> DataFrame:
    """(file, pos, json, error) of JSON-array files, given as (path, bytes); what is wrong with a file is a row with pos -1 and an error.

    Ranges are ``least`` bytes, more where that would make over ``RANGES`` of them; small files share a task.
    """
    least = max(least, sum(n for _, n in files) // RANGES)
    parts = [Range(f, n, at, min(at + least, n)) for f, n in sorted(files) for at in range(0, max(n, 1), least)]
    _states(spark, parts)
    tasks: list[list[Range]] = []
    size = least
    for r in parts:
        if not tasks or size + r.end - r.start > least:
            tasks.append([])
            size = 0
        tasks[-1].append(r)
        size += r.end - r.start
    if not tasks:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(ArraySource)
    told = json.dumps([[[r.file, r.size, r.start, r.end, r.inside, r.depth, r.pos, r.begun] for r in t] for t in tasks])
    return spark.read.format(ArraySource.name()).option("ranges", told).load()


def write_array_files(df: DataFrame, path: str, text: Column, key: Column, files: int) -> None:
    """``text`` (JSON) of each row in about ``files`` JSON-array files, dealt and ordered by a hash of ``key``; nothing is seen before all are written."""
    fs, root = opened(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise InputError(f"{path} is there already")
    df.sparkSession.dataSource.register(ArraySource)
    rows = df.select(F.xxhash64(key).alias("h"), text.alias("j"))
    rows = rows.repartitionByRange(files, "h").sortWithinPartitions("h", "j").select("j")
    rows.write.format(ArraySource.name()).mode("append").option("path", path).save()
