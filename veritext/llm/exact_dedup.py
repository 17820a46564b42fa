"""Exact deduplication by sorting contents (operator 8).

Texts are range-partitioned by sampled splitters and sorted inside each partition, so that
equal texts are neighbours; neighbours are compared in full. The splitters are a bounded key
(the text's first characters, a 64-bit hash of all of it, then the id), so a sampled splitter
stays small however long the texts are, and a group of copies of any size is spread over as
many partitions as it needs. A group that crosses a partition border shows up as the first or
last run of its partitions; only those border runs carry their text on, and runs with equal
texts are joined up (at most a few rows for each partition).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import materialise, small_batches

_OUT = "id long, keep_id long, group_size long, text_sha256 string, part int, run int, first boolean, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lead, h, text, id) to the same rows with their run's figures."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first_key = None
    run_no = 0
    open_runs: list[dict] = []  # runs that have the newest key; one, unless hashes collide

    def emit(runs: list[dict], edge: bool) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for r in runs:
            is_edge = edge or r["key"] == first_key
            ids, n = r["ids"], len(r["ids"])
            cols[0] += ids
            cols[1] += [ids[0]] * n
            cols[2] += [n] * n
            cols[3] += [r["sha"]] * n
            cols[4] += [part] * n
            cols[5] += [r["no"] if is_edge else None] * n
            cols[6] += [True] + [False] * (n - 1)
            cols[7] += [r["text"] if is_edge else None] + [None] * (n - 1)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            names=["id", "keep_id", "group_size", "text_sha256", "part", "run", "first", "edge_text"],
        )

    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, texts = b.column("id").to_pylist(), b.column("text")
        lead, h = b.column("lead"), b.column("h").to_pylist()
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or texts[0].as_py() != last
        starts = np.flatnonzero(new).tolist()
        if not starts or starts[0] != 0:
            open_runs[-1]["ids"] += ids[: starts[0] if starts else n]
        done: list[dict] = []
        for s, e in zip(starts, [*starts[1:], n]):
            key, text = (lead[s].as_py(), h[s]), texts[s].as_py()
            if first_key is None:
                first_key = key
            if open_runs and open_runs[-1]["key"] != key:
                done += open_runs
                open_runs = []
            sha = hashlib.sha256(text.encode()).hexdigest()
            open_runs.append({"key": key, "ids": ids[s:e], "sha": sha, "text": text, "no": run_no})
            run_no += 1
        last = texts[n - 1].as_py()
        if done:
            yield emit(done, False)
    if open_runs:
        yield emit(open_runs, True)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise`` (default: no change). The row with the
    largest (``keep="max"``) or smallest id stays.

    Defined cases: a null text counts as empty, so all null and empty texts are one group. A
    null id never stays beside others with an id; a group with null ids only has a null
    keep_id, and its first row is kept. Rows repeated with the same id and text are one group;
    exactly one of them has kept = true. An empty table gives an empty result. Columns other
    than the two are ignored, whatever their names.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(text) if normalise else text).alias("text"))
    base = base.select("id", "text", F.substring("text", 1, 24).alias("lead"), F.xxhash64("text").alias("h"))
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    dealt = base.repartitionByRange("lead", "h", order).sortWithinPartitions("lead", "h", "text", order)
    runs = materialise(dealt.mapInArrow(_runs, _OUT), "op8")
    edges = runs.filter("edge_text is not null").select("part", "run", "edge_text", "keep_id", "group_size")
    best = F.max if keep == "max" else F.min
    whole = edges.groupBy("edge_text").agg(
        best("keep_id").alias("w_keep"), F.sum("group_size").alias("w_size"), F.min(F.struct("part", "run")).alias("w_first")
    )
    # the border runs of each partition only: bounded by the number of partitions, not by the rows
    border = edges.join(whole, "edge_text").select(
        "part", "run", "w_keep", "w_size", (F.struct("part", "run") == F.col("w_first")).alias("w_is_first")
    )
    out = runs.join(F.broadcast(border), ["part", "run"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("w_keep", "keep_id").alias("keep_id"),
        F.coalesce("w_size", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("w_is_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )
