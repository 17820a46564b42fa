"""Best-fit packing by exact-complement hashing (operator 7).

Documents are cut into pieces of at most ``capacity`` ids (the first piece takes the remainder),
and pieces are put into sequences of ``capacity``. A packing depends on lengths only, and there
are no more than ``capacity`` of those, so it is planned on the histogram: for each length, from
the longest, the gap it leaves is looked up among single lengths, sums of two and sums of three,
and as many copies of a combination that fills it exactly are made as the counts allow. What has
no exact complement is placed by best fit, decreasing. The plan is a list of (contents, how many
sequences); every entry uses some length up, so it has a few thousand entries at any input size.
Spark then ranks the pieces of each length and each finds its place in the plan by its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import materialise, small_batches
from veritext.llm.tokens import END_ID, default_tokenizer, encoder, text_groups

_PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END_ID], dtype="<u4")
        for b in batches:
            texts = b.column("text").to_pylist()
            names = b.column("id").to_pylist()
            for lo, hi in text_groups(texts):
                flat, at = enc(texts[lo:hi])
                flat = flat.astype("<u4")
                rows: list[tuple] = []
                for i in range(hi - lo):
                    ids = np.concatenate([flat[at[i] : at[i + 1]], end])
                    n = len(ids)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(names[lo + i], k, s, e - s, zlib.crc32(ids[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def plan_packing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for ``counts[length]`` pieces of each length."""
    left = np.asarray(counts, dtype=np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in combo:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= times * k
            plan.append((combo, times))

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """Two lengths at hand, the larger first, that add up to total; the most uneven such two."""
        a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        ok = a[(left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1))] if len(a) else a
        return (int(ok[-1]), total - int(ok[-1])) if len(ok) else None

    if left[capacity]:
        take((capacity,))
    for big in range(capacity - 1, 0, -1):
        gap = capacity - big
        while left[big] > 0:
            left[big] -= 1  # this length's own piece isn't at hand for its complement
            found: tuple[int, ...] | None = (gap,) if gap <= big and left[gap] > 0 else pair(gap, big)
            if not found and big * 3 >= gap:
                have = np.flatnonzero(left[: big + 1])
                sums = np.zeros(gap + 1, dtype=bool)  # index of the sums of two lengths at hand
                for x in have[have < gap]:
                    y = have[have <= gap - x] + x
                    sums[y] = True
                for a in have[(have < gap)][::-1]:
                    if sums[gap - a]:
                        left[a] -= 1
                        two = pair(gap - int(a), int(a))
                        left[a] += 1
                        if two:
                            found = (int(a), *two)
                            break
            left[big] += 1
            before = int(left[big])
            if found:
                take((big, *found))
            if not found or left[big] == before:
                break
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: equal sequences are one class that is split only where it must be."""
    gaps: list[int] = []
    classes: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, what: tuple[int, ...], times: int) -> None:
        if gap not in classes:
            classes[gap] = []
            insort(gaps, gap)
        classes[gap].append((what, times))

    done: list[tuple[tuple[int, ...], int]] = []
    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            k = bisect_left(gaps, x)
            if k < len(gaps):
                gap = gaps[k]
                what, times = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap]
                    gaps.pop(k)
                m = min(n, times)
                if times > m:
                    put(gap, what, times - m)
                n -= m
            else:
                each = min(n, capacity // x)
                m, gap, what = n // each, capacity, ()
                n -= m * each
                what, gap = (x,) * (each - 1), capacity - (each - 1) * x
            if gap == x:
                done.append(((*what, x), m))
            else:
                put(gap - x, (*what, x), m)
    return done + [c for g in gaps for c in classes[g]]


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its entries in the order of rank: first rank, first sequence, copies in one sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for what, times in plan:
        at = 0
        ordered = sorted(what, reverse=True)
        for x in dict.fromkeys(ordered):
            k = ordered.count(x)
            rows.setdefault(x, []).append((int(ranks[x]), sequence, k, at))
            ranks[x] += k * times
            at += k * x
        sequence += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in rows.items()}


def _place(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                here = length == x
                first, base, k, at = places[int(x)]
                e = np.searchsorted(first, rank[here], side="right") - 1
                slot = rank[here] - first[e]
                seq[here] = base[e] + slot // k[e]
                off[here] = at[e] + slot % k[e] * x
            keep = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of one length are ranked by (salt, id, piece) with at most about 20,000 rows to a
    salt, so a length that a third of all pieces share is spread over many tasks.

    Defined cases: a null or empty text is one piece of the end id alone; a null id is carried
    on; rows that repeat an id are packed each by itself; an empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    pieces = materialise(base.mapInArrow(_pieces(path, capacity), _PIECE), "op7")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row for each length: capacity at most
        counts[row["length"]] = row["count"]
    places = _places(plan_packing(counts, capacity), capacity)
    salts = max(64, int(counts.sum()) // 20_000 + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(salts)))
    over = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(over), F.lit(0)))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside) - 1).join(
        before.select("length", "salt", "before"), ["length", "salt"]
    )
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("nth")).cast("long"))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    placed = ranked.mapInArrow(_place(places), _PIECE + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
