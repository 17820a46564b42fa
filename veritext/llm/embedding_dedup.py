"""Near-duplicate embeddings by a subspace pigeonhole join (operator 1).

Vectors are scaled to length one and turned by a fixed random rotation, which spreads their
energy evenly over the axes. Two of them at cosine c are at squared distance 2 - 2c. Cut into
``blocks`` blocks, some block of such a pair holds at most its proportional share of it (the
pigeonhole principle). So each block is range-joined by itself under the share: vectors are put
into the cells of a grid over the block's first two axes, and a vector is shown to its own cell and to
those of the four cells ahead of it whose border is within the range, so that each pair that may be
near meets once. Cells are ``span`` ranges wide: one range where a label has many vectors, more where
a cell of that width would still fit a tile, as wide cells show fewer vectors twice. Inside a task rows
are cut into cells of one range on all of the block's axes, one after the other, for as long as many pairs
are left, and only parts that are one cell away at most go on together. Block distances sieve the pairs,
and survivors are checked on the whole vectors in double precision. Whole vectors are shipped, not
blocks of them: fetching them for the survivors would emit all pairs of a group of near copies.

A pair that is near in several blocks is counted in the first of them only, so no pair has to be
shuffled or made distinct: a cell gives each vector's number of links there and, for the
components, a spanning forest of its links. Equal vectors are one class with a weight. A cell's
own vectors and those from behind it are dealt to tiles of about ``tile`` vectors, and each pair
of tiles meets in a place of its own, so no task holds more than two tiles at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import connected_components, materialise, small_batches

_FEW = 32_768  # pairs of vectors that are compared without another look at their cells
_SLACK = 1e-9  # the sieve may keep a little more than the range; the last check decides


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(7_001 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    cut = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(cut, cut[1:]))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # squares of large components stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _share(total: float, lo: int, hi: int, dim: int, slack: float = _SLACK) -> float:
    """The squared distance that a pair may have in a block."""
    return total * (hi - lo) / dim + slack


def _ahead(lo: int, hi: int) -> list[tuple[int, int]]:
    """Steps to the cells ahead."""
    return [(1, -1), (1, 0), (1, 1), (0, 1)] if hi - lo > 1 else [(1, 0)]


def _range(threshold: float, lo: int, hi: int, dim: int) -> float:
    """How far apart a near pair may be on an axis of a block."""
    return math.sqrt(_share(2 - 2 * threshold, lo, hi, dim, 3 * _SLACK))


def _spread(blocks: int, threshold: float, kind: str, bare: bool = False):
    """(rep, label, w, span, vec) to a row for each block and cell: own cell (side 0) and cells ahead within range (side 1).

    bare: without the vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vecs = b.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes).tolist():  # vectors of other sizes are other groups
                at = np.flatnonzero(sizes == size)
                x = _unit([vecs[i] for i in at], kind)
                dim = x.shape[1]
                x = x @ rotation(dim)
                span = b.column("span").to_numpy(zero_copy_only=False)[at].astype(np.float64)[:, None]
                for k, (lo, hi) in enumerate(_edges(dim, blocks)):
                    reach = _range(threshold, lo, hi, dim)
                    y = x[:, lo : min(lo + 2, hi)] / (reach * span)
                    y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
                    own = np.floor(y)
                    up = own + 1 - y <= (1 + 1e-6) / span  # within range of the cell above, on each axis
                    down = y - own <= (1 + 1e-6) / span
                    for p, q in [(0, 0), *_ahead(lo, hi)]:
                        near = np.ones(len(at), dtype=bool)
                        for axis, step in enumerate((p, q)):
                            near &= up[:, axis] if step > 0 else down[:, axis] if step < 0 else True
                        to = np.flatnonzero(near)
                        n = len(to)
                        if not n:
                            continue
                        rows = b.take(pa.array(at[to]))
                        cols = [
                            rows.column("rep"), rows.column("label"), rows.column("w"), pa.nulls(n, pa.binary()) if bare else rows.column("vec"),
                            pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, k), pa.int32()),
                            pa.array(own[to, 0].astype(np.int64) + p, pa.int64()), pa.array(own[to, 1].astype(np.int64) + q, pa.int64()),
                            pa.array(np.full(n, int(bool(p or q))), pa.int32()),
                        ]
                        yield pa.RecordBatch.from_arrays(cols, names=_CELL)

    return run


_CELL = ["rep", "label", "w", "vec", "dim", "block", "x", "y", "side"]


def _meetings(cells: np.ndarray, mine: int, same: bool, few: int = _FEW) -> Iterator[tuple[int, int, int, int, bool]]:
    """Ranges of rows that may be near to each other: (from, to, from, to, whether both are the same range).

    ``cells``: the cells of one range on all axes of a block, the first ``mine`` rows and the others each in
    ascending order. Both are cut on one axis after the other, and a part goes on with the other's parts that
    are one cell away at most, until a pair of parts has ``few`` pairs of rows or no axis is left. Rows that
    share their cells on the first axes stand together, so parts are ranges. ``same``: pairs inside mine
    count too, each once.
    """
    axes = cells.shape[1]
    parts: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}

    def cut(lo: int, hi: int, axis: int) -> tuple[list[int], list[int]]:
        if (lo, hi, axis) not in parts:
            c = cells[lo:hi, axis]
            at = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
            parts[lo, hi, axis] = c[at].tolist(), [*(at + lo).tolist(), hi]
        return parts[lo, hi, axis]

    todo = [(0, mine, 0, mine, 0)] if same else []
    todo.append((0, mine, mine, len(cells), 0))
    while todo:
        a, b, c, d, axis = todo.pop()
        alone = a == c
        if b - a < 1 + alone or d == c:
            continue
        if axis == axes or (b - a) * (d - c) <= few:
            yield a, b, c, d, alone
            continue
        (left, p), (right, q) = cut(a, b, axis), cut(c, d, axis)
        j = 0
        for i, at in enumerate(left):
            while j < len(right) and right[j] < at - 1:
                j += 1
            for k in range(i if alone else j, len(right)):
                if right[k] > at + 1:
                    break
                todo.append((p[i], p[i + 1], q[k], q[k + 1], axis + 1))


def _compare(blocks: int, threshold: float, kind: str):
    """Rows sorted by group to (kind 0: rep, links) and (kind 1: rep, other rep)."""
    total = 2 - 2 * threshold

    def cell(dim: int, block: int, side: np.ndarray, rep: np.ndarray, w: np.ndarray, x: np.ndarray, out: tuple) -> None:
        # side: 0 own rows, 1 rows from a cell behind; where tiles meet, 3 the first tile's rows, 2 the second's
        spans = _edges(dim, blocks)
        lo, hi = spans[block]
        same = bool((side < 2).all())
        turned = x @ rotation(dim)
        places = np.floor(turned[:, lo:hi] / _range(threshold, lo, hi, dim)).astype(np.int64)
        order = np.lexsort([*places.T[::-1], side != (0 if same else 3)])
        rep, w, x, places = rep[order], w[order], x[order], places[order]
        turned = turned[order]
        part = turned[:, lo:hi]
        square, ones = (part * part).sum(1)[:, None], np.ones((len(rep), 1))
        to, of = np.hstack([-2 * part, square, ones]), np.hstack([part, ones, square])  # their product is the squared distance
        most = _share(total, lo, hi, dim, 2 * _SLACK)
        tree = np.arange(len(rep))  # vectors with equal entries are connected by what was found so far
        links = np.zeros(len(rep), dtype=np.int64)
        for begin, end, begin2, end2, alone in _meetings(places, int((side == (0 if same else 3)).sum()), same):
            for p in range(begin, end, 512):
                row = np.arange(p, min(p + 512, end))
                for c in range(p if alone else begin2, end2, 2048):
                    against = np.arange(c, min(c + 2048, end2))
                    near = to[p : row[-1] + 1] @ of[c : against[-1] + 1].T <= most
                    if alone:  # inside the part each pair once
                        near &= against[None, :] > row[:, None]
                    i, j = np.nonzero(near)
                    for q in range(0, len(i), 200_000):
                        r, s = row[i[q : q + 200_000]], against[j[q : q + 200_000]]
                        ok = np.einsum("ij,ij->i", x[r], x[s]) >= threshold
                        r, s = r[ok], s[ok]
                        if not len(r):
                            continue
                        gap = (turned[r] - turned[s]) ** 2
                        first = gap[:, lo:hi].sum(1) <= _share(total, lo, hi, dim)
                        for lo2, hi2 in spans[:block]:
                            first &= gap[:, lo2:hi2].sum(1) > _share(total, lo2, hi2, dim)
                        r, s = r[first], s[first]
                        links += np.bincount(r, w[s], len(rep)).astype(np.int64) + np.bincount(s, w[r], len(rep)).astype(np.int64)
                        turn = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else []
                        for u, v in zip(turn, [*turn[1:], len(r)]):
                            met, at = np.unique(tree[s[u:v]], return_index=True)
                            new = met != tree[r[u]]
                            if new.any():
                                out[2].append(np.full(int(new.sum()), rep[r[u]]))
                                out[3].append(rep[s[u:v][at[new]]])
                                tree[np.isin(tree, met[new])] = tree[r[u]]
        got = np.flatnonzero(links)
        out[0].append(rep[got])
        out[1].append(links[got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "dim", "block", "side", "rep", "w"]
        held: list | None = None
        for b in _then_none(batches):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                cols = [b.column(c).to_numpy(zero_copy_only=False) for c in names] + [b.column("vec").to_pylist()]
                if held is None:
                    held = cols
                else:
                    held = [np.concatenate([x, y]) for x, y in zip(held[:6], cols[:6])] + [held[6] + cols[6]]
            if held is None:
                continue
            g = held[0]
            cut = (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist() + ([len(g)] if b is None else [])
            at, out = 0, ([], [], [], [])
            for end in cut:
                side = held[3][at:end]
                if end - at > 1 and ((side == 0) | (side == 3)).any():
                    cell(int(held[1][at]), int(held[2][at]), side, held[4][at:end], held[5][at:end], _unit(held[6][at:end], kind), out)
                at = end
            held = [x[at:] for x in held]
            if out[0]:
                rep, n = np.concatenate(out[0]), np.concatenate(out[1])
                yield _batch(0, rep, n)
            if out[2]:
                yield _batch(1, np.concatenate(out[2]), np.concatenate(out[3]))

    return run


def _then_none(batches):
    yield from batches
    yield None


def _batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"]
    )


def _pack_vectors(kind: str):
    """Arrays of numbers to bytes; null where a vector can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("vec"):
                x = None
                if v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = (x + x.dtype.type(0)).tobytes() if np.isfinite(x).all() and x.any() else None  # -0 as 0
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    return run


def _with_numbers(classes: DataFrame) -> tuple[DataFrame, int | None]:
    """Classes with a number ``rep`` of their own: the smallest id or, where several classes share that, one above all ids.

    Also the largest id if there are such classes.
    """
    shared = materialise(classes.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("shared")), "op1-shared")
    if shared.isEmpty():
        return classes.withColumn("rep", F.col("id")), None
    top = classes.agg(F.max("id")).first()[0]
    fresh = F.lit(top) + 1 + F.monotonically_increasing_id()
    marked = classes.join(shared, "id", "left").withColumn("rep", F.when(F.col("shared"), fresh).otherwise(F.col("id")))
    return materialise(marked.drop("shared"), "op1-numbers"), top


def _smallest_ids(comp: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """Components (rep, component) named by their smallest id instead of their smallest number."""
    fresh = classes.filter(F.col("rep") > top).select("rep", "id")
    least = comp.join(fresh, "rep").groupBy("component").agg(F.min("id").alias("least"))
    known = F.when(F.col("component") <= top, F.col("component"))
    return comp.join(least, "component", "left").select("rep", F.least(known, "least").alias("component"))


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    blocks: int = 8,
    tile: int = 16_384,
) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Two vectors are linked when their labels are equal and not null (without ``label_col``: always)
    and their cosine, in double precision, is at least ``threshold``. n_links counts the other
    vectors linked directly, component_id is the smallest id reachable.

    Defined cases: a vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, nor does one with a null label; vectors of different sizes never link.
    Columns of doubles are compared as they are, of other numbers as floats. A row with a null id is
    linked with nothing and kept. Equal vectors are links of one another.
    Rows that repeat an id count as further vectors, with the same vector and label or others; each
    row has the number of links and the component of its own vector. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1000)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    kind, number = ("<f8", "double") if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else ("<f4", "float")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("vec"))
    packed = materialise(rows.mapInArrow(_pack_vectors(kind), "id long, label string, vec binary"), "op1")
    usable = packed.filter("vec is not null and label is not null and id is not null")
    classes = materialise(usable.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("w")), "op1-classes")
    classes, top = _with_numbers(classes)
    # a cell of one range has some (0.226 * 0.226) of a label's vectors, if these are spread evenly; wider ones while they fit a tile
    wide = F.least(F.lit(1000), F.greatest(F.lit(1), F.floor(F.sqrt(tile / F.col("count")) / 0.226))).cast("int")
    spans = materialise(classes.groupBy("label").count().select("label", wide.alias("span")), "op1-labels")
    spanned = classes.join(spans, "label").select("rep", "label", "w", "span", "vec")

    schema = "rep long, label string, w long, vec binary, dim int, block int, x long, y long, side int"
    cells = spanned.mapInArrow(_spread(blocks, threshold, kind), schema)
    where = ["label", "dim", "block", "x", "y"]
    # own rows and rows from behind are dealt to tiles of their own, and tiles meet in pairs; a single tile from behind joins each own tile's group
    sizes = spanned.mapInArrow(_spread(blocks, threshold, kind, bare=True), schema).groupBy(*where)
    big = sizes.agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("behind")).filter(F.greatest("own", "behind") > tile)
    of = lambda c: F.ceil(F.col(c) / tile).cast("int")
    big = materialise(big.select(*where, of("own").alias("tiles"), F.greatest(F.lit(1), of("behind")).alias("back")), "op1-big")
    cells = cells.join(big, where, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("tiles", "back")})
    cells = cells.filter("tiles > 0")  # rows from behind meet nothing in a cell without rows
    t = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 1, F.col("back")).otherwise(F.col("tiles"))).cast("int")
    every, back = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("tiles", "back"))
    pair = lambda i, j, s: F.struct(i.alias("i"), j.alias("j"), s.cast("int").alias("s"))
    apart = lambda u: -1 - u  # tiles from behind, beside the own ones
    behind = F.when(F.col("back") == 1, F.transform(every, lambda o: pair(o, o, F.lit(1)))).otherwise(
        F.transform(every, lambda o: pair(o, apart(F.col("t")), F.lit(2)))
    )
    facing = F.when(F.col("back") > 1, F.transform(back, lambda u: pair(F.col("t"), apart(u), F.lit(3)))).otherwise(F.array())
    own = F.transform(
        every,
        lambda o: F.when(o == F.col("t"), pair(o, o, F.lit(0)))
        .when(F.col("t") < o, pair(F.col("t"), o, F.lit(3)))
        .otherwise(pair(o, F.col("t"), F.lit(2))),
    )
    placed = cells.withColumn("t", t).withColumn("m", F.explode(F.when(F.col("side") == 1, behind).otherwise(F.concat(own, facing))))
    placed = placed.select(
        F.xxhash64(*where, "m.i", "m.j").alias("group"), *where[1:3], F.col("m.s").alias("side"), "rep", "w", "vec"
    )
    met = placed.repartition("group").sortWithinPartitions("group").mapInArrow(_compare(blocks, threshold, kind), "kind int, a long, b long")
    met = materialise(met, "op1-met")
    counts = met.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    comp = connected_components(met.filter("kind = 1").select("a", "b"), "op1-cc").withColumnRenamed("id", "rep")
    if top is not None:
        comp = _smallest_ids(comp, classes, top)
    of_class = (
        classes.join(counts, "rep", "left").join(comp, "rep", "left")
        .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    usable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = packed.select("id", F.when(usable, F.col("label")).alias("label"), "vec")
    out = keyed.join(of_class, ["label", "vec"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
