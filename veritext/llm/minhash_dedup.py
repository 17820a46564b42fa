"""MinHash near-duplicates by a multi-index Hamming join (operator 6).

A document is the set of its distinct word shingles. Sets that are equal are one class, and only
class representatives go on. A signature has MinHash symbols of 16 bits, cut into chunks of 6. By
the pigeonhole principle two signatures that differ in at most 3 * chunks - 1 symbols have a chunk
with at most 2 errors. The errors are enumerated: for each chunk and each choice of 2 symbols to
leave out (15 of them), the remaining 4 symbols are an index key, so such a pair surely meets under
one of the keys. There are as many chunks as this bound needs to reach the distance limit, which a
linked pair exceeds with a chance below 1e-6: 9 (54 symbols, limit 26) for a similarity of 0.8, 7 (42
symbols, limit 19) for 0.85. Every link is then confirmed on the two full sets.

The output needs classes, not pairs, so pairs are never expanded within a bucket:

1. keys are range-partitioned by (key, representative), so a key that a third of all documents
   share is spread over many tasks, and every member is tied to its bucket's first one, the hub;
2. each representative joins the group of the hub that it shares most keys with, and a group is
   dealt to tiles, each of which compares its whole texts with each other and with the hub, so a group
   of n linked texts costs n. Then, in families, the trees that the ties to hubs make, what isn't yet in
   the family's largest component is compared with every member, through an inverted index of
   shingles; members of the largest component needn't meet each other;
3. only buckets that still hold several components and families are compared pair by pair across
   them, in tiles of bounded size and by signature distance, and what is left is confirmed too.

Families beyond a tile are dealt to tiles: those of its largest component meet those of the rest,
and the latter meet each other. A tile holds about 512 texts or a million shingles, whichever is
less. A group gives at most as many links as it has members. No link between different texts is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.common import BROADCAST_IDS, connected_components, materialise, more_components, small_batches

WIDTH, ERRORS = 6, 2
MOST_CHUNKS = 64
TILE_SHINGLES = 1_000_000
_KEPT = [tuple(sorted(set(range(WIDTH)) - set(out))) for out in combinations(range(WIDTH), ERRORS)]
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A = (_rng.integers(1, 1 << 31, size=(MOST_CHUNKS * WIDTH, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, size=(MOST_CHUNKS * WIDTH, 1), dtype=np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased; equal words have equal hashes."""
    b = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    n = len(b)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    gap = np.concatenate([[True], _SPACE[b], [True]])
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _power(n)
    upto = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up, out=upto[1:])
    return _mix((upto[end] - upto[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than that make one shingle, none an empty set."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(words, len(w))
    out = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(3) + w[i : len(w) - k + 1 + i] + np.uint64(k))
    return np.unique(out)


def signature(shingles: np.ndarray, chunks: int) -> np.ndarray:
    """chunks * WIDTH MinHash symbols of 16 bits."""
    k = chunks * WIDTH
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 20_000):
        np.minimum(least, (_A[:k] * x[None, i : i + 20_000] + _B[:k]).min(axis=1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


def distance_limit(similarity: float, symbols: int) -> int:
    """Signature distance that a pair of this similarity exceeds with a chance below 1e-6."""
    p, tail = 1 - similarity, 1.0
    for d in range(symbols + 1):
        tail -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if tail < 1e-6:
            return d
    return symbols


def chunks_for(similarity: float) -> int:
    """The fewest chunks whose keys surely bring every pair within the distance limit together."""
    for chunks in range(1, MOST_CHUNKS + 1):
        if distance_limit(similarity, chunks * WIDTH) <= chunks * (ERRORS + 1) - 1:
            return chunks
    raise ValueError(f"no pigeonhole scheme of {MOST_CHUNKS} chunks reaches a similarity of {similarity}")


def _sign(words: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, h1, h2 = [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_buffer() if t.is_valid and len(t.as_py()) else b"", words)
                n.append(len(s))
                sig.append(signature(s, chunks).tobytes() if len(s) else None)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=["id", "n", "sig", "h1", "h2"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<u2").reshape(len(rows), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, sig) to a row (key, rid) for each chunk and each choice of the symbols kept."""
    for b in batches:
        if not b.num_rows:
            continue
        s = _matrix(b.column("sig")).astype(np.uint64)
        s = s.reshape(len(s), -1, WIDTH)
        chunks = s.shape[1]
        keys = np.empty((len(s), chunks, len(_KEPT)), dtype=np.uint64)
        for m, kept in enumerate(_KEPT):
            v = s[:, :, kept[0]] << np.uint64(48) | s[:, :, kept[1]] << np.uint64(32) | s[:, :, kept[2]] << np.uint64(16) | s[:, :, kept[3]]
            place = (np.arange(chunks, dtype=np.uint64) * np.uint64(len(_KEPT)) + np.uint64(m)) * np.uint64(0xD6E8FEB86659FD93)
            keys[:, :, m] = _mix(v + place[None, :])
        flat = keys.reshape(-1).view(np.int64)
        rid = np.repeat(b.column("rid").to_numpy(zero_copy_only=False), chunks * len(_KEPT))
        for i in range(0, len(flat), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(flat[i : i + 50_000]), pa.array(rid[i : i + 50_000])], names=["key", "rid"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rid) to (key, hub, rid, border) for runs of two or more and for border runs."""

    def out(key, rid, border: bool) -> pa.RecordBatch:
        # key, rid: whole runs one after another
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        hub = np.repeat(rid[first], size)
        keep = np.repeat(size, size) > 1 if not border else np.ones(len(key), dtype=bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[keep]), pa.array(hub[keep]), pa.array(rid[keep]), pa.array(np.full(int(keep.sum()), border))],
            names=["key", "hub", "rid", "border"],
        )

    held_k, held_r, at_start = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for b in batches:
        k = np.concatenate([held_k, b.column("key").to_numpy()])
        r = np.concatenate([held_r, b.column("rid").to_numpy()])
        if not len(k):
            continue
        if at_start:
            end = int(np.searchsorted(k, k[0], side="right"))
            if end == len(k):
                held_k, held_r = k, r
                continue
            yield out(k[:end], r[:end], True)
            k, r, at_start = k[end:], r[end:], False
        last = int(np.searchsorted(k, k[-1], side="left"))
        if last:
            yield out(k[:last], r[:last], False)
        held_k, held_r = k[last:], r[last:]
    if len(held_k):
        yield out(held_k, held_r, True)


def _link_run(rid: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components among these documents; all links across components are looked at."""
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    posting, first = doc[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    start = np.concatenate([[0], np.cumsum(size)])
    _, label = np.unique(comp, return_inverse=True)
    label = label.copy()
    largest = int(np.bincount(label).argmax())
    links = []
    for x in range(len(sets)):
        if label[x] == largest:
            continue
        own = token[start[x] : start[x + 1]]
        lo, n = first[own], first[own + 1] - first[own]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(lo - (ends - n), n)
        both = np.bincount(posting[at], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size + size[x] - both)) & (label != label[x]))
        met, one = np.unique(label[near], return_index=True)
        if len(met):
            links += [(int(rid[x]), int(rid[near[k]])) for k in one]
            # all of them are one component now; the largest one keeps its label
            new = largest if largest in met else label[x]
            label[np.isin(label, np.append(met, label[x]))] = new
    return links


def _link(words: int, percent: int):
    """Rows sorted by (g, i, j) with texts to the links inside each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in _then_none(batches):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j", "rid", "comp")]
                sets = [shingle_set(t.as_buffer(), words) for t in b.column("text")]
                held = [*cols, sets] if held is None else [np.concatenate([x, y]) for x, y in zip(held[:5], cols)] + [held[5] + sets]
            if held is None:
                continue
            g, i, j, rid, comp, sets = held
            cut = (np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
            at, links = 0, []
            for end in cut + ([len(g)] if b is None else []):
                if end - at > 1 and (comp[at:end] != comp[at]).any():
                    links += _link_run(rid[at:end], comp[at:end], sets[at:end], percent)
                at = end
            held = [x[at:] for x in held]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return run


def _across(limit: int):
    """Rows sorted by (key, i, j, side) with sig and component to pairs of close signatures in two components."""

    def pairs(side: np.ndarray, rid: np.ndarray, comp: np.ndarray, fam: np.ndarray, sig: np.ndarray, key: int):
        one, two = (side < 2, side > 0) if (side != 1).any() else (side == 1, side == 1)
        ra, rb, ca, cb, sa, sb = rid[one], rid[two], comp[one], comp[two], sig[one], sig[two]
        fa, fb = fam[one], fam[two]
        same_tile = not (side != 1).any()
        for i in range(0, len(ra), 256):
            d = np.zeros((len(ra[i : i + 256]), len(rb)), dtype=np.uint8)
            for s in range(sig.shape[1]):
                d += sa[i : i + 256, s, None] != sb[None, :, s]
            ok = (d <= limit) & (ca[i : i + 256, None] != cb[None, :]) & (fa[i : i + 256, None] != fb[None, :])
            if same_tile:
                ok &= ra[i : i + 256, None] < rb[None, :]
            x, y = np.nonzero(ok)
            x += i
            if len(x):
                # a pair belongs to the first key that it shares; other buckets leave it out
                eq = (sa[x] == sb[y]).reshape(len(x), -1, WIDTH)
                share = np.stack([eq[:, :, list(kept)].all(axis=2) for kept in _KEPT], axis=2).reshape(len(x), -1)
                nth = share.argmax(axis=1)
                own = _key_at(sa[x], nth) == key
                yield np.minimum(ra[x], rb[y])[own], np.maximum(ra[x], rb[y])[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in _then_none(batches):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "rid", "comp", "fam")] + [_matrix(b.column("sig"))]
                held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if held is None:
                continue
            k, i, j = held[:3]
            cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ends = [*cut.tolist()] + ([len(k)] if b is None else [])
            a_out, b_out, at = [], [], 0
            for end in ends:
                if end - at > 1:
                    comp = held[5][at:end]
                    if (comp != comp[0]).any():
                        for x, y in pairs(held[3][at:end], held[4][at:end], comp, held[6][at:end], held[7][at:end], int(k[at])):
                            a_out.append(x)
                            b_out.append(y)
                at = end
            held = [x[at:] for x in held]
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    return run


def _then_none(batches):
    yield from batches
    yield None


def _key_at(sig: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The nth of the keys of each signature, as _keys makes it."""
    s = sig.astype(np.uint64).reshape(len(sig), -1, WIDTH)
    chunk, m = nth // len(_KEPT), nth % len(_KEPT)
    kept = np.array(_KEPT)[m]
    row = np.arange(len(s))
    v = np.zeros(len(s), dtype=np.uint64)
    for q in range(WIDTH - ERRORS):
        v = v << np.uint64(16) | s[row, chunk, kept[:, q]]
    return _mix(v + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _tiles(count, shingles, tile: int):
    """How many tiles so many texts with so many shingles need."""
    return F.ceil(F.greatest(count / tile, shingles / TILE_SHINGLES)).cast("int")


def _compared(spread: DataFrame, texts: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Links (a, b) inside each meeting (g, i, j) of the rows of ``spread`` (g, i, j, rid, comp)."""
    met = spread.join(texts.withColumnRenamed("id", "rid"), "rid").select("g", "i", "j", "rid", "comp", "text")
    met = met.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return materialise(met.mapInArrow(_link(words, percent), "a long, b long").distinct(), name)


def _hub_links(groups: DataFrame, texts: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """Links inside tiles of each group (g, rid, n) and to its hub g, which is shown to every tile."""
    sizes = groups.groupBy("g").agg(_tiles(F.count("*"), F.sum("n"), tile).alias("tiles"))
    rows = groups.join(sizes, "g").withColumn("t", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("tiles") - 1)
    i = F.explode(F.when(F.col("rid") == F.col("g"), everywhere).otherwise(F.array("t")))
    spread = rows.select("g", i.alias("i"), F.lit(0).alias("j"), "rid", F.col("rid").alias("comp"))
    return _compared(spread, texts, words, percent, "op6-links")


def _group_links(groups: DataFrame, texts: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) inside groups (g, rid, comp, n) that hold several components; all links across components are looked at."""
    parts = groups.groupBy("g", "comp").agg(F.count("*").alias("count"), F.sum("n").alias("words")).groupBy("g")
    parts = parts.agg(
        F.sum("count").alias("size"), F.sum("words").alias("words"), F.count("*").alias("comps"), F.max(F.struct("count", "comp", "words")).alias("top")
    )
    top = F.col("top.count") > 1
    whole, whole_words = F.when(top, F.col("top.count")).otherwise(0), F.when(top, F.col("top.words")).otherwise(0)
    mixed = parts.filter("comps > 1").select(
        "g", F.col("top.comp").alias("top"), _tiles(whole, whole_words, tile).alias("tops"),
        _tiles(F.col("size") - whole, F.col("words") - whole_words, tile).alias("rests"),
    )
    spread = groups.join(mixed, "g").withColumn("is_top", (F.col("comp") == F.col("top")) & (F.col("tops") > 0))
    spread = spread.withColumn("t", F.pmod(F.xxhash64("rid"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    # all members of a meeting are compared, so only a lone tile of the rest has to meet itself
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    with_rest = F.transform(
        F.filter(rests, lambda o: o != F.col("t")), lambda o: pair(F.least(o, F.col("t")), F.greatest(o, F.col("t")))
    )
    with_top = F.transform(F.filter(F.sequence(F.lit(0), F.col("tops")), lambda o: o < F.col("tops")), lambda o: pair(F.col("t"), F.col("rests") + o))
    alone = F.when((F.col("rests") == 1) & (F.col("tops") == 0), F.array(pair(F.lit(0), F.lit(0))))
    meet = F.when(F.col("is_top"), F.transform(rests, lambda o: pair(o, F.col("rests") + F.col("t")))).otherwise(
        F.coalesce(alone, F.concat(with_rest, with_top))
    )
    spread = spread.withColumn("m", F.explode(meet)).select("g", "m.i", "m.j", "rid", "comp")
    return _compared(spread, texts, words, percent, "op6-links")


def _roots(ties: DataFrame) -> DataFrame:
    """(rid, root) for a forest (rid, g) in which g is always smaller: each round doubles the way that a tie goes."""
    at = ties.select("rid", F.col("g").alias("root"))
    for _ in range(64):
        up = at.select(F.col("rid").alias("root"), F.col("root").alias("higher"))
        new = materialise(at.join(up, "root", "left").select("rid", F.coalesce("higher", "root").alias("root"), "higher"), "op6-roots")
        at = new.select("rid", "root")
        if new.filter("higher is not null").isEmpty():
            break
    return at


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    tile: int = 512,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links, kept says that it is the row's own id.

    Defined cases: a null or empty text, or one without words, has an empty set and is linked
    with nothing. A row with a null id is linked with nothing and kept. Rows that repeat an id
    are judged each by its own text; the same text repeated under one id is one class. A text of
    fewer words than a shingle is one shingle. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chunks = chunks_for(percent / 100)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(base.mapInArrow(_sign(words, chunks), "id long, n long, sig binary, h1 long, h2 long"), "op6")
    classes = signed.filter("n > 0 and id is not null").groupBy("h1", "h2")
    classes = materialise(classes.agg(F.min("id").alias("rid"), F.first("sig").alias("sig"), F.first("n").alias("n")), "op6-classes")
    reps = classes.groupBy("rid").agg(F.first("sig").alias("sig"))  # one for each id
    sizes = classes.groupBy("rid").agg(F.max("n").alias("n"))
    keys = classes.select("rid", "sig").mapInArrow(_keys, "key long, rid long")
    dealt = keys.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid")
    stars = materialise(dealt.mapInArrow(_stars, "key long, hub long, rid long, border boolean"), "op6-stars")

    # 2. each representative with the hub that it shares most keys with; hubs of a key cut by a border with its first hub
    shared = stars.filter("hub <> rid").groupBy("rid", "hub").count()
    best = shared.groupBy("rid").agg(F.max(F.struct("count", -F.col("hub"))).alias("m"))
    best = materialise(best.select((-F.col("m.col2")).alias("g"), "rid"), "op6-best")
    hubs = stars.filter("border").select("key", "hub").distinct()
    lead = hubs.groupBy("key").agg(F.min("hub").alias("lead"))
    cross = hubs.join(lead, "key").filter("lead <> hub").select(F.col("lead").alias("g"), F.col("hub").alias("rid"))
    groups = best.union(cross)
    groups = groups.union(groups.select("g", F.col("g").alias("rid"))).distinct().join(sizes, "rid")
    groups = materialise(groups.select("g", "rid", "n"), "op6-groups")
    members = materialise(groups.select(F.col("rid").alias("id"), "n").distinct(), "op6-members")
    few = members.count() <= BROADCAST_IDS
    ids = members.select("id")
    texts = base.filter("id is not null and text is not null").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    texts = materialise(texts, "op6-texts")
    links = _hub_links(groups, texts, words, percent, tile)
    comp = materialise(connected_components(links, "op6-cc"), "op6-comp")

    def with_more(comp: DataFrame, more: DataFrame) -> DataFrame:
        return comp if more.isEmpty() else materialise(more_components(comp, more, "op6-cc"), "op6-comp")

    def placed(comp: DataFrame, t: DataFrame) -> DataFrame:
        """t (rid, ...) with its component."""
        known = t.join(comp.withColumnRenamed("id", "rid"), "rid", "left")
        return known.withColumn("comp", F.coalesce("component", "rid")).drop("component")

    fam = members.withColumnRenamed("id", "rid").join(_roots(best), "rid", "left").withColumn("g", F.coalesce("root", "rid"))
    fam = materialise(placed(comp, fam.select("rid", "g", "n")), "op6-families")
    comp = with_more(comp, _group_links(fam, texts, words, percent, tile))

    # 3. what still meets in a bucket across components and groups
    place = materialise(placed(comp, fam.select("rid", "n", F.col("g").alias("fam"))), "op6-place")
    member = stars.select("key", "rid").join(place, "rid")
    mixed = member.groupBy("key").agg(
        F.count("*").alias("size"),
        *[f(c).alias(f"{n}_{c}") for c in ("comp", "fam") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    mixed = mixed.filter("lo_comp <> hi_comp and lo_fam <> hi_fam")
    mixed = mixed.select("key", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    open_ = member.join(mixed, "key").join(reps, "rid")
    t = F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")
    meet = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(
            F.least(o, F.col("t")).alias("i"), F.greatest(o, F.col("t")).alias("j"),
            F.when(o == F.col("t"), 1).when(F.col("t") < o, 0).otherwise(2).alias("side"),
        ),
    )
    spread = open_.withColumn("t", t).withColumn("m", F.explode(meet)).select("key", "m.i", "m.j", "m.side", "rid", "comp", "fam", "sig")
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    limit = distance_limit(percent / 100, chunks * WIDTH)
    late = materialise(spread.mapInArrow(_across(limit), "a long, b long").distinct(), "op6-late")
    stars_ = late.select(F.col("a").alias("g"), F.col("b").alias("rid"))
    stars_ = stars_.union(stars_.select("g", F.col("g").alias("rid"))).distinct().join(place.select("rid", "comp", "n"), "rid")
    comp = with_more(comp, _group_links(stars_, texts, words, percent, tile)).withColumnRenamed("id", "rid")

    of_class = classes.join(comp, "rid", "left").select(
        "h1", "h2", F.coalesce("component", "rid").alias("component_id")
    )
    own = signed.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("h1")).alias("h1"), "h2")
    out = own.join(of_class, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
