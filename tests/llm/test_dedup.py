import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as S

from veritext.llm import embedding_dedup, exact_dedup, minhash_dedup
from veritext.llm.common import connected_components, more_components

DOCS = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("id", S.StringType()), S.StructField("kept", S.IntegerType())])


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(parts)


def components(n, links):
    up = {v: v for v in n}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {v: top(v) for v in n}


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 60)] + [(900 + k, 901 + k) for k in range(40)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({v for e in edges for v in e}, edges)
    assert got == {v: c for v, c in want.items() if v in got} and set(got) == {v for a, b in edges if a != b for v in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_equals_brute_force(spark, keep):
    r = random.Random(2)
    texts = ["", None, "a", "a ", "A", "b" * 50_000, "same beginning, " + "x" * 40, "same beginning, " + "x" * 41]
    rows = [(i, r.choice(texts + ["hot"] * 20)) for i in range(600)]
    got = {x.doc_id: x for x in exact_dedup.exact_dedup(docs(spark, rows, 7), keep=keep).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        g = groups[t or ""]
        want = max(g) if keep == "max" else min(g)
        x = got[i]
        assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (want, len(g), i == want, hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_over_many_partitions(spark):
    """One group that crosses many partition borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "copy" if i % 10 else f"own {i}") for i in range(2000)]
        got = exact_dedup.exact_dedup(docs(spark, rows, 9)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.kept for x in got) == 201
    assert {(x.keep_id, x.group_size) for x in got if x.doc_id % 10} == {(1999, 1800)}


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(1, "x"), (1, "x"), (None, "x"), (None, "y")])).collect()
    assert sorted((x.doc_id is None, x.keep_id, x.group_size, x.kept) for x in got if x.keep_id) == [(False, 1, 3, False), (False, 1, 3, True), (True, 1, 3, False)]
    assert [(x.keep_id, x.kept) for x in got if x.keep_id is None] == [(None, True)]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(docs(spark, [(1, "A"), (2, "a")]), normalise=lambda c: __import__("pyspark").sql.functions.lower(c)).filter("kept").count() == 1


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def near_rows(r, n=220):
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 6))) for _ in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randrange(1, 120))] for _ in range(12)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.2:
            w = [r.choice(vocabulary) for _ in range(40)] + passage
        rows.append((i, " ".join(w) if r.random() < 0.9 else "\n".join(w).upper()))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "long " * 30_000)]


def test_components_of_a_hot_vertex(spark):
    r = random.Random(3)
    links = [(5000, i) for i in range(3000)] + [(r.randrange(6000, 9000), r.randrange(6000, 9000)) for _ in range(1500)] + [(1, 1), (7, 5000)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(range(9000), links)
    assert got == {i: want[i] for i in got} and {i for a, b in links for i in (a, b) if a != b} == set(got)


def test_components_of_further_links(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(200)]
    more = [(r.randrange(500), r.randrange(500)) for _ in range(60)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    got = more_components(connected_components(frame(links)), frame(more)).collect()
    want = components(range(500), links + more)
    assert len({x.id for x in got}) == len(got) and {x.id: x.component for x in got} == {x.id: want[x.id] for x in got}
    assert {i for a, b in links + more for i in (a, b) if want[a] != a or want[b] != b} <= {x.id for x in got}


@pytest.mark.parametrize("words,percent,tile", [(3, 85, 512), (5, 80, 512), (3, 85, 16)])
def test_near_duplicates_equal_brute_force(spark, words, percent, tile):
    rows = near_rows(random.Random(words + tile))
    sets = {i: shingles(t, words) for i, t in rows}
    ids = [i for i, _ in rows]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(docs(spark, rows), words=words, percent=percent, tile=tile).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)]
    got = sorted((x.doc_id or 0, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(docs(spark, rows), words=3).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_signature_distance_follows_similarity():
    r = np.random.default_rng(3)
    far = []
    for _ in range(60):
        x = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:919], r.integers(0, 1 << 63, 81, dtype=np.uint64)])  # Jaccard 0.85
        far.append((minhash_dedup.signature(np.unique(x), 5) != minhash_dedup.signature(np.unique(y), 5)).sum())
    assert 3.3 < np.mean(far) < 5.7 and max(far) <= minhash_dedup.distance_limit(0.85, 30)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_keys_bring_all_pairs_within_the_limit_together(similarity):
    r, chunks = np.random.default_rng(5), minhash_dedup.chunks_for(similarity)
    symbols = chunks * minhash_dedup.WIDTH
    limit = minhash_dedup.distance_limit(similarity, symbols)
    assert limit <= chunks * (minhash_dedup.ERRORS + 1) - 1
    rows = []
    for _ in range(200):
        a = r.integers(0, 1 << 16, symbols).astype("<u2")
        b = a.copy()
        b[r.choice(symbols, limit, replace=False)] ^= 1
        rows += [a.tobytes(), b.tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.binary())], names=["rid", "sig"])
    keys = {}
    for out in minhash_dedup._keys([batch]):
        for k, i in zip(out.column("key").to_pylist(), out.column("rid").to_pylist()):
            keys.setdefault(i, set()).add(k)
    assert all(keys[i] & keys[i + 1] for i in range(0, len(rows), 2))


VEC = "vec_id long, embedding array<float>, label int, id string, kept int"


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_duplicate_vectors_equal_brute_force(spark, tile):
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 32))
    x = (base[r.integers(0, 12, 260)] + r.standard_normal((260, 32)) * r.choice([0.01, 0.1, 0.16], (260, 1))).astype(np.float32)
    x[10] = x[11] = x[12]
    x[13] = 2 * x[12]
    label = [int(v) if v else None for v in r.integers(0, 4, 260)]
    label[10] = label[11] = label[12] = label[13] = 1
    rows = [(i, [float(v) for v in x[i]], label[i], "x", 1) for i in range(260)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0] * 3, [float("inf")] * 32]
    rows += [(300 + i, v, 1, "x", 1) for i, v in enumerate(odd)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    cos = unit @ unit.T
    links = [(a, b) for a in range(260) for b in range(a + 1, 260) if label[a] is not None and label[a] == label[b] and cos[a, b] >= 0.98]
    assert len(links) > 300
    want = components([r[0] for r in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {y.vec_id: (y.n_links, y.component_id, y.kept) for y in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VEC), tile=tile).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}


def test_near_duplicate_vectors_bound_rows_from_behind(spark, monkeypatch):
    tile, rng = 32, np.random.default_rng(5)
    x = (np.array([1, 1, 1, 1]) / 2 + rng.standard_normal((1500, 4)) * 0.12).astype("<f4")
    real = embedding_dedup._compare

    def bounded(blocks, threshold, kind):
        def run(batches):
            batches = list(batches)
            n = Counter(g for b in batches for g in b.column("group").to_pylist())
            if n and max(n.values()) > 4 * tile:  # two tiles, unevenly filled
                raise ValueError(f"a group of {max(n.values())} vectors")
            yield from real(blocks, threshold, kind)(iter(batches))

        return run

    monkeypatch.setattr(embedding_dedup, "_compare", bounded)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {y.vec_id: (y.n_links, y.component_id) for y in embedding_dedup.near_duplicate_vectors(df, blocks=2, tile=tile).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    near = u @ u.T >= 0.98
    component = np.arange(len(x))
    while (least := np.where(near, component[None, :], len(x)).min(1)).tolist() != component.tolist():
        component = least
    assert got == {i: (int(near[i].sum()) - 1, int(component[i])) for i in range(len(x))}


@pytest.mark.parametrize("scale", [1.0, 1e200])
def test_double_vectors_and_repeated_ids(spark, scale):
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((20, 16)), 3, axis=0) + r.standard_normal((60, 16)) * 0.1
    rows = [(i, (v * scale).tolist(), 1) for i, v in enumerate(x)] + [(0, (x[0] * scale).tolist(), 1)]
    u = np.vstack([x, x[:1]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & ~np.eye(61, dtype=bool)
    want = components(range(60), [(int(a) % 60, int(b) % 60) for a, b in zip(*np.nonzero(near))])
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((y.vec_id, y.n_links, y.component_id) for y in got) == sorted((i % 60, int(near[i].sum()), want[i % 60]) for i in range(61))


def test_an_id_of_several_vectors(spark):
    r = np.random.default_rng(7)
    x = np.repeat(r.standard_normal((30, 16)), 4, axis=0) + r.standard_normal((120, 16)) * 0.1
    ids = [int(v) for v in r.permutation(120)]
    for a, b in ((0, 40), (1, 80), (2, 3), (60, 90), (61, 91)):
        ids[b] = ids[a]
    ids[20] = ids[30] = ids[31] = -5
    label = [k % 2 for k in range(120)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    same = np.array(label)[:, None] == np.array(label)
    near = (u @ u.T >= 0.98) & same & ~np.eye(120, dtype=bool)
    tree = components(range(120), list(zip(*(v.tolist() for v in np.nonzero(near)))))
    least = {t: min(ids[k] for k in tree if tree[k] == t) for t in tree.values()}
    df = spark.createDataFrame([(i, v.tolist(), n) for i, v, n in zip(ids, x, label)], "vec_id long, embedding array<double>, label int")
    got = sorted((y.vec_id, y.n_links, y.component_id) for y in embedding_dedup.near_duplicate_vectors(df, tile=16).collect())
    assert got == sorted((ids[k], int(near[k].sum()), least[tree[k]]) for k in range(120))
    assert near.any() and any(least[t] == -5 for t in least)


@pytest.mark.parametrize("same", [True, False])
def test_parts_bring_near_rows_together_once(same):
    r = np.random.default_rng(8)
    cells = r.integers(-3, 4, (400, 5))
    mine = 250
    side = np.arange(400) >= mine
    cells = cells[np.lexsort([*cells.T[::-1], side])] if same else np.vstack([np.array(sorted(p.tolist())) for p in (cells[:mine], cells[mine:])])
    for few in (1, 60, 5_000, 10**6):
        met = Counter()
        for a, b, c, d, alone in embedding_dedup._meetings(cells, mine, same, few):
            met.update((i, j) for i in range(a, b) for j in range(c, d) if not alone or i < j)
        assert set(met.values()) <= {1}
        for i in range(mine):
            for j in range(i + 1 if same else mine, 400):
                if (abs(cells[i] - cells[j]) <= 1).all():
                    assert met[i, j] == 1
        assert all((i < mine) and (j >= mine or same) for i, j in met)


def test_few_pairs_of_a_label_are_compared():
    """Isotropic vectors, two tiles of a cell that is one range wide on two axes: 0.2 of a label's pairs get there, 0.11 of those on."""
    r = np.random.default_rng(9)
    n, dim = 32_768, 64
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    width = embedding_dedup._range(0.98, 0, 8, dim)
    x[:, :2] = r.random((n, 2)) * width
    cells = np.floor(x[:, :8] / width).astype(np.int64)
    cells = cells[np.lexsort([*cells.T[::-1], np.arange(n) >= n // 2])]
    met = sum((b - a) * (d - c) for a, b, c, d, _ in embedding_dedup._meetings(cells, n // 2, False))
    assert met < 0.11 * (n // 2) ** 2


def test_near_duplicate_vectors_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.0], 1, "x", 1), (2, [1.0, 0.0], None, "x", 1)], VEC)
    assert sorted((y.vec_id or 0, y.n_links, y.kept) for y in embedding_dedup.near_duplicate_vectors(df).collect()) == [(0, 0, True), (1, 0, True), (2, 0, True)]
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
