"""License scans, the conversation prefix trie and whitening against plain versions of what they return."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veritext.llm import license_scan, prefix_trie, whitening

# --- license scans


def _phrases(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    labels = ",".join(sorted({label for _, label in places}))
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), labels


def test_license_phrases_equal_brute_force(spark):
    r = random.Random(3)
    some = "mit license apache general public License, MIT-License\tGNU é3 of the\x00".split(" ")
    texts = [" ".join(r.choice(some) for _ in range(r.randrange(40))) for _ in range(150)]
    texts += [None, "", "MIT License", "mit\nlicense mit.license", "İ mit license", "mit licenses", "x " * 9_000 + "general public license " * 3_000]
    texts += [("w " * n) + "apache license" for n in (license_scan.PIECE - 2, license_scan.PIECE - 1, license_scan.PIECE)]  # across the borders of pieces
    rows = [(i if i % 50 else None, t, t) for i, t in enumerate(texts)] + [(7, "mit license", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, template string").repartition(3)
    got = sorted(((x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in license_scan.license_scan(df).collect()), key=str)
    assert got == sorted((_phrases(t) for _, t, _ in rows), key=str)
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_notices_are_found_in_spite_of_edits(spark):
    notice = next(t for t, label in license_scan.NOTICES.items() if label == "bsd")
    w = notice.split()
    changed = " ".join(w[:8] + ["really", "so"] + w[8:])
    half = " ".join(w[:9])
    spread = " ".join(x + " filler" * 3 for x in w)
    rows = [(1, "a b c " + notice), (2, changed.upper()), (3, half), (4, spread), (5, notice + " z " * 60 + notice), (6, "clean text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.license_scan(df).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["bsd", "bsd", "", "", "bsd", ""]
    assert got[1].score == 1.0 and 0.6 <= got[2].score < 1 and 0 < got[3].score < 0.6 and got[4].score == got[6].score == 0
    assert all(x.n_base == 0 and x.base_labels == "" and x.first_word is None for x in got.values())
    spans = sorted((x.doc_id, x.start, x.stop) for x in license_scan.license_spans(df).collect())
    assert spans == [(1, 3, 3 + len(w)), (2, 0, len(w) + 2), (5, 0, len(w)), (5, len(w) + 60, 2 * len(w) + 60)]


def test_license_places_are_broadcast_only_when_small(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the mit license")], "doc_id long, text string")
    monkeypatch.setattr(license_scan, "BROADCAST_GRAMS", 0)
    assert license_scan.license_scan(df).first().base_labels == "mit"


# --- prefix trie


def _trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, under = defaultdict(list), defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
        for d in range(len(p) + 1):
            under[p[:d]].append(p)
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append(
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in under[p]),
             sum(saved[q] for q in under[p]), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, base string, pos string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(3)


def _found(df):
    got = prefix_trie.prefix_trie(prefix_trie.rebuild(df), "base")
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(60), -7, -5, 5_000, 5_003, 1 << 40]:
        for turn in range(r.randrange(1, 8)):
            rows.append((c, r.choice([turn, turn, None, 3]), r.choice(["user", "user", None]), r.choice(["hi", "hi", "hi", "é", None, "b" * 30])))
    rows += [(None, 1, "user", "hi"), (100, 0, "user", "hi"), *[(105, k, "u", f"{k}") for k in range(300)], *[(k, 2, "u", "same") for k in range(4, 60, 5)]]
    rows += rows[:40]  # repeated turns
    assert _found(_rows(spark, rows)) == _trie(rows)


def test_trie_of_many_copies_and_children(spark, monkeypatch):
    rows = [(c, k, "user", "hello" if k < 2 else "bye") for c in range(0, 6_000, 5) for k in range(3)]
    rows += [(c, k, "user", "hello" if k < 2 else f"{c}") for c in range(50_000, 58_000, 5) for k in range(3)]
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 6)
    got = _found(_rows(spark, rows))
    assert got == _trie(rows) and max(x[4] for x in got) == 1_601  # more children than any node may have unbroadcast


def test_trie_without_turns_or_rows(spark):
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "user", "lost")]
    assert _found(_rows(spark, rows)) == _trie(rows) and _trie(rows)[0][1] == 0
    assert _found(_rows(spark, [])) == []


# --- whitening


def _vectors(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], "z", 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int").repartition(3)


def _plain(vectors, k):
    x = np.floor(1024 * np.float32(vectors).astype(float)).astype(np.int64) + 100_000
    n = len(x)
    c = x - x.mean(axis=0)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    dev = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x]
    return n, dev, (c @ q) / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("dim", [5, 8, 40])
def test_whitening_equals_dense_eigenvectors(spark, dim):
    r = np.random.default_rng(dim)
    good = r.normal(size=(300, dim)) @ r.normal(size=(dim, dim)) * np.linspace(0.2, 1, dim)
    bad = [None, [], [1.0] * (dim - 1), [float("nan")] + [0.0] * (dim - 1), [float("inf")] * dim, [None] * dim]
    df = _vectors(spark, [*good, *bad])
    got = whitening.whiten(df, block=4).collect()
    k = min(8, dim)
    n, dev, white, share = _plain(good, k)
    w = np.zeros((n, k))
    for x in got:
        w[x.vec_id, x.component - 1] = x.whitened
        assert (x.n, x.deviation) == (n, dev[x.vec_id]) and abs(x.explained / share[x.component - 1] - 1) < 1e-9 and x.identity_error < 1e-9
    assert len(got) == n * k
    assert np.allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-8)


def test_whitening_of_ties_copies_and_little(spark):
    assert whitening.whiten(_vectors(spark, [None, [None]])).count() == 0
    assert whitening.whiten(_vectors(spark, [[1.0, 2.0]])).count() == 0  # no spread, no components
    square = [[1, 0, 5], [-1, 0, 5], [0, 1, 5], [0, -1, 5]] * 2  # two equal eigenvalues, one of zero
    got = whitening.whiten(_vectors(spark, square, [1, 2, 3, 4, 1, 2, 3, None])).collect()
    assert len(got) == 16 and {x.component for x in got} == {1, 2} and all(x.identity_error < 1e-12 and abs(x.explained - 0.5) < 1e-12 for x in got)
    assert sum(x.vec_id is None for x in got) == 2


def test_lanczos_breaks_down_and_restarts():
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.normal(size=(60, 60)))
    for spectrum in ([9.0, 7, 7, 7, 5, 3] + [0.0] * 54, [1.0] * 60, list(np.geomspace(1, 1e-9, 60)), [2.0] * 30 + [1.0] * 30):
        a = q * np.array(spectrum) @ q.T
        values, vectors, passes = whitening.block_lanczos(lambda b: a @ b, 60, wanted=6, block=3)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:6], atol=1e-12) and passes <= 20
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)


def test_deviations_stay_exact():
    x = np.array([[100_000 + 2**20, 100_000], [100_000, 100_000]])
    n = 10**12
    assert list(whitening._deviations(x, n, x.sum(axis=0) * (n // 2))) == [2 * 0 + sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0) * (n // 2))) for row in x]
