import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as S

from veritext.llm import mixing, packing, token_files
from veritext.llm.tokens import Encoder, default_tokenizer

DOCS = S.StructType([S.StructField(n, t) for n, t in (("doc_id", S.LongType()), ("text", S.StringType()), ("source", S.StringType()), ("size", S.StringType()), ("id", S.StringType()))])
ODD = [
    "", " a b", "a  b", "a <|endoftext|> b", "a\tb c", "don't we'll  x\n\n y ", "é 中 文字 1 2.3 ,a", "a 　b", "a\x1cb c\x85 d", "a b", "​a ​", "x.\ny, z",
    "a.\n\nb", "a\nb\n", "é,\nb!! c)., (d.) 5. 5,5 a’. ü! ×. ÷,", "w" * 100 + " b", "''' 'S a's.", "...", ". .", "\n", "a\r\nb",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer(), cache=60)


def check(encoder, texts):
    flat, at = encoder(texts)
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == encoder.tok.encode(t, add_special_tokens=False).ids, t
    assert at[-1] == len(flat)


def test_encoder_equals_library(encoder):
    check(encoder, ODD)
    r = random.Random(1)
    words = ["".join(r.choice("abceéß") for _ in range(r.randrange(1, 7))) for _ in range(90)]
    for _ in range(6):  # more words than the cache holds
        check(encoder, [" ".join(r.choice(words) + r.choice(["", "", ".", "!!", ",\nX"]) for _ in range(30)) for _ in range(8)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Zé1.,'!\n\t  中-×́")), max_size=30), max_size=6))
def test_encoder_property(encoder, texts):
    check(encoder, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_codec_round_trip(ranks):
    r = np.array(ranks, dtype=np.uint32)
    control, data = token_files.pack_ranks(r)
    back = token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(r))
    assert back.tolist() == ranks
    raw = token_files.pack_shard([1, None], np.array([len(ranks), 0]), r)
    ids, lens, again = token_files.unpack_shard(raw)
    assert (ids, lens.tolist(), again.tolist()) == ([1, None], [len(ranks), 0], ranks)


def rows(n=120, seed=5):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma,", "delta.", "épsilon"]
    out = [(i * 3 % 1000, " ".join(r.choice(words) for _ in range(r.randrange(0, 60))), r.choice(["a", "a", "a", "b", None]), "x", "y") for i in range(n)]
    return out + [(5000, None, "b", "x", "y"), (5001, "", "b", "x", "y"), (5002, "long text " * 4000, "c", "x", "y"), (None, "null id", "a", "x", "y")]


def whole_ids(encoder, text):
    return np.array(encoder.tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_token_files(spark, encoder):
    data = rows()
    folder, manifest = token_files.write_token_files(spark.createDataFrame(data, DOCS).repartition(5), shard_ids=3000)
    assert manifest.count() >= 3
    got = sorted(token_files.read_token_files(spark, folder, manifest, with_ids=True).collect(), key=lambda x: x.start)
    data.sort(key=lambda x: (x[0] is not None, x[0]))
    assert [x.doc_id for x in got] == [d[0] for d in data]
    start = 0
    for x, d in zip(got, data):
        w = whole_ids(encoder, d[1])
        assert (x.start, x.n_tokens, x.ids_crc32, x.ids) == (start, len(w), zlib.crc32(w.tobytes()), w.tolist())
        start += len(w)


def test_token_files_of_nothing(spark):
    folder, manifest = token_files.write_token_files(spark.createDataFrame([], DOCS))
    assert token_files.read_token_files(spark, folder, manifest).count() == 0


def test_packing(spark, encoder):
    data = rows()
    got = packing.pack(spark.createDataFrame(data, DOCS).repartition(5), capacity=256).collect()
    text = {d[0]: d[1] for d in data}
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for x in got:
        by_seq[x.sequence_id].append((x.offset, x.length))
        by_doc[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert set(by_doc) == set(text)
    for d, pieces in by_doc.items():
        w, at = whole_ids(encoder, text[d]), 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and (length == 256 or k == 0) and zlib.crc32(w[at : at + length].tobytes()) == crc
            at += length
        assert at == len(w)
    total = sum(x.length for x in got)
    assert len(by_seq) <= -(-total // 256) * 1.03 + 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_plan_places_every_piece(lengths):
    counts = np.bincount(lengths, minlength=51)
    plan = packing.plan_packing(counts, 50)
    used = Counter()
    for what, times in plan:
        assert sum(what) <= 50
        for x in what:
            used[x] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in plan) <= sum(lengths) / 50 * 1.7 + 1


def test_plan_fills_exactly_where_it_can():
    counts = np.bincount([40, 10, 30, 15, 5, 20, 10, 10, 10], minlength=51)
    assert sum(t for _, t in packing.plan_packing(counts, 50)) == 3


def test_repeated_ids_and_rows(spark, encoder):
    data = [(7, "same text", "a", "x", "y")] * 3 + [(7, "another one", "a", "x", "y"), (None, "same text", "a", "x", "y"), (None, None, "a", "x", "y")]
    df = spark.createDataFrame(data, DOCS).repartition(3)
    want = sorted((d[0] or 0, zlib.crc32(whole_ids(encoder, d[1]).tobytes())) for d in data)
    folder, manifest = token_files.write_token_files(df)
    got = sorted(token_files.read_token_files(spark, folder, manifest).collect(), key=lambda x: x.start)
    assert sorted((x.doc_id or 0, x.ids_crc32) for x in got) == want
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))] and got[0].doc_id is None
    packed = packing.pack(df)
    assert dict(packed.dtypes) == {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint",
    }
    got = packed.collect()
    assert sorted((x.doc_id or 0, x.ids_crc32) for x in got) == want
    places = sorted((x.sequence_id, x.offset, x.length) for x in got)
    assert all(b[1] == a[1] + a[2] for a, b in zip(places, places[1:]) if a[0] == b[0])


def test_mixing_contract(spark):
    r = random.Random(9)
    data = [(i, "w " * r.choice([0, 1, 3, 10, 40]), r.choice(["hot"] * 6 + ["b", "c", "tiny", None]) if i % 50 else "tiny", "x", "y") for i in range(1500)]
    df = spark.createDataFrame(data, DOCS)
    got = {x.doc_id: x for x in mixing.mix(df.repartition(7)).collect()}
    again = {x.doc_id: x for x in mixing.mix(df.repartition(2), bins=8).collect()}
    assert {k: v.taken for k, v in got.items()} == {k: v.taken for k, v in again.items()}
    size = Counter()
    for _, t, s, *_ in data:
        size[s] += t.count("w")
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # reshare the excess until no target is above its cap
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        free -= over
    taken = Counter()
    for i, t, s, *_ in data:
        x = got[i]
        assert (x.size, x.source_size) == (t.count("w"), size[s]) and x.taken <= 3 * x.size and x.taken == x.copies * x.size
        assert abs(x.target - target[s]) < 1e-6
        taken[s] += x.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 40


def test_mixing_draws_with_unequal_probabilities(spark):
    rows = [(i, "w " * (3 if i % 2 else 200), "a" if i < 9000 else "b", "x", "y") for i in range(9400)]
    classes = {3: 2, 200: 7}  # binary digits of size + 1, less one
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    taken, n, target = Counter(), Counter(), {}
    for x in got:
        if x.source_size > 100_000:  # source a
            taken[x.size] += x.copies
            n[x.size] += 1
            target = x.target
    level = target / sum(n[s] * s * (4 + k) for s, k in classes.items())
    for s, k in classes.items():
        want = level * (4 + k)
        share = want % 1
        assert abs(taken[s] / n[s] - want) < 5 * (share * (1 - share) / n[s]) ** 0.5 + 1 / n[s]
        assert {x.copies for x in got if x.size == s and x.source_size > 100_000} <= {int(want), int(want) + 1}
    assert taken[200] / n[200] > 1.5 * taken[3] / n[3]


def test_mixing_with_inclusion_near_zero_and_one(spark, monkeypatch):
    # nearly whole copies of one source and nearly none of the other pile up at the ends of the ranges
    n = {"a": 6_000, "b": 9_000}
    probability = {"a": 0.9999, "b": 0.00005}
    words = {"a": 5, "b": 7}
    plan = spark.createDataFrame([(s, 2, 1, 1.0, 0, f, f * n[s] * words[s] + 0.5) for s, f in probability.items()], "src string, k int, source_size long, target double, base long, f double, missing double")
    r = random.Random(4)
    rows = [(i, s, words[s], r.randrange(1, 1 << 48) / (1 << 48)) for s in n for i in range(n[s])]
    d = spark.createDataFrame(rows, "id long, src string, size long, u double").join(plan, "src")
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    j = d.withColumn("q", q).withColumn("y", F.col("q") / (1 + F.col("q"))).cache()
    piled = j.groupBy("src", F.floor(F.col("y") * 4096)).count().agg(F.max("count")).first()[0]
    for ranked in (50, 10**6):
        sure, left = mixing._at_cut(j, 4096, ranked)
        assert left.groupBy("src").count().agg(F.max("count")).first()[0] <= min(ranked, piled)
        order = sorted(j.collect(), key=lambda x: (x.src, x.q, x.id))
        upto, want = Counter(), {}
        for x in order:
            upto[x.src] += x.size
            want[x.src, x.id] = upto[x.src] - x.size / 2 <= x.missing
        decided = {(x.src, x.id): x.drawn for part in sure for x in part.collect()}
        kept = {(x.src, x.id): x.before for x in left.collect()}
        assert not decided.keys() & kept.keys() and len(decided) + len(kept) == len(rows)
        assert all(want[k] == v for k, v in decided.items())
        for s in n:
            assert {b for (src, _), b in kept.items() if src == s} <= {sum(x.size for x in order if x.src == s and decided.get((s, x.id)))}
    assert piled > 5_000


def test_mixing_refines_a_range_that_holds_a_whole_source(spark):
    data = [(i, "w " * 3, "a" if i % 3 else "b", "x", "y") for i in range(900)]
    df = spark.createDataFrame(data, DOCS)
    plain = {x.doc_id: x.taken for x in mixing.mix(df).collect()}
    assert {x.doc_id: x.taken for x in mixing.mix(df, bins=1, ranked=10).collect()} == plain


def test_mixing_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "x", "y"), (2, "", "a", "x", "y")], DOCS)).collect()
    assert sorted((x.size, x.taken, x.target) for x in got) == [(0, 0, 0.0), (0, 0, 0.0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b", "s", "x", "y"), (1, "a b", "s", "x", "y"), (None, "c", "s", "x", "y")], DOCS)).collect()
    assert sum(x.taken for x in one) == 5


def test_stretches_whose_hashes_agree_by_chance_are_told_apart(monkeypatch):
    from veritext.llm import tokens

    monkeypatch.setattr(tokens, "_mix", lambda x: (x & np.uint64(7)) + np.uint64(1))  # nearly all stretches collide
    enc = Encoder(default_tokenizer())
    texts = ["one two three four", "five six seven", "eight nine ten, one two", "five sit seven", "a b c d e f g h"]
    flat, at = enc(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids
