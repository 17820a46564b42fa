import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veritext.sources import arrays
from veritext.sources import readers as R


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False))
    return str(path)


def test_arrays(spark, tmp_path):
    put(tmp_path / "a.json", [{"id": "é", "x": 1}, {"id": 2}])
    put(tmp_path / "deep" / "b.json", [])
    put(tmp_path / "deep" / "c.json", [{"id": None}])
    got = R.read_arrays(spark, str(tmp_path)).select(F.element_at(F.split("file", "/"), -1), "pos", R.field(F.col("v"), "id", "string"), R.has_field(F.col("v"), "id")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("a.json", 0, "é", True), ("a.json", 1, None, True), ("c.json", 0, None, True)]
    put(tmp_path / "bad" / "d.json", {"id": 1})
    with pytest.raises(R.InputError):
        R.read_arrays(spark, str(tmp_path / "bad"))
    put(tmp_path / "worse" / "e.json", [1])
    with pytest.raises(R.InputError):
        R.read_arrays(spark, str(tmp_path / "worse"))
    with pytest.raises(R.InputError):
        R.read_arrays(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "name,text,n",
    [("a.jsonl", '{"i": 1}\n\n{"i": 2}\n', 2), ("b.json", [{"i": 1}] * 3, 3), ("c.json", {"x": 1, "items": [{"i": 1}]}, 1), ("d.json", {"train": [{"i": 1}, {"i": 2}], "items": []}, 2), ("e.json", {"i": 1}, 1), ("f.json", "", 0)],
)
def test_containers(spark, tmp_path, name, text, n):
    assert R.read_container(spark, put(tmp_path / name, text)).count() == n


def test_container_errors(spark, tmp_path):
    with pytest.raises(R.InputError):
        R.read_container(spark, put(tmp_path / "x.json", "17")).count()


def test_loose_values(spark, tmp_path):
    rows = [{"validity": v} for v in (True, "yes", " Valid ", 0, "maybe", None)] + [{}]
    x = R.read_container(spark, put(tmp_path / "a.json", rows)).orderBy("pos")
    assert [r[0] for r in x.select(R.loose_label(F.col("v"), "validity", "MISSING")).collect()] == ["true", "true", "true", "false", "maybe", None, "MISSING"]
    rows = [{"relevant_premises": [2, 0]}, {"relevant_premises": "premises 1 and 4"}, {"relevant_premises": None, "relevant": [9]}, {"relevant": [7]}, {"relevant_premises": []}, {}]
    x = R.read_container(spark, put(tmp_path / "b.json", rows)).orderBy("pos")
    assert [r[0] for r in x.select(R.loose_indexes(F.col("v"))).collect()] == [[2, 0], [1, 4], [], [7], [], []]


def test_base_rows(spark, tmp_path):
    rows = [{"syllogism": "A.", "validity": True}, {"syllogism": "B.", "validity": "yes"}, {"validity": True}]
    assert [r.syllogism for r in R.base_rows(R.read_container(spark, put(tmp_path / "a.json", rows))).collect()] == ["A."]
    with pytest.raises(R.InputError):
        R.base_rows(R.read_container(spark, put(tmp_path / "b.json", rows[1:])))


def test_arrays_are_dealt_to_files(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('é "'), F.col("id").cast("string"))).alias("t"))
    R.write_arrays(df, str(tmp_path / "a"), F.col("id"), rows_per_file=5)
    files = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("*.json")]
    assert len(files) > 2 and sorted(x["id"] for f in files for x in f) == list(range(25)) and all(set(x) == {"id", "t"} for f in files for x in f)
    back = R.read_training(spark, [str(tmp_path / "a")], "id long, t string")
    assert back.exceptAll(df).count() == 0 and back.count() == 25


def test_lines_and_items_must_be_objects(spark, tmp_path):
    for name, text in (("a.jsonl", '{"i": 1}\n17\n'), ("b.jsonl", '{"i": \n'), ("c.json", '[{"i": 1}, 2]'), ("d.json", '{"data": [1]}')):
        with pytest.raises(R.InputError):
            R.read_container(spark, put(tmp_path / name, text))


def test_arrays_in_ranges_equal_whole_files(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    odd = ['a"b', "\\\\", '\\"', "[{,}]", "é文", "x" * 40, "", "},{", "\n\t", '\\\\"']
    value = lambda d: r.choice([r.choice(odd), r.randrange(99), None, True, [r.choice(odd)] * 2, {"k": [{"z": r.choice(odd)}]}] if d else odd)
    rows = [{f"k{j}": value(1) for j in range(r.randrange(4))} for _ in range(120)]
    paths = [put(tmp_path / f"{k}.json", json.dumps(rows[: 40 * k], indent=k or None, ensure_ascii=k % 2 == 0)) for k in range(4)]
    want = [[json.dumps(x) for x in rows[: 40 * k]] for k in range(4)]
    for least in (1, 2, 3, 7, 50, 1 << 20):
        for k, p in enumerate(paths):
            size = os.path.getsize(p)
            if least < 7 and k > 1:
                continue
            parts = [arrays.Range(p, size, at, min(at + least, size)) for at in range(0, size, least)]
            state = [False, 0, 0, 0]
            for x in parts:
                x.inside, x.depth, x.pos, x.begun = bool(state[0]), state[1], state[2], bool(state[3])
                c = json.loads(json.dumps(arrays.changes(x)))
                i = int(state[0])
                state = [i ^ c["inside"], state[1] + c["depth"][i], state[2] + c["commas"][i].get(str(1 - state[1]), 0), state[3] + c["seen"][i]]
            got = [y for x in parts for y in arrays.items(x)]
            assert [y[1] for y in got] == list(range(len(want[k]))) and [json.dumps(json.loads(y[2])) for y in got] == want[k]
    got = arrays.array_items(spark, [(p, os.path.getsize(p)) for p in paths], least=500)
    assert got.rdd.getNumPartitions() > 8
    by = sorted((x.file, x.pos, json.dumps(json.loads(x.json))) for x in got.collect())
    assert by == sorted((p, i, t) for p, w in zip(paths, want) for i, t in enumerate(w))


@pytest.mark.parametrize("text", ["", " ", "17", "{}", '[{"a": 1}', '[{"a": 1}] x', '[{"a": 1}]]', '[{"a": "x]', "[1]", '[{"a": 1},]', '[{"a": 1} {"b": 2}]', '[{"a": 1]}', "[,]"])
@pytest.mark.parametrize("least", [3, 1 << 20])
def test_wrong_arrays_are_errors(spark, tmp_path, monkeypatch, text, least):
    monkeypatch.setattr(arrays.array_items, "__defaults__", (least,))
    p = put(tmp_path / "a.json", text)
    with pytest.raises(R.InputError):
        R.read_arrays(spark, p)
    with pytest.raises(R.InputError):
        R.read_training(spark, [p], "a long")


def test_training_files_lack_no_required_key(spark, tmp_path):
    p = put(tmp_path / "a.json", [{"a": 1, "b": None}, {"b": 2}])
    assert R.read_training(spark, [p], "a long, b long", required=("b",)).count() == 2
    with pytest.raises(R.InputError, match="item 1"):
        R.read_training(spark, [p], "a long, b long", required=("a",))


def test_long_rows_are_streamed_and_nothing_is_seen_after_a_failure(spark, tmp_path):
    df = spark.range(60).select("id", F.repeat(F.lit("é" * 50), 3_000).alias("t"))
    R.write_arrays(df, str(tmp_path / "a"), F.col("id"), rows_per_file=30)
    assert sorted(p.suffix for p in (tmp_path / "a").iterdir()) == [".json", ".json"]
    assert R.read_training(spark, [str(tmp_path / "a")], "id long, t string").agg(F.sum(F.length("t"))).first()[0] == 60 * 150_000
    with pytest.raises(R.InputError):
        R.write_arrays(df, str(tmp_path / "a"), F.col("id"))
    R.write_arrays(df.limit(0), str(tmp_path / "none"), F.col("id"))
    assert R.read_arrays(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="stop"):
        R.write_arrays(df.select("id", F.when(F.col("id") < 50, "x").otherwise(F.raise_error(F.lit("stop"))).alias("t")), str(tmp_path / "b"), F.col("id"), 5)
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").glob("part-*"))


def test_csv_keeps_null_and_empty_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "", " a "), (2, None, '"'), (3, "x,\ny", None), (4, "\\N", "NULL")], "i int, t string, u string")
    assert sorted(map(str, R.csv_round_trip(df, str(tmp_path / "c")).collect())) == sorted(map(str, df.collect()))


def test_round_trips(spark, tmp_path):
    schema = "id string, text string, ok boolean"
    a = put(tmp_path / "a.json", [{"id": "1", "text": 'é "q"\n, x', "ok": True}, {"id": "2", "text": "", "ok": None}])
    df = R.read_training(spark, [a, a], schema)
    assert df.count() == 4
    R.to_lines(spark, a, str(tmp_path / "lines"), schema)
    assert spark.read.schema(schema).json(str(tmp_path / "lines")).exceptAll(df.distinct()).count() == 0
    back = R.csv_round_trip(df.filter("id = '1'"), str(tmp_path / "csv"))
    assert back.exceptAll(df).count() == 0 and back.count() == 2
