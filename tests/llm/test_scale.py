"""The same rows from another number of partitions, and from joins by shuffle where lists are long."""

import random

import pytest

from test_dedup import docs, near_rows
from veritext.llm import common, minhash_dedup


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_with_ids(spark, most):
    rows = [(i, str(i)) for i in range(20)] + [(None, "n")]
    ids = spark.createDataFrame([(3,), (None,), (3,), (99,)], "i long")
    d = docs(spark, rows)
    assert sorted((r.doc_id or 0) for r in common.rows_with_ids(d, ids, "left_semi", most=most).collect()) == [0, 3]
    assert common.rows_with_ids(d, ids, "left_anti", most=most).count() == 19


def test_near_duplicates_without_broadcast(spark, monkeypatch):
    rows = near_rows(random.Random(8), 80)[:80]
    want = sorted(map(tuple, minhash_dedup.near_duplicates(docs(spark, rows, 1)).collect()))
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, minhash_dedup.near_duplicates(docs(spark, rows, 11)).collect())) == want
