"""Null keys, null vectors and the words of the session."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions.vectors import matrix_of
from quillspark.operators.dense import dense_top
from quillspark.operators.ordered import last_before, order_statistics, running
from quillspark.operators.usage import quota_decisions


def test_running_keeps_null_keys_and_slices(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", None, 7), (None, 2, 3), (None, 3, 4), (None, None, 1)], "k string, t int, v int")
    found = running(rows, ["k"], ["t"], F.col("t"), {"upto": F.col("v")}, {"whole": F.col("v")}).collect()
    assert sorted(((r["k"], r["t"], r["upto"], r["whole"]) for r in found), key=repr) == sorted(
        [("a", None, 7, 12), ("a", 1, 12, 12), (None, None, 1, 8), (None, 2, 4, 8), (None, 3, 8, 8)], key=repr)
    before = last_before(rows, ["k"], ["t"], F.col("t"), {"last": F.col("v")}).collect()
    assert {(r["k"], r["t"]): r["last"] for r in before} == {("a", None): None, ("a", 1): 7, (None, None): None, (None, 2): 1, (None, 3): 3}


def test_order_statistics_of_a_null_key(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 9.0), (None, 5.0), ("a", 2.0)], "k string, v double")
    found = order_statistics(rows, ["k"], "v", F.floor("v"), {"middle": F.floor(F.col("n") / 2)})
    assert {r["k"]: (r["n"], r["middle"]) for r in found.collect()} == {None: (3, 5.0), "a": (1, 2.0)}


def test_requests_without_user_or_time_are_decided(spark):
    day = dt.datetime(2024, 1, 1, 10)
    rows = spark.createDataFrame([(1, "free", "ask", day, 1), (None, "free", "ask", day, 2), (1, "free", "ask", None, 3), (1, "premium", "ask", None, 4)],
                                 "user_id long, tier string, limit_type string, ts timestamp, event_id long")
    assert sorted(r["event_id"] for r in quota_decisions(rows, ["ts", "event_id"]).collect()) == [1, 2, 3, 4]


def test_null_vectors_are_rows_of_zeros(spark):
    assert matrix_of(pa.array([[1.0, 2.0], None, [3.0, 4.0]])).tolist() == [[1, 2], [0, 0], [3, 4]]
    wide = [float(i % 7) for i in range(384)]
    corpus = spark.createDataFrame([("s", 1, wide), ("s", 2, None), ("s", 3, [-x for x in wide])], "scope string, chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, wide), (2, None)], "query_id long, embedding array<double>")
    best = dense_top(asked, corpus, 1).where("query_id = 1").first()
    assert best["chunk_id"] == 1 and round(best["score"], 6) == 1.0
