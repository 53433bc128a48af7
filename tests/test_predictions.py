"""The confidence of labelled documents."""

from quillspark.workloads import evaluation


def test_joining_labels_moves_no_text(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, None), (3, "word " * 500), (None, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (9, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = evaluation.predictions(spark, str(tmp_path))
    join = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in join.nodeName():
        join = join.children().apply(0)
    assert not any("text#" in str(join.children().apply(i).output()) for i in range(2))
    # A missing text has no count, and the least of one and nothing is one.
    assert sorted((r["confidence"], r["correct"]) for r in found.collect()) == [(3 / 400, True), (1.0, False), (1.0, False), (1.0, True)]
