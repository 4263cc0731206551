"""Mixing needs no Python worker of its own: its driver-made tables go over as Arrow."""

from veilspark.llm import mixing


def test_driver_tables_start_no_python_worker(spark):
    df = mixing._few(spark, [("a", 0, 1, 5, 2.5), (None, 1, 2, 7, 3.5)], "s string, sid int, shards bigint, mix_source_size bigint, mix_target double")
    assert [tuple(r) for r in df.collect()] == [("a", 0, 1, 5, 2.5), (None, 1, 2, 7, 3.5)]
    assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert mixing._few(spark, [], "sid int, mix_shard bigint").count() == 0
