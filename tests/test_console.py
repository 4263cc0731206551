import pytest
from pyspark.sql import functions as F

from veilspark.operators import console


def test_diff_and_terms(spark):
    rows = spark.createDataFrame([("abcde", "abXYe"), ("", "n"), ("same", "same")], "a string, b string")
    got = [tuple(r["d"]) for r in rows.select(console.diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [("ab", "cd", "XY", "e"), ("", "", "n", ""), ("same", "", "", "")]
    assert rows.limit(1).select(console.terms(F.lit(" a，b,\n , c "))).first()[0] == ["a", "b", "c"]


def test_rule_preview(spark):
    found = console.rule_preview(spark, "x1 x2 " * 30, {"kind": "regex", "pattern": "x[0-9]", "entity_type": "CUSTOM"})
    assert found.count() == 20 and found.first()["end"] == 2
    with pytest.raises(ValueError):
        console.rule_preview(spark, "x", {"kind": "regex", "pattern": "[", "entity_type": "CUSTOM"})


def test_facets(spark):
    rows = spark.createDataFrame([("a", "xay", True, 0.9), ("b", "zb", False, 0.5)], "entity string, context string, conflict boolean, score double")
    assert [r["entity"] for r in console.facet(rows, "conflict").collect()] == ["a"]
    assert [r["entity"] for r in console.facet(rows, "low").collect()] == ["b"]
    assert [r["entity"] for r in console.facet(rows, "all", "z").collect()] == ["b"]
    assert console.mechanism(9)["epsilon"] == 4.0 and console.knowledge_status()["mode"] == "local"
    assert console.first_failures(spark.createDataFrame([("f", i) for i in range(9)], "file string, row int")).count() == 5
    assert console.upload_summary(spark.createDataFrame([(2048,)], "bytes bigint")).first()["kb"] == 2.0
