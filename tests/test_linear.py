"""Work that grows with a text, not with its length times what is asked of it."""

import time

from pyspark.sql import functions as F

from veilspark.operators import store
from veilspark.operators.detect import routed


def _took(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_changed_reads_a_text_a_few_times(spark):
    """400 texts of 5,000 characters that differ in the middle, and what the ends are."""
    docs = spark.range(400).select(F.repeat(F.concat("id", F.lit(" 王洋 abc ")), 420).alias("a")).withColumn("b", F.concat(F.substring("a", 1, 2000), F.lit("X"), F.expr("substring(a, 2001)")))
    held = docs.localCheckpoint().select("a", "b").withColumn("c", store.changed(F.col("a"), F.col("b")))
    _took(held.limit(1))
    assert _took(held) < 6
    assert held.where("c.prefix != 2000 or c.changed != 1 or c.prefix + c.suffix != length(a)").count() == 0


def test_routing_costs_little_more_than_its_slowest_pattern(spark):
    """Plain texts of 20,000 characters without an end mark, against a search of one pattern."""
    docs = spark.range(400).select(F.repeat(F.concat(F.lit("Summit Hospital and so on "), "id"), 720).alias("text")).localCheckpoint()
    plain, whole = docs.select(F.col("text").rlike("(?i)zq|work(?:s|ed)? at|contact|address|email|phone|my name")), docs.select(routed("text"))
    for df in (plain, whole):
        _took(df.limit(1))
    assert min(_took(whole) for _ in range(2)) < 5 * min(_took(plain) for _ in range(2))
