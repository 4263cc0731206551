"""Counts, risk and evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.tables import RISK_CAP, RISK_HEAVY, RISK_HEAVY_WEIGHT, RISK_HIGH, RISK_MEDIUM, RISK_WEIGHT


def active(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["status"] != "rejected")


def weight(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*RISK_HEAVY), RISK_HEAVY_WEIGHT).otherwise(RISK_WEIGHT)


def risk_score(spans: Column) -> Column:
    return F.least(F.lit(RISK_CAP), F.aggregate(active(spans), F.lit(0), lambda a, s: a + weight(s["entity_type"])))


def risk(score: Column) -> Column:
    return F.when(score >= RISK_HIGH, "high").when(score >= RISK_MEDIUM, "medium").otherwise("low")


def pending(spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["status"] == "pending"))


def needs_review(spans: Column) -> Column:
    """Any pending span or conflict, rejected spans included."""
    return F.exists(spans, lambda s: (s["status"] == "pending") | s["conflict"])


def by_type(spans: DataFrame) -> DataFrame:
    """Active spans of a document by type, long form."""
    return spans.where("status != 'rejected'").groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


def type_rollup(spans: DataFrame) -> DataFrame:
    """Counts by type and in all (type null), in one pass."""
    return spans.rollup("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("n_pending"))


def progress(processed: Column, total: Column) -> Column:
    """Percent done, half to even; 100 where there is nothing to do."""
    return F.when(total == 0, 100).otherwise(F.bround(processed / total * 100).cast("int"))


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact-span tp, fp, fn, precision, recall and F1 by type and in all (type ALL).

    Both have ``doc_id, start, end, entity_type``; repeated spans count once.
    """
    keys = ["doc_id", "start", "end", "entity_type"]
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    met = p.join(g, keys, "full")
    counted = met.rollup("entity_type").agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rated = counted.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    rated = rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rated.withColumn("entity_type", F.coalesce("entity_type", F.lit("ALL")))


def best_system(reports: DataFrame) -> DataFrame:
    """The report with the best F1, the first on ties (columns ``ord, name, f1``)."""
    return reports.orderBy(F.desc("f1"), "ord").limit(1)


def mean_latency(runs: DataFrame) -> DataFrame:
    """The mean of ``ms``; 0 where nothing ran."""
    return runs.agg(F.coalesce(F.avg("ms"), F.lit(0.0)).alias("latency"))


def report(rated: DataFrame, latency: DataFrame, name: str, dataset: str, records: int) -> DataFrame:
    """An evaluation as one JSON row: the system's figures, recall by type in order, and what was measured."""
    everything = rated.where("entity_type = 'ALL'").select("precision", "recall", "f1").crossJoin(latency)
    system = everything.select(F.struct(F.lit(name).alias("name"), "precision", "recall", "f1", "latency").alias("system"))
    types = rated.where("entity_type != 'ALL'").agg(F.array_sort(F.collect_list(F.struct(F.col("entity_type").alias("name"), "recall"))).alias("categories"))  # a row for each type
    meta = F.struct(F.lit(dataset).alias("dataset"), F.lit(records).alias("records"), F.lit("exact-span").alias("metric"))
    return system.crossJoin(types).select(F.to_json(F.struct(F.array("system").alias("systems"), "categories", meta.alias("metadata"))).alias("value"))
