"""The whole redaction plan over a table of documents: one scan, one stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import SPANS
from veilspark.operators.adapters import replies, verified
from veilspark.operators.anonymize import redacted
from veilspark.operators.detect import detect
from veilspark.operators.instruct import plan as instruction_plan
from veilspark.operators.merge import in_language, merged, preserved, without
from veilspark.operators.summary import active, needs_review, pending, risk, risk_score
from veilspark.plans.config import Config


def resolved(spark: SparkSession, config: Config) -> Config:
    """The configuration with its instruction parsed: one small row on the driver, at planning time."""
    if not config.instruction.strip():
        return config
    row = spark.range(1).select(instruction_plan(F.lit(config.instruction.strip())).alias("p")).first()["p"]
    return config.instructed(row.asDict())


def detected(docs: DataFrame, config: Config, model_spans: str | None = None, reply: str | None = None, load=None) -> DataFrame:
    """Adds ``spans``: detected, merged, gated and with preserved terms respected.

    ``model_spans`` names a column of a model's spans (``adapters.entities``), which pass the same gates.  After a
    model's review (``reply``, a column of JSON replies, or ``load`` for ``adapters.replies``) spans are merged and
    gated again.
    """
    found = detect(docs, config.enabled_entity_types, config.language, config.strategy, list(config.custom_rules))
    typed = lambda spans: F.filter(spans, lambda s: s["entity_type"].isin(*config.enabled_entity_types))
    if model_spans:
        found = found.withColumn("candidates", F.concat("candidates", in_language(typed(F.coalesce(model_spans, F.array().cast(SPANS))), config.language)))
    found = found.withColumn("spans", merged(F.col("text"), F.col("candidates"))).drop("candidates")

    def gated(rows: DataFrame) -> DataFrame:
        if config.preserve_terms:
            rows = rows.withColumn("ranges", preserved("text", list(config.preserve_terms))).withColumn("spans", without(F.col("spans"), F.col("ranges"))).drop("ranges")
        return rows.withColumn("spans", in_language(F.col("spans"), config.language)) if config.language in ("zh", "en") else rows

    found = gated(found)
    if load is not None:
        found, reply = replies(found, load, instruction=config.instruction or None), "reply"
    if reply:
        decided = F.when(F.col(reply).isNull(), F.col("spans")).otherwise(verified(F.col("text"), F.col("spans"), F.col(reply), config.strategy))
        found = gated(found.withColumn("spans", typed(merged(F.col("text"), decided))))
    if config.policies:
        policy = F.create_map(*[F.lit(x) for kv in sorted(config.policies.items()) for x in kv])
        found = found.withColumn("spans", F.transform("spans", lambda s: s.withField("strategy", F.coalesce(F.try_element_at(policy, s["entity_type"]), F.lit(config.strategy)))))
    return found


def redact(docs: DataFrame, config: Config | None = None, key: str = "doc_id", **models) -> DataFrame:
    """Adds ``spans``, ``redacted_text`` and the summary to rows with ``key`` and ``text`` (null text: empty); ``models`` as for :func:`detected`."""
    config = resolved(docs.sparkSession, config or Config())
    rows = detected(docs.withColumn("text", F.coalesce("text", F.lit(""))), config, **models)
    strategy = None if config.policies else config.strategy
    text = redacted(F.col("text"), F.col("spans"), F.col(key), strategy, config.privacy_strength, config.risk_level == "strict", seed=config.seed, strategies=tuple({config.strategy, *config.policies.values()}))
    rows = rows.withColumn("redacted_text", text)
    rows = rows.withColumn("n_spans", F.size(active(F.col("spans")))).withColumn("n_pending", pending(F.col("spans"))).withColumn("risk_score", risk_score(F.col("spans")))
    return rows.withColumn("risk", risk(F.col("risk_score"))).withColumn("needs_review", needs_review(F.col("spans")))


def exploded(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form: one row per span.

    A plain explode makes the optimizer ask for non-empty spans first, below the spread: detection twice more, in as
    few tasks as the input has files.
    """
    return rows.select(key, F.explode_outer("spans").alias("s")).where("s IS NOT NULL").select(key, "s.*")
