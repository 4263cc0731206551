"""Deterministic parsing of redaction instructions in natural language, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.tables import FORCE_WORDS, KEEP_CUT, KEEP_WORDS, NOT_TERMS, ONLY_SCOPE, STRATEGY_WORDS, STRENGTH_WORDS, TERM_SUFFIX, TYPE_ALIASES
from veilspark.operators.knowledge import stripped


def _mentions(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words))


def _terms(instruction: Column, pattern: str, cut: bool) -> Column:
    found = F.regexp_extract_all(instruction, F.lit(pattern), F.lit(1))
    found = F.transform(found, lambda t: stripped(F.get(F.split(stripped(t), KEEP_CUT, 2), F.lit(0)) if cut else t))
    bare = lambda t: stripped(F.regexp_replace(F.regexp_replace(stripped(t), "^[“”\"' ]+|[“”\"' ]+$", ""), TERM_SUFFIX, ""))
    return F.array_distinct(F.filter(F.transform(found, bare), lambda t: (t != "") & ~t.isin(*NOT_TERMS)))


def plan(instruction: Column) -> Column:
    """A struct of enabled types, terms to preserve and to force, strategy and strength."""
    low = F.lower(instruction)
    types = F.filter(F.array(*[F.when(_mentions(low, words), F.lit(t)) for t, words in TYPE_ALIASES.items()]), lambda t: t.isNotNull())
    strategy = strength = None
    for name, words in STRATEGY_WORDS:
        strategy = F.when(_mentions(low, words), name) if strategy is None else strategy.when(_mentions(low, words), name)
    for level, words in STRENGTH_WORDS:
        strength = F.when(_mentions(low, words), level) if strength is None else strength.when(_mentions(low, words), level)
    return F.struct(
        F.when(low.rlike(ONLY_SCOPE), types).otherwise(F.array().cast("array<string>")).alias("enabled_entity_types"),
        _terms(instruction, KEEP_WORDS, True).alias("preserve_terms"),
        _terms(instruction, FORCE_WORDS, False).alias("force_terms"),
        strategy.alias("strategy"),
        strength.alias("privacy_strength"),
    )


def parse(df: DataFrame, instruction: str = "instruction") -> DataFrame:
    return df.withColumn("plan", plan(F.col(instruction))).select(*df.columns, "plan.*")


def with_fallback(model: Column, local: Column) -> Column:
    """A model's plan, field by field, with the local plan where a field is empty."""
    lists = ("enabled_entity_types", "preserve_terms", "force_terms")
    return F.struct(*[F.when(F.size(F.coalesce(model[k], F.array().cast("array<string>"))) > 0, model[k]).otherwise(local[k]).alias(k) for k in lists], *[F.coalesce(model[k], local[k]).alias(k) for k in ("strategy", "privacy_strength")])
