"""Knowledge hierarchy: exact terms, inference by name features, type fallback."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.tables import EXACT_LEVELS, GENERIC_LEVELS, NAMED_TYPES, ORG_INFERENCE, PLACE_SUFFIXES, PLACE_WORDS

_BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def _any(words, test) -> Column:
    return reduce(lambda a, b: a | b, (test(w) for w in words))


def _levels(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(term: Column, entity_type: Column) -> Column:
    """A struct of ``levels`` (three) and ``source`` for a term of a type."""
    clean = stripped(term)
    low = F.lower(clean)
    out = None

    def add(condition, levels, source):
        nonlocal out
        value = F.struct(_levels(levels).alias("levels"), F.lit(source).alias("source"))
        out = F.when(condition, value) if out is None else out.when(condition, value)

    for name, levels in EXACT_LEVELS.items():
        add(clean == name, levels, "local_exact")
    for zh, en, levels in ORG_INFERENCE:
        add((entity_type == "ORG") & (_any(zh, clean.contains) | _any(en, low.contains)), levels, "local_inferred")
    place = entity_type.isin("LOCATION", "ADDRESS")
    for suffixes, levels in PLACE_SUFFIXES:
        add(place & _any(suffixes, clean.endswith), levels, "local_inferred")
    add(place & _any(PLACE_WORDS[0], clean.contains), PLACE_WORDS[1], "local_inferred")
    for kind, levels in GENERIC_LEVELS.items():
        add(entity_type == kind, levels, "type_fallback")
    return out.otherwise(F.struct(_levels(GENERIC_LEVELS["CUSTOM"]).alias("levels"), F.lit("type_fallback").alias("source")))


def generalized(term: Column, entity_type: Column, strength: int) -> Column:
    return F.element_at(lookup(term, entity_type)["levels"], strength)


def enrich(spans: DataFrame, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Adds ``levels`` and ``level_source`` to long-form spans, by expressions on the row.

    ``cache`` (``term, entity_type, levels, source, expires_at``; one row a key) takes
    precedence while fresh.  Only named types that were not rejected are looked
    up; others get nulls.
    """
    wanted = F.col("entity_type").isin(*NAMED_TYPES) & (F.col("status") != "rejected")
    found = spans.withColumn("x", F.when(wanted, lookup(F.col("text"), F.col("entity_type"))))
    if cache is not None:
        fresh = cache.where(F.col("expires_at") > (F.current_timestamp() if now is None else now))
        fresh = fresh.select(F.lower("term").alias("folded"), F.col("entity_type").alias("t"), F.struct("levels", "source").alias("y")).dropDuplicates(["folded", "t"])
        found = found.join(fresh, wanted & (F.lower("text") == F.col("folded")) & (F.col("entity_type") == F.col("t")), "left").withColumn("x", F.coalesce("y", "x"))
    return found.select(*spans.columns, F.col("x.levels").alias("levels"), F.col("x.source").alias("level_source"))


def collect_strings(value, preferred=("concept", "value", "category", "label", "name", "type")) -> list[str]:
    """All non-blank strings of a parsed JSON value, preferred keys first."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, dict):
        keys = [k for k in preferred if k in value] + [k for k in value if k not in preferred]
        return [s for k in keys for s in collect_strings(value[k], preferred)]
    if isinstance(value, list):
        return [s for v in value for s in collect_strings(v, preferred)]
    return []


def remote_levels(answers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and three levels from ``term, entity_type, body`` (a provider's JSON), short ones padded from local levels."""
    @F.pandas_udf("array<string>")
    def strings(bodies: pd.Series) -> pd.Series:
        def one(body):
            try:
                return list(dict.fromkeys(collect_strings(json.loads(body))))
            except (TypeError, ValueError):
                return []

        return bodies.map(one)

    local = lookup(F.col("term"), F.col("entity_type"))["levels"]
    clean = F.filter(strings("body"), lambda s: (s != F.col("term")) & (F.length(s) <= 80))
    return answers.select("term", "entity_type", *keep, F.slice(F.array_distinct(F.concat(clean, local)), 1, 3).alias("levels"), F.when(F.size(clean) > 0, "remote").otherwise("local_fallback").alias("source"))
