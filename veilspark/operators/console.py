"""Data operations behind a reviewer's screens: term lists, facets, highlights, diffs, previews, status records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import clusters, matches, quoted
from veilspark.functions.tables import EPSILON
from veilspark.operators.detect import java_pattern
from veilspark.operators.knowledge import stripped
from veilspark.operators.store import changed


def terms(text: Column) -> Column:
    """A typed list of terms, cut at commas of either script and at line feeds."""
    return F.filter(F.transform(F.split(text, "[，,\n]"), stripped), lambda t: t != "")


def facet(rows: DataFrame, kind: str = "all", search: str = "") -> DataFrame:
    """Open spans of a facet (all, conflict, low: score under 0.8, boundary: the reason names it) whose text or context has the search string."""
    out = rows.where({"all": "true", "conflict": "conflict", "low": "coalesce(score, 0) < 0.8", "boundary": "reason like '%边界%'"}[kind])
    return out.where(F.col("entity").contains(search) | F.col("context").contains(search)) if search else out


def drawable(spans: Column) -> Column:
    """Spans that can be drawn left to right: each begins where the one drawn before it ends, or later."""
    kept = F.array().cast("array<struct<start:int,end:int>>")
    slim = F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    fold = lambda out, s: F.when((F.size(out) == 0) | (s["start"] >= F.try_element_at(out, F.lit(-1))["end"]), F.concat(out, F.array(s))).otherwise(out)
    return F.flatten(F.transform(clusters(slim), lambda group: F.aggregate(group, kept, fold)))


def highlight(context: str, entity: str) -> Column:
    """What stands before the first occurrence of the entity (both column names), and what stands after it."""
    at = F.expr(f"instr({context}, {entity})")
    after = F.expr(f"substring({context}, instr({context}, {entity}) + length({entity}))")
    return F.struct(F.when(at > 0, F.expr(f"left({context}, instr({context}, {entity}) - 1)")).otherwise(F.col(context)).alias("before"), F.when(at > 0, after).otherwise("").alias("after"))


def diff(a: Column, b: Column) -> Column:
    """Common prefix, what was there, what is there now, common suffix."""
    c = changed(a, b)
    part = lambda t: F.substring(t, c["prefix"] + 1, F.length(t) - c["prefix"] - c["suffix"])
    return F.struct(F.substring(a, F.lit(1), c["prefix"]).alias("prefix"), part(a).alias("before"), part(b).alias("after"), F.right(a, c["suffix"]).alias("suffix"))


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def rule_preview(spark: SparkSession, text: str, rule: dict, most: int = 20) -> DataFrame:
    """The first matches of a rule in a sample text; an invalid rule raises before a plan exists."""
    pattern = java_pattern(rule)
    if pattern is None:
        raise ValueError("the rule cannot be used")
    found = spark.createDataFrame([(text,)], "text string").select(F.explode(F.slice(matches("text", quoted(pattern)), 1, most)).alias("m"))
    return found.select("m.start", "m.end", "m.text")


def upload_summary(files: DataFrame) -> DataFrame:
    """Number of files and their size in KB."""
    return files.agg(F.count("*").alias("n_files"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024, 1).alias("kb"))


def first_failures(dead: DataFrame, most: int = 5) -> DataFrame:
    return dead.orderBy("file", "row").limit(most)


def mechanism(strength: int) -> dict:
    """What a report says about the pseudonym draw."""
    return {"mechanism": "exponential", "epsilon": EPSILON[max(1, min(3, strength))], "utility": "semantic-feature-cosine", "utility_sensitivity": 1.0, "random_source": "keyed-hash"}


def knowledge_status(remote: bool = False, cached: int = 0) -> dict:
    """What a report says about the knowledge levels."""
    return {"mode": "remote" if remote else "local", "providers": [], "cache_entries": cached}


def check_ranges(rows: DataFrame) -> DataFrame:
    """Settings rows (``retention_days, strength, replacement``) with the reason why one is refused, else null."""
    bad = F.when(~F.col("retention_days").between(1, 3650), "retention_days").when(~F.col("strength").between(1, 3), "strength").when(F.length("replacement") > 500, "replacement")
    return rows.withColumn("refused", bad)
