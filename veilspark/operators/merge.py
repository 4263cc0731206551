"""Interval merge with conflict resolution, and interval predicates, on packed spans.

Candidates are taken in order of start, longest first, then best score, then
input order.  Kept spans are then disjoint and sorted, so a candidate can only
meet the last one kept; the merge is a fold within the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.spans import all_intact, bound, clusters, empty_spans, has_cjk, has_latin, matches, overlaps, quoted
from veilspark.functions.tables import NAMED_TYPES


def _score(s: Column) -> Column:
    return F.coalesce(s["score"], F.lit(0.0))


def _twin(kept: Column, new: Column) -> Column:
    """One span from two with the same bounds: sources united, the better type, the best score."""
    differ = kept["entity_type"] != new["entity_type"]
    better = _score(new) > _score(kept)
    return F.struct(
        kept["start"].alias("start"),
        kept["end"].alias("end"),
        kept["text"].alias("text"),
        F.when(differ & better, new["entity_type"]).otherwise(kept["entity_type"]).alias("entity_type"),
        F.greatest(_score(kept), _score(new)).alias("score"),
        F.array_sort(F.array_union(kept["sources"], new["sources"])).alias("sources"),
        F.when(differ, "pending").otherwise(kept["status"]).alias("status"),
        (kept["conflict"] | differ).alias("conflict"),
        kept["strategy"].alias("strategy"),
        kept["rule_id"].alias("rule_id"),
        kept["rule_name"].alias("rule_name"),
    )


def _contested(s: Column) -> Column:
    return s.withField("conflict", F.lit(True)).withField("status", F.lit("pending"))


def _rank(s: Column) -> Column:
    return F.struct(s["status"] != "rejected", _score(s), s["end"] - s["start"])


def merged(text: Column, spans: Column) -> Column:
    """The merge of an array of spans over its text; spans that do not fit the text are dropped.

    Spans that stand apart from all before them begin a new group; each group is
    folded by itself, so work is linear but for spans that all hang together.
    """
    def ordered(fit: Column) -> Column:
        keyed = F.transform(fit, lambda s, i: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-_score(s)).alias("c"), i.alias("d"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(kept: Column, new: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        before = F.slice(kept, 1, F.size(kept) - 1)
        twin = (last["start"] == new["start"]) & (last["end"] == new["end"])
        winner = F.when(_rank(new) > _rank(last), _contested(new)).otherwise(_contested(last))
        return (
            F.when(F.size(kept) == 0, F.array(new))
            .when(twin, F.concat(before, F.array(_twin(last, new))))
            .when(overlaps(new, last), F.concat(before, F.array(winner)))
            .otherwise(F.concat(kept, F.array(new)))
        )

    fold = lambda group: F.when(F.size(group) < 2, group).otherwise(F.aggregate(group, empty_spans(), step))
    return bound(all_intact(text, spans), lambda fit: F.when(F.size(fit) < 2, fit).otherwise(F.flatten(F.transform(clusters(ordered(fit)), fold))))


def in_language(spans: Column, language: str) -> Column:
    """Named entities of another script are dropped; other types stay."""
    if language in ("auto", "mixed", "multilingual"):
        return spans
    script = has_cjk if language == "zh" else has_latin
    return F.filter(spans, lambda s: ~s["entity_type"].isin(*NAMED_TYPES) | script(s["text"]))


def preserved(text: str, terms: list[str]) -> Column:
    """Ranges of the terms to preserve, found without regard to case."""
    from veilspark.operators.detect import java_pattern

    terms = list(dict.fromkeys(t.strip() for t in terms if t.strip()))
    found = [matches(text, quoted(java_pattern({"kind": "keyword", "pattern": t, "entity_type": "CUSTOM"}))) for t in terms]
    return F.concat(*found) if found else F.array().cast("array<struct<start:int,end:int,text:string>>")


def without(spans: Column, ranges: Column) -> Column:
    """Spans that overlap none of the ranges: an interval anti-join within the row."""
    return F.filter(spans, lambda s: ~F.exists(ranges, lambda r: overlaps(s, r)))


def anti_overlap(spans: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form of :func:`without`: rows of ``spans`` that overlap no row of ``ranges`` with the same key."""
    r = ranges.select(F.col(key).alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return spans.join(r, (F.col(key) == F.col("r_key")) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")), "left_anti")


def overlapping(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Active spans that begin before the one before them ends."""
    w = Window.partitionBy(key).orderBy("start", "end")
    return spans.where("status != 'rejected'").withColumn("before", F.lag("end").over(w)).where("before > start").drop("before")
