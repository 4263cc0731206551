"""Review of tasks: nine operations on spans, their checks, and what follows from them.

A task is a row; its events are folded in order within it.  An event that a check
refuses leaves the task as it was and is recorded with its reason.  Redaction and
summary follow once, from the spans that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import bound, intact
from veilspark.functions.tables import ENTITY_TYPES, STRATEGIES
from veilspark.operators.anonymize import redacted
from veilspark.operators.summary import active, pending, risk, risk_score

SPAN = "struct<id:string,start:int,end:int,text:string,entity_type:string,score:double,sources:array<string>,status:string,conflict:boolean,strategy:string,replacement:string,last_operation:string>"
SPANS = f"array<{SPAN}>"
#: Columns of an event: its order, what is done, the span meant, the new value, and the whole span of an ``add``.
EVENT = f"struct<ord:bigint,operation:string,span_id:string,after:string,span:{SPAN}>"
ON_SPANS = ("accept", "reject", "change_type", "adjust_boundary", "set_span_strategy", "set_replacement")
ON_TASKS = ("add", "set_strategy", "set_strength")
MOST_REPLACEMENT = 500


def _bounds(after: Column) -> Column:
    """``start`` and ``end`` of "start:end", nulls where the form is another."""
    of = lambda k: F.regexp_extract(after, r"^\s*([0-9]{1,9})\s*:\s*([0-9]{1,9})\s*$", k)
    return F.struct(*[F.when(of(k) != "", of(k)).cast("int").alias(n) for k, n in ((1, "start"), (2, "end"))])


def _changed(text: Column, s: Column, e: Column) -> Column:
    """A span after an event on it."""
    op, after, at = e["operation"], e["after"], _bounds(e["after"])
    moved = op == "adjust_boundary"
    return F.struct(
        s["id"].alias("id"),
        F.when(moved, at["start"]).otherwise(s["start"]).alias("start"),
        F.when(moved, at["end"]).otherwise(s["end"]).alias("end"),
        F.when(moved, F.substring(text, at["start"] + 1, at["end"] - at["start"])).otherwise(s["text"]).alias("text"),
        F.when(op == "change_type", after).otherwise(s["entity_type"]).alias("entity_type"),
        s["score"].alias("score"),
        _human(s["sources"]).alias("sources"),
        F.when(op == "reject", "rejected").otherwise("accepted").alias("status"),
        F.when(op.isin("set_span_strategy", "set_replacement"), s["conflict"]).otherwise(False).alias("conflict"),
        F.when(op == "set_span_strategy", after).otherwise(s["strategy"]).alias("strategy"),
        F.when(op == "set_replacement", F.nullif(after, F.lit(""))).otherwise(s["replacement"]).alias("replacement"),
        op.alias("last_operation"),
    )


def _human(sources: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(sources, F.array().cast("array<string>")), F.array(F.lit("HUMAN"))))


def _refusal(text: Column, spans: Column, e: Column) -> Column:
    """Why an event cannot be applied to these spans; null where it can."""
    op, after, at = e["operation"], e["after"], _bounds(e["after"])
    known = F.exists(spans, lambda s: s["id"] == e["span_id"])
    return (
        F.when(~F.coalesce(op, F.lit("")).isin(*ON_SPANS, *ON_TASKS), "unknown operation")
        .when((op == "add") & (e["span"].isNull() | ~e["span"]["id"].eqNullSafe(e["span_id"])), "incomplete span")
        .when((op == "add") & known, "span id exists")
        .when((op == "set_strategy") & ~F.coalesce(after, F.lit("")).isin(*STRATEGIES), "unknown strategy")
        .when((op == "set_strength") & ~F.coalesce(F.trim(after), F.lit("")).isin("1", "2", "3"), "strength is not 1, 2 or 3")
        .when(op.isin(*ON_SPANS) & ~known, "no such span")
        .when((op == "change_type") & ~F.coalesce(after, F.lit("")).isin(*ENTITY_TYPES), "unknown type")
        .when((op == "set_span_strategy") & ~F.coalesce(after, F.lit("")).isin(*STRATEGIES), "unknown strategy")
        .when((op == "set_replacement") & (F.length(after) > MOST_REPLACEMENT), "replacement too long")
        .when((op == "adjust_boundary") & at["end"].isNull(), "boundary is not start:end")
        .when((op == "adjust_boundary") & ~((at["start"] < at["end"]) & (at["end"] <= F.length(text))), "boundary outside the text")
    )


def _broken(text: Column, spans: Column) -> Column:
    """The invariant that sorted spans break; null where they keep all."""
    live = F.filter(spans, lambda s: s["status"] != "rejected")
    meets = bound(live, lambda a: F.exists(F.transform(a, lambda s, i: (i > 0) & (s["start"] < F.get(a, i - 1)["end"])), lambda x: x))
    return F.when(F.exists(spans, lambda s: ~F.coalesce(intact(text, s), F.lit(False))), "offsets do not give the text").when(meets, "active spans overlap")


def _ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def apply(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks after their events.

    ``tasks``: ``task_id, text, spans`` (SPANS), ``strategy, privacy_strength, risk_level, final_text,
    has_manual_edits``.  ``events``: ``task_id`` and the fields of EVENT.  Spans come back sorted, with
    ``redacted_text`` made anew by each span's own strategy, ``final_text`` the same unless it was edited by hand,
    ``refused`` (``ord, reason``) and the summary ``entity_count, pending_count, risk_score, risk``.  Events of one
    task are few: they are people's.
    """
    folded = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ord", "operation", "span_id", "after", "span").cast(EVENT))).alias("events"))
    rows = tasks.withColumn("spans", F.col("spans").cast(SPANS)).join(folded, "task_id", "left")
    text = F.col("text")
    start = F.struct(_ordered(F.col("spans")).alias("spans"), F.col("strategy").alias("strategy"), F.col("privacy_strength").cast("int").alias("strength"), F.array().cast("array<struct<ord:bigint,reason:string>>").alias("refused"))

    def step(a: Column, e: Column) -> Column:
        op = e["operation"]
        added = e["span"].withField("sources", _human(e["span"]["sources"])).withField("last_operation", F.lit("add"))
        spans = (
            F.when(op == "add", F.concat(a["spans"], F.array(added.cast(SPAN))))
            .when(op == "set_strategy", F.transform(a["spans"], lambda s: s.withField("strategy", e["after"])))
            .when(op.isin(*ON_SPANS), F.transform(a["spans"], lambda s: F.when(s["id"] == e["span_id"], _changed(text, s, e)).otherwise(s)))
            .otherwise(a["spans"])
        )

        def decided(first: Column) -> Column:
            def checked(new: Column) -> Column:
                reason = F.coalesce(first, _broken(text, new))
                return bound(reason, lambda r: F.struct(
                    F.when(r.isNull(), new).otherwise(a["spans"]).alias("spans"),
                    F.when(r.isNull() & (op == "set_strategy"), e["after"]).otherwise(a["strategy"]).alias("strategy"),
                    F.when(r.isNull() & (op == "set_strength"), F.trim(e["after"]).cast("int")).otherwise(a["strength"]).alias("strength"),
                    F.when(r.isNull(), a["refused"]).otherwise(F.concat(a["refused"], F.array(F.struct(e["ord"].alias("ord"), r.alias("reason"))))).alias("refused"),
                ))

            return bound(F.when(first.isNull(), _ordered(spans)).otherwise(a["spans"]), checked)

        return bound(_refusal(text, a["spans"], e), decided)

    state = F.when(F.col("events").isNull(), start).otherwise(F.aggregate("events", start, step))
    rows = rows.withColumn("state", state)
    rows = rows.withColumns({"spans": F.col("state.spans"), "strategy": F.col("state.strategy"), "privacy_strength": F.col("state.strength"), "refused": F.col("state.refused")})
    rows = rows.withColumn("redacted_text", regenerated(rows))
    final = F.when(F.coalesce("has_manual_edits", F.lit(False)), F.col("final_text")).otherwise(F.col("redacted_text"))
    rows = rows.withColumn("final_text", final).withColumn("entity_count", F.size(active(F.col("spans")))).withColumn("pending_count", pending(active(F.col("spans"))))
    rows = rows.withColumn("risk_score", risk_score(F.col("spans"))).withColumn("risk", risk(F.col("risk_score")))
    made = ["redacted_text", "refused", "entity_count", "pending_count", "risk_score", "risk"]
    return rows.select(*[c for c in tasks.columns if c not in made], *made)


def regenerated(tasks: DataFrame) -> Column:
    """The redaction of reviewed tasks: each span by its own strategy or replacement, at the task's strength; pending spans in strict tasks only."""
    spans = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "text", "entity_type", "score", "sources", "status", "conflict", "strategy")], F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("rule_name"), s["replacement"].alias("replacement")))
    kept = F.filter(spans, lambda s: (F.coalesce(F.col("risk_level"), F.lit("strict")) == "strict") | (s["status"] == "accepted"))
    text = lambda k: redacted(F.col("text"), kept, F.col("task_id"), None, k, own=True)
    return F.when(F.col("privacy_strength") == 1, text(1)).when(F.col("privacy_strength") == 3, text(3)).otherwise(text(2))
