"""Store operations on append-only tables: latest versions, top-k, retention, review events, revisions.

Mutations append versions; the latest version of a key wins on read.  The
driver is the single writer, which is what makes revision checks atomic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.spans import bound
from veilspark.functions.tables import AUDIT_ROWS, CONTEXT, HISTORY_ROWS, JOB_ROWS, PREVIEW, REVIEW_ROWS


def latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last version.  A max over a struct, so versions are combined before the shuffle."""
    rest = [c for c in versions.columns if c not in keys]
    picked = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return picked.select(*keys, *[F.col("v")[c].alias(c) for c in rest]).select(*versions.columns)


def point_get(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def history(tasks: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return top(tasks, HISTORY_ROWS, F.desc(created), F.asc(key))


def audits(events: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return top(events, AUDIT_ROWS, F.desc(created), F.desc(key))


def jobs(rows: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return top(rows, JOB_ROWS, F.desc(created), F.asc(key))


def purge(tasks: DataFrame, events: DataFrame, now: Column, days: int, created: str = "created_at", key: str = "id", ref: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Tasks within retention or without a date, and the events whose task was not purged."""
    if not 1 <= days <= 3650:
        raise ValueError("retention must be 1 to 3650 days")
    old = F.col(created) < now - F.expr(f"INTERVAL {days} DAYS")
    gone = tasks.where(old).select(F.col(key).alias(ref))
    return tasks.where(~F.coalesce(old, F.lit(False))), events.join(gone, ref, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed keys (column ``key``)."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed.select(F.col(key).alias(ref)), ref, "left_anti")


def resolved(events: DataFrame) -> DataFrame:
    """Distinct (task, span) that a reviewer accepted or rejected."""
    return events.where(F.col("operation").isin("accept", "reject")).select("task_id", F.get_json_object("payload", "$.span_id").alias("span_id")).distinct()


def review_queue(tasks: DataFrame, events: DataFrame, newest: int = 100, rows: int = REVIEW_ROWS) -> DataFrame:
    """Open spans of the newest tasks with their context (tasks: ``task_id, created_at, text, spans`` with ids)."""
    recent = top(tasks, newest, F.desc("created_at"), F.asc("task_id"))
    open_ = recent.withColumn("s", F.explode("spans")).where("s.status = 'pending' or s.conflict")
    open_ = open_.select("task_id", "created_at", F.col("s.id").alias("span_id"), F.col("s.start").alias("start"), F.col("s.text").alias("entity"), around(F.col("text"), F.col("s.start"), F.col("s.end")).alias("context"), reason(F.col("s.conflict")).alias("reason"))
    left = open_.join(resolved(events), ["task_id", "span_id"], "left_anti")
    return left.orderBy(F.desc("created_at"), "task_id", "start").limit(rows)


def around(text: Column, start: Column, end: Column, width: int = CONTEXT) -> Column:
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, end + width - first)


def reason(conflict: Column) -> Column:
    return F.when(conflict, "识别器冲突").otherwise("低置信度候选")


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def scoped_rules(rules: DataFrame, project: str | None) -> DataFrame:
    """Global rules and the project's own, oldest first."""
    mine = F.col("project_id").isNull() | (F.col("project_id") == F.lit(project)) if project is not None else F.col("project_id").isNull()
    return rules.where(mine & F.col("enabled")).orderBy("created_at", "id")


def patch(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Partial update: non-null fields of ``new`` replace those of ``old``."""
    fields = [c for c in new.columns if c != key]
    other = new.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return old.join(other, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def policies(stored: Column, given: Column) -> Column:
    """A type-to-strategy map with some entries replaced."""
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)


def hydrate(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Job rows with their task's newest figures; rows whose task is gone keep their own."""
    fresh = tasks.select("task_id", *[F.col(c).alias(f"new_{c}") for c in ("final_text", "final_revision", "entity_count", "pending_count")])
    out = results.join(fresh, "task_id", "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in out.columns else F.col(c) for c in results.columns])


def hashed(text: Column) -> Column:
    """What an audit keeps of a sensitive text."""
    return F.struct(F.length(text).alias("length"), F.sha2(text, 256).alias("sha256"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving: an equal first half is counted and dropped, a different one kept.

    What is left is half as long after each step, so the work is linear in the texts.
    """
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 2)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        half = F.ceil(s["left"] / 2).cast("int")
        first = lambda c: F.substring(s[c], F.lit(1), half)
        rest = lambda c: F.substring(s[c], half + 1, s["left"] - half)
        state = lambda done, a, b, left: F.struct(done.alias("done"), a.alias("a"), b.alias("b"), left.alias("left"))
        same = state(s["done"] + half, rest("a"), rest("b"), s["left"] - half)
        return F.when(first("a") == first("b"), same).otherwise(state(s["done"], first("a"), first("b"), half))

    return F.aggregate(steps, F.struct(F.lit(0).alias("done"), a.alias("a"), b.alias("b"), most.alias("left")), halve, lambda s: s["done"])


def changed(a: Column, b: Column) -> Column:
    """``prefix`` and ``suffix`` lengths that two texts share, and ``changed``: the longer rest."""

    def rest(x: Column) -> Column:
        tails = F.struct(*[F.reverse(F.substring(x[c], x["p"] + 1, F.length(x[c]) - x["p"])).alias(c) for c in ("a", "b")], x["p"].alias("p"))
        return bound(tails, lambda t: F.struct(t["p"].alias("p"), common_prefix(t["a"], t["b"]).alias("s"), F.greatest(F.length(t["a"]), F.length(t["b"])).alias("n")))

    with_prefix = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), common_prefix(x["a"], x["b"]).alias("p"))
    whole = bound(bound(F.struct(a.alias("a"), b.alias("b")), with_prefix), rest)
    return bound(whole, lambda r: F.struct(r["p"].alias("prefix"), r["s"].alias("suffix"), (r["n"] - r["s"]).alias("changed")))


def save_final(versions: DataFrame, task: str, text: str, revision: int) -> DataFrame | None:
    """The row to append for a new final text, None where nothing changed.

    Raises on a stale revision (columns ``task_id, final_text, final_revision``).
    """
    row = versions.where(F.col("task_id") == task).orderBy(F.desc("final_revision")).first()
    if row is None:
        raise LookupError(task)
    if row["final_revision"] != revision:
        raise ValueError(f"revision {revision} is stale; it is {row['final_revision']}")
    if row["final_text"] == text:
        return None
    return versions.sparkSession.createDataFrame([(task, text, revision + 1)], "task_id string, final_text string, final_revision int")


def sanitized(rows: DataFrame) -> DataFrame:
    """Legacy job rows (``text, text_length, text_hash``) without their raw text; length and hash filled in."""
    return rows.withColumn("text_length", F.coalesce("text_length", F.length("text"))).withColumn("text_hash", F.coalesce("text_hash", F.sha2("text", 256))).drop("text")
