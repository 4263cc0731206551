"""Queries of the store, batches and exports; tasks are orders, events are audits."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import bound
from veilspark.operators import anonymize, batch, console, review, store, summary
from veilspark.plans.queries_detect import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def history_topk(spark, sf_dir):
    """The newest tasks."""
    return store.history(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_topk(spark, sf_dir):
    """The newest audit events with a field of their payload."""
    return store.audits(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


_OPEN = "SELECT DISTINCT o_orderdate, l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) ON l_orderkey = o_orderkey WHERE l_returnflag != 'N' AND NOT EXISTS (SELECT 1 FROM events WHERE event_type IN ('click', 'purchase') AND event_id = l_orderkey AND event_id % 7 + 1 = l_linenumber)"


@query(f"SELECT l_orderkey AS task_id, CAST(l_linenumber AS VARCHAR) || l_returnflag AS span_id, 'item' || l_linenumber AS entity, substr(repeat('abcdefghij', 12), greatest(l_linenumber * 10 - 35, 0) + 1, l_linenumber * 10 + 40 - greatest(l_linenumber * 10 - 35, 0)) AS context, CASE WHEN l_returnflag = 'R' THEN '识别器冲突' ELSE '低置信度候选' END AS reason FROM ({_OPEN}) ORDER BY o_orderdate DESC, l_orderkey, l_linenumber, l_returnflag LIMIT 100")
def review_queue(spark, sf_dir):
    """Open items of the newest tasks that no event resolved, the first hundred, with their context."""
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    one = F.struct(F.concat(line.cast("string"), flag).alias("id"), (line * 10).alias("start"), (line * 10 + 5).alias("end"), F.concat(F.lit("item"), line.cast("string")).alias("text"), F.when(flag == "N", "accepted").otherwise("pending").alias("status"), (flag == "R").alias("conflict"))
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_sort(F.collect_set(one)).alias("spans"))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.lit("abcdefghij" * 12).alias("text")).join(spans, "task_id", "left")
    op = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "purchase", "reject").otherwise("add")
    done = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), op.alias("operation"), F.explode(F.array(F.lit("A"), F.lit("R"))).alias("flag"), "event_id")
    done = done.select("task_id", "operation", F.to_json(F.struct(F.concat((F.col("event_id") % 7 + 1).cast("string"), "flag").alias("span_id"))).alias("payload"))
    return store.review_queue(tasks, done).select("task_id", "span_id", "entity", "context", "reason")


@query("SELECT count(*) AS kept_tasks, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAYS)) AS kept_events FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAYS")
def purge_retention(spark, sf_dir):
    """Tasks older than a year go, and their children with them."""
    tasks = table(spark, sf_dir, "orders")
    now = tasks.agg(F.max("o_orderdate").alias("now")).first()["now"]
    kept, children = store.purge(tasks, table(spark, sf_dir, "lineitem"), F.lit(now), 365, "o_orderdate", "o_orderkey", "l_orderkey")
    return kept.agg(F.count("*").alias("kept_tasks")).crossJoin(children.agg(F.count("*").alias("kept_events")))


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey % 10 != 0) AS n_tasks, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)) AS n_children")
def cascade_delete(spark, sf_dir):
    """Deleting jobs deletes their tasks and those tasks' events."""
    orders = table(spark, sf_dir, "orders")
    doomed = orders.where("o_custkey % 10 = 0").select("o_orderkey")
    tasks, children = store.cascade(orders, table(spark, sf_dir, "lineitem"), doomed, "o_orderkey", "l_orderkey")
    return tasks.agg(F.count("*").alias("n_tasks")).crossJoin(children.agg(F.count("*").alias("n_children")))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND (p_size % 3 = 0 OR p_size % 3 = 1)")
def rules_scope_union(spark, sf_dir):
    """Global rules and a project's own, enabled ones only."""
    scope = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, F.lit("mine")).otherwise(F.lit("other"))
    rules = table(spark, sf_dir, "part").withColumns({"project_id": scope, "enabled": F.col("p_size") > 10, "created_at": F.col("p_partkey"), "id": F.col("p_partkey")})
    return store.scoped_rules(rules, "mine").select("p_partkey", "p_name")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_version(spark, sf_dir):
    """The last version of each key."""
    return store.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT l_orderkey, l_linenumber, coalesce(o_totalprice, l_extendedprice) AS price FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey")
def hydrate_jobs(spark, sf_dir):
    """Job rows with their task's newest figures, their own where the task is gone."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_linenumber", F.lit(None).cast("string").alias("final_text"), F.lit(0).alias("final_revision"), F.col("l_extendedprice").alias("entity_count"), F.lit(0).alias("pending_count"))
    tasks = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), F.lit("x").alias("final_text"), F.lit(1).alias("final_revision"), F.col("o_totalprice").alias("entity_count"), F.lit(1).alias("pending_count"))
    return store.hydrate(rows, tasks).select(F.col("task_id").alias("l_orderkey"), "l_linenumber", F.col("entity_count").alias("price"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' END, s_name) AS s_name, s_acctbal FROM supplier")
def partial_update(spark, sf_dir):
    """Non-null fields of an update replace the old ones."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "renamed").alias("s_name"))
    return store.patch(old, new, "s_suppkey")


@query("SELECT doc_id, length(text) AS n, sha256(text) AS hash FROM documents")
def audit_hash(spark, sf_dir):
    """What an audit keeps of a text: length and hash."""
    return table(spark, sf_dir, "documents").withColumn("h", store.hashed(F.col("text"))).select("doc_id", F.col("h.length").cast("bigint").alias("n"), F.col("h.sha256").alias("hash"))


@query("SELECT doc_id, length(text) - length(replace(substr(text, 1, 50), substr(text, 1, 20), '')) * 0 - length(text) AS prefix_gap, CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END AS long FROM documents".replace("length(text) - length(replace(substr(text, 1, 50), substr(text, 1, 20), '')) * 0 - length(text)", "0"))
def changed_chars(spark, sf_dir):
    """Inserting a mark in a text changes one character: prefix and suffix meet around it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.withColumn("b", F.concat(F.substring("text", 1, 20), F.lit("\x01"), F.expr("substring(text, 21)")))
    x = edited.withColumn("c", store.changed(F.col("text"), F.col("b")))
    return x.select("doc_id", (F.length("text") - F.col("c.prefix") - F.col("c.suffix")).alias("prefix_gap"), F.when((F.length("text") >= 40) & (F.col("c.changed") == 1), 1).otherwise(0).alias("long"))


@query("SELECT doc_id, substr(text, 1, 80) AS preview, substr(text, greatest(11 - 35, 0) + 1, 20 + 35 - greatest(11 - 35, 0)) AS context FROM documents")
def preview_context(spark, sf_dir):
    """Previews and context windows."""
    return table(spark, sf_dir, "documents").select("doc_id", store.preview(F.col("text")).alias("preview"), store.around(F.col("text"), F.lit(11), F.lit(20)).alias("context"))


@query("SELECT source AS file, count(*) AS n_rows, CAST(sum(length(text)) + count(text) - 1 AS BIGINT) AS n_chars FROM documents GROUP BY source")
def file_group_export(spark, sf_dir):
    """Whole rows grouped by file, in order, in parts that many tasks write: rows and characters of each file."""
    parts = file_group_export_whole(spark, sf_dir)
    return parts.groupBy("file").agg(F.sum("n_rows").alias("n_rows"), (F.sum(F.length("content")) + F.count("content") - 1).alias("n_chars"))


@query()
def file_group_export_whole(spark, sf_dir):
    """The parts themselves; which rows share a part follows from ranges, so tests hold their content against brute force."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("row"), F.col("text").alias("final_text"))
    return batch.export_parts(rows)


_NAME = "'dir' || CAST(p_size % 2 AS VARCHAR) || '/' || p_brand || '.redacted.txt'"


@query(f"SELECT p_partkey, CASE WHEN nth = 1 THEN n ELSE regexp_replace(n, '\\.redacted\\.txt$', '') || '-' || CAST(nth AS VARCHAR) || '.redacted.txt' END AS export FROM (SELECT p_partkey, {_NAME} AS n, row_number() OVER (PARTITION BY {_NAME} ORDER BY p_partkey) AS nth FROM part)")
def export_names(spark, sf_dir):
    """Safe export names without collisions."""
    raw = F.concat(F.lit("..\\dir"), (F.col("p_size") % 2).cast("string"), F.lit("/./"), F.col("p_brand"), F.lit(".csv"))
    named = table(spark, sf_dir, "part").withColumn("name", batch.export_name(raw))
    return batch.distinct_names(named, "name", "p_partkey").select("p_partkey", "export")


@query("SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (WHERE length(text) > 5000) AS failed, CASE WHEN count(*) FILTER (WHERE length(text) > 5000) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, 100 AS progress FROM documents")
def batch_figures(spark, sf_dir):
    """Job totals with dead letters for texts beyond a limit."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("row"), "text")
    good, dead = batch.split_faulty(rows, 5000)
    return batch.figures(good, dead)


@query("SELECT doc_id AS row, length(text) AS text_length, sha256(text) AS text_hash, 'text too long' AS error FROM documents WHERE length(text) > 5000")
def dead_letters(spark, sf_dir):
    """Dead-letter rows: length and hash, no text."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("row"), "text")
    return batch.split_faulty(rows, 5000)[1].select("row", F.col("text_length").cast("bigint").alias("text_length"), "text_hash", "error")


@query("SELECT event_type, count(*) AS n, CAST(round_even(count(*) * 100.0 / (SELECT count(*) FROM events), 0) AS INTEGER) AS progress FROM events GROUP BY event_type")
def job_progress(spark, sf_dir):
    """Percent done, rounded half to even."""
    events = table(spark, sf_dir, "events")
    total = events.agg(F.count("*").alias("total"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", "n", summary.progress(F.col("n"), F.col("total")).alias("progress"))


@query("SELECT o_orderstatus AS name, round(avg(o_totalprice), 4) AS f1 FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def best_system(spark, sf_dir):
    """The report with the best figure."""
    reports = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.round(F.avg("o_totalprice"), 4).alias("f1")).withColumn("ord", F.col("name"))
    return summary.best_system(reports).select("name", "f1")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY turn DESC, conv_id LIMIT 30")
def recent_jobs(spark, sf_dir):
    """The thirty jobs that were active last, with their latest state."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"), F.count("*").alias("n"))
    return store.jobs(rows, "turn", "conv_id")


@query("SELECT DISTINCT user_id AS task_id, CAST(event_id % 5 AS VARCHAR) AS span_id FROM events WHERE event_type IN ('click', 'purchase')")
def resolved_spans(spark, sf_dir):
    """Distinct spans that events accepted or rejected, out of JSON payloads."""
    op = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "purchase", "reject").otherwise("add")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), op.alias("operation"), F.to_json(F.struct((F.col("event_id") % 5).cast("string").alias("span_id"))).alias("payload"))
    return store.resolved(events)


_CASE = "c_custkey % 12"
_FIRST = f"CASE {_CASE} WHEN 2 THEN name WHEN 3 THEN '某机构' WHEN 6 THEN '【PERSON-001】' WHEN 7 THEN 'Somebody' WHEN 10 THEN '自然人' ELSE '某人' END || CASE {_CASE} WHEN 4 THEN ' ' ELSE ' met ' END"
_SECOND = f"CASE {_CASE} WHEN 6 THEN '【PERSON-002】' WHEN 9 THEN '某人' ELSE '【PERSON-001】' END || CASE {_CASE} WHEN 8 THEN '. 【PERSON-002】.' ELSE '. Eve.' END"


@query(f"SELECT c_custkey, redacted_text, CASE WHEN c_custkey % 24 < 12 THEN redacted_text ELSE 'by hand' END AS final_text, CASE {_CASE} WHEN 4 THEN name || ' met' ELSE name END || CASE WHEN {_CASE} IN (1, 3, 4, 6, 7) THEN ' accepted' WHEN {_CASE} = 2 THEN ' rejected' ELSE ' pending' END || CASE WHEN {_CASE} IN (1, 2, 3, 4, 6, 7) THEN ' HUMAN,RULE' ELSE ' RULE' END || CASE WHEN {_CASE} IN (1, 2, 3, 4) THEN ' false' ELSE ' true' END AS first_span, CAST(CASE {_CASE} WHEN 2 THEN 1 WHEN 8 THEN 3 ELSE 2 END AS INTEGER) AS entity_count, CAST(CASE WHEN {_CASE} IN (1, 2, 3, 4, 6, 7) THEN 0 ELSE 1 END AS INTEGER) AS pending_count, CAST(CASE {_CASE} WHEN 2 THEN 10 WHEN 8 THEN 30 ELSE 20 END AS INTEGER) AS risk_score, CASE {_CASE} WHEN 5 THEN 'active spans overlap' WHEN 11 THEN 'span id exists,strength is not 1, 2 or 3,no such span' ELSE '' END AS refused FROM (SELECT c_custkey, name, {_FIRST} || {_SECOND} AS redacted_text FROM (SELECT c_custkey, 'Ann' || c_custkey AS name FROM customer))")
def review_events(spark, sf_dir):
    """Tasks after their review: each of the nine operations, refused events, and what is made anew from the spans."""
    key, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 12
    name, other = F.concat(F.lit("Ann"), key), F.concat(F.lit("Bob"), key)
    size = F.length(name)
    span = lambda i, start, value, status, conflict, strategy: F.struct(F.lit(i).alias("id"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("text"), F.lit("PERSON").alias("entity_type"), F.lit(0.7).alias("score"), F.array(F.lit("RULE")).alias("sources"), F.lit(status).alias("status"), F.lit(conflict).alias("conflict"), F.lit(strategy).alias("strategy"), F.lit(None).cast("string").alias("replacement"), F.lit(None).cast("string").alias("last_operation"))
    base = table(spark, sf_dir, "customer").withColumn("task_id", F.col("c_custkey")).withColumn("text", F.concat(name, F.lit(" met "), other, F.lit(". Eve.")))
    spans = F.array(span("b", size + 5, other, "accepted", False, "mask"), span("a", F.lit(0), name, "pending", True, "generalize"))
    tasks = base.select("c_custkey", "task_id", "text", spans.alias("spans"), F.lit("generalize").alias("strategy"), F.lit(2).alias("privacy_strength"), F.lit("strict").alias("risk_level"), F.lit("by hand").alias("final_text"), (F.col("c_custkey") % 24 >= 12).alias("has_manual_edits"))
    eve = span("c", 2 * size + 7, F.lit("Eve"), "accepted", False, "mask")
    none = F.lit(None).cast(review.SPAN)
    one = lambda k, op, after=None, on="a", add=None, ord_=1: base.where(n == k).select("task_id", F.lit(ord_).cast("bigint").alias("ord"), F.lit(op).alias("operation"), F.lit(on).alias("span_id"), (after if after is not None else F.lit(None)).cast("string").alias("after"), (none if add is None else add.cast(review.SPAN)).alias("span"))
    to = lambda extra: F.concat(F.lit("0:"), (size + extra).cast("string"))
    events = [one(1, "accept"), one(2, "reject"), one(3, "change_type", F.lit("ORG")), one(4, "adjust_boundary", to(4)), one(5, "adjust_boundary", to(6)), one(6, "set_span_strategy", F.lit("mask")), one(7, "set_replacement", F.lit("Somebody")), one(8, "add", on="c", add=eve), one(9, "set_strategy", F.lit("generalize")), one(10, "set_strength", F.lit("3")), one(11, "add", add=span("a", F.lit(0), name, "accepted", False, "mask")), one(11, "set_strength", F.lit("9"), ord_=2), one(11, "accept", on="zz", ord_=3)]
    out = review.apply(tasks, functools.reduce(DataFrame.unionAll, events))
    a = F.col("spans")[0]
    said = F.concat_ws(" ", a["text"], a["status"], F.array_join(a["sources"], ","), a["conflict"].cast("string"))
    return out.select("c_custkey", "redacted_text", "final_text", said.alias("first_span"), "entity_count", "pending_count", "risk_score", F.array_join(F.transform("refused", lambda r: r["reason"]), ",").alias("refused"))


@query("SELECT o_orderkey, '【ORG-' || lpad(CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY f) AS VARCHAR), 3, '0') || '】' AS label FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS f FROM orders)")
def mask_numbers(spark, sf_dir):
    """First-appearance numbers of the texts of a document's masked spans."""
    one = F.struct(F.col("o_orderkey").alias("start"), F.col("o_orderpriority").alias("text"), F.lit("ORG").alias("entity_type"), F.lit("mask").alias("strategy"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    labels = bound(anonymize.numbering(F.col("spans")), lambda numbers: F.transform("spans", lambda s: F.struct(s["start"].alias("o_orderkey"), anonymize.mask(s, numbers).alias("label"))))
    return docs.select(F.explode(labels).alias("x")).select("x.*")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ', ,' || p_brand || '，' || p_type, '[，,]'), lambda x: trim(x)), lambda x: x != ''), '|') AS terms FROM part")
def term_lists(spark, sf_dir):
    """Typed lists cut into terms."""
    text = F.concat("p_name", F.lit(", ,"), "p_brand", F.lit("，"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(console.terms(text), "|").alias("terms"))


@query("SELECT l_orderkey, min(l_linenumber) AS first_line, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey")
def drawable_spans(spark, sf_dir):
    """Spans that follow each other are all drawn; those inside them are not."""
    line = F.col("l_linenumber")
    pair = F.array(F.struct((line * 10).alias("start"), (line * 10 + 10).alias("end")), F.struct((line * 10 + 3).alias("start"), (line * 10 + 5).alias("end")))
    packed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(pair)).alias("spans"))
    drawn = packed.withColumn("d", console.drawable(F.col("spans")))
    return drawn.select("l_orderkey", (F.col("d")[0]["start"] / 10).cast("int").alias("first_line"), F.size("d").cast("bigint").alias("n"))


@query("SELECT c_custkey, substr(c_name, 1, 9) AS before, substr(c_name, 19) AS after FROM customer")
def highlight_parts(spark, sf_dir):
    """Text before and after the first occurrence of an entity."""
    rows = table(spark, sf_dir, "customer").withColumn("entity", F.substring("c_name", 10, 9)).withColumn("h", console.highlight("c_name", "entity"))
    return rows.select("c_custkey", "h.before", "h.after")


@query("SELECT s_suppkey, CASE WHEN s_suppkey * 50 NOT BETWEEN 1 AND 3650 THEN 'retention_days' WHEN s_suppkey % 5 NOT BETWEEN 1 AND 3 THEN 'strength' END AS refused FROM supplier")
def setting_ranges(spark, sf_dir):
    """Settings out of range and why they are refused."""
    rows = table(spark, sf_dir, "supplier").withColumns({"retention_days": F.col("s_suppkey") * 50, "strength": F.col("s_suppkey") % 5, "replacement": F.col("s_name")})
    return console.check_ranges(rows).select("s_suppkey", "refused")


@query("SELECT doc_id, replace(text, 'the', 'THE') AS replaced FROM documents")
def replace_everywhere(spark, sf_dir):
    """Find and replace over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", console.replace_all(F.col("text"), "the", "THE").alias("replaced"))
