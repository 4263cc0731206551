import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions.tables import PSEUDONYMS
from veilspark.operators import adapters, anonymize, batch, console, detect, knowledge, summary
from veilspark.plans.config import Config
from veilspark.plans.pipeline import detected
from veilspark.sources import files, sinks
from veilspark.sources.tables import Store


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("tasks").count() == 0 and store.get("jobs", "none") is None
    store.save_task("t1", "x" * 200, 3, "low", {"a": 1})
    store.append("audits", spark.createDataFrame([("e1", "t1", "accept", "{}"), ("e2", "t2", "reject", "{}")], "id string, task_id string, operation string, payload string"))
    first = store.get("tasks", "t1")
    assert first["preview"] == "x" * 80 and json.loads(first["payload"]) == {"a": 1}
    store.save_task("t1", "short", 4, "high", {})
    assert [(r["preview"], r["entity_count"]) for r in store.read("tasks").collect()] == [("short", 4)]
    assert store.delete_task("t1") and not store.delete_task("t1") and [r["id"] for r in store.read("audits").collect()] == ["e2"]
    store.create_project("p1", "one")
    store.create_project("p2", "two")
    store.save_rule("r1", "n", "regex", "a+", "CUSTOM", project_id="p1")
    store.save_rule("r2", "n", "keyword", "a+", "CUSTOM")
    with pytest.raises(ValueError):
        store.save_rule("r3", "n", "regex", "[broken", "CUSTOM")
    made = store.get("projects", "p1")
    changed = store.update("projects", "p1", name="changed", description=None)
    assert changed["name"] == "changed" and changed["description"] == "" and changed["created_at"] == made["created_at"]
    assert store.projects().first()["id"] == "p1" and store.update("projects", "p9", name="x") is None
    assert store.delete_project("p1") and [r["id"] for r in store.read("rules").collect()] == ["r2"] and store.delete_rule("r2") and not store.delete_rule("r2")
    store.create_job("j", 10, {"k": 1}, "p1")
    assert store.update_job("j", status="running")["processed"] == 0 and store.update_job("nope", status="x") is None
    records = spark.createDataFrame([(f"f{i % 2}", i, f"a{i}@b.cc") for i in range(10)], "file string, row int, text string")
    assert store.run_job("j", records, lambda part: part.select("file", "row"))["status"] == "completed"
    assert store.get("jobs", "j")["processed"] == 10 and spark.read.parquet(f"{store.folder}/results").count() == 10
    store.set_setting("s", {"days": 3})
    assert Store(spark, store.folder).setting("s") == {"days": 3} and store.setting("none", 5) == 5
    store.set_setting("s", 4)
    assert store.setting("s") == 4


def test_model_spans_and_replies(spark):
    docs = spark.createDataFrame([(1, "Bob met 王洋 at a@b.cc."), (2, "else")], "doc_id bigint, text string")
    model = lambda: lambda chunks: [[{"label": "PER", "score": 0.75, "start": 0, "end": 3}] if c.startswith("Bob") else [] for c in chunks]
    with_model = adapters.entities(docs, model)
    config = Config(enabled_entity_types=("PERSON", "EMAIL"), preserve_terms=("a@b",))

    def load():
        def reply(request):
            if request["wrong"] is None:  # the first reply is wrong and asked for again
                return '{"additions":[{"text":"no","label":"PERSON","start":0,"end":2}]}'
            at = request["context"].find("王洋") - len("[0:0] ") if request["candidates"] else -1
            return json.dumps({"decisions": [{"id": c["id"], "keep": True, "label": "PERSON"} for c in request["candidates"]], "additions": [{"text": "王洋", "label": "PERSON", "start": 8, "end": 10, "certainty": "high"}] if at > 0 else []})

        return reply

    rows = {r["doc_id"]: r for r in detected(with_model, config, "model_spans", load=load).collect()}
    assert [(s["text"], s["status"], s["sources"]) for s in rows[1]["spans"]] == [("Bob", "accepted", ["LLM", "NER"]), ("王洋", "accepted", ["LLM"])]
    assert rows[2]["spans"] == [] and rows[1]["reply_status"] == "ok"
    broken = detected(with_model, config, "model_spans", load=lambda: lambda request: "{").collect()
    assert [r["reply_status"] for r in broken] == ["degraded"] * 2 and [s["text"] for s in broken[0]["spans"]] == ["Bob"]
    only_zh = detected(with_model, Config(language="zh", enabled_entity_types=("PERSON",)), "model_spans").where("doc_id = 1").first()
    assert [s["text"] for s in only_zh["spans"]] == []


def test_encoder_scores(spark):
    terms = spark.createDataFrame([("Ann", "PERSON"), ("x", "EMAIL")], "text string, entity_type string")
    encode = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    rows = adapters.cosines(terms, encode, PSEUDONYMS)
    weights = rows.where("entity_type = 'PERSON'").select("scores", anonymize.weights(F.col("text"), "PERSON", 2, F.col("scores")).alias("w")).first()
    assert len(weights["scores"]) == len(PSEUDONYMS["PERSON"]) and all(0 <= s <= 1 for s in weights["scores"])
    assert all(a < b or x >= y for a, b, x, y in zip(weights["w"], weights["w"][1:], weights["scores"], weights["scores"][1:], strict=False))
    assert rows.where("entity_type = 'EMAIL'").first()["scores"] is None

    def none():
        raise RuntimeError

    failed = adapters.cosines(terms, none, PSEUDONYMS).where("entity_type = 'PERSON'")
    plain, by_features = failed.select(anonymize.weights(F.col("text"), "PERSON", 2, F.col("scores")), anonymize.weights(F.col("text"), "PERSON", 2)).first()
    assert plain == by_features


def test_providers_in_order(spark):
    def down(term):
        raise OSError

    first = lambda term: '{"label": "one"}' if term == "A" else "{}"
    second = lambda term: '{"label": "two"}' if term in "AB" else "broken"
    terms = spark.createDataFrame([("A", "ORG"), ("A", "ORG"), ("B", "ORG"), ("C", "ORG"), ("D", "EMAIL")], "term string, entity_type string")
    cache = adapters.levels_from(terms, [("down", down), ("first", first), ("second", second)])
    got = {r["term"]: (r["levels"][0], r["provider"], r["status"]) for r in cache.collect()}
    assert got["A"] == ("one", "first", "ready") and got["B"] == ("two", "second", "ready") and got["C"][1:] == ("local", "degraded") and "D" not in got
    spans = spark.createDataFrame([("a", "ORG", "accepted"), ("A", "ORG", "rejected"), ("x@y", "EMAIL", "accepted")], "text string, entity_type string, status string")
    enriched = {(r["text"], r["status"]): r["level_source"] for r in knowledge.enrich(spans, cache).collect()}
    assert enriched == {("a", "accepted"): "remote", ("A", "rejected"): None, ("x@y", "accepted"): None}
    late = knowledge.enrich(spans, cache, F.lit("2999-01-01").cast("timestamp")).where("text = 'a'").first()
    assert late["level_source"] != "remote"


def test_reports_guards_and_downloads(spark):
    rows = spark.createDataFrame([("ALL", 0.5, 0.25, 1 / 3), ("ORG", 0.5, 0.25, 1 / 3)], "entity_type string, precision double, recall double, f1 double")
    latency = summary.mean_latency(spark.createDataFrame([(10.0,), (20.0,)], "ms double"))
    said = json.loads(summary.report(rows, latency, "rules", "gold", 7).first()["value"])
    assert said["systems"][0]["latency"] == 15 and said["categories"] == [{"name": "ORG", "recall": 0.25}] and said["metadata"]["records"] == 7
    assert summary.mean_latency(spark.createDataFrame([], "ms double")).first()["latency"] == 0
    records = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("a", 1, "z")], "file string, row int, text string")
    assert batch.representative(records).first()["text"] == "z" and batch.guarded(records, 3).count() == 3
    for most, given in ((2, records), (3, records.where("false"))):
        with pytest.raises(ValueError):
            batch.guarded(given, most)
    results = spark.createDataFrame([("a", 2, "t", "done", 1, 0, 1, None, 'say "x"'), ("a", 1, "t", "done", 1, 0, 1, "f", "r")], "file string, row int, task_id string, status string, entity_count int, pending_count int, final_revision int, final_text string, redacted_text string")
    lines = [r["line"] for r in sinks.download_csv(results, sinks.RESULTS).collect()]
    assert lines == ["﻿file,row,task_id,status,entity_count,pending_count,final_revision,final_text", '"a","1","t","done","1","0","1","f"', '"a","2","t","done","1","0","1","say ""x"""']
    open_ = spark.createDataFrame([("e", "c", 0.9, False, "边界异常"), ("e", "c", 0.7, True, "x")], "entity string, context string, score double, conflict boolean, reason string")
    assert [console.facet(open_, k).count() for k in ("all", "conflict", "low", "boundary")] == [2, 1, 1, 1]


def test_rules_that_only_python_knows(spark):
    assert detect.java_pattern({"kind": "regex", "pattern": r"(?P<a>x)(?(a)y|z)", "entity_type": "CUSTOM"}) is None
    assert detect.java_pattern({"kind": "regex", "pattern": r"(?P<a>x)(?P=a)", "entity_type": "CUSTOM"}) == r"(?iu)(?<a>x)\k<a>"


def test_broken_csv_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("text\nok\n".encode())
    (tmp_path / "b.csv").write_bytes(b"text\nbad \xff\xfe\n")
    found, dead = files.records(files.binary(spark, str(tmp_path)))
    assert [r["text"] for r in found.collect()] == ["ok"] and [r["error"] for r in dead.collect()] == ["not UTF-8"]
