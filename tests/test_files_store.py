import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import batch, store, summary
from veilspark.operators.adapters import entities, verified
from veilspark.operators.detect import detect
from veilspark.operators.knowledge import collect_strings, remote_levels
from veilspark.operators.merge import merged
from veilspark.plans.registry import QUERIES
from veilspark.sources import files, sinks
from veilspark.streaming import stream


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    d = tmp_path / "in"
    (d / "a.txt").write_bytes("﻿one\n\n 三 \r\nfour".encode())
    (d / "b.csv").write_text('id,text\n1,"x ""y"" z"\n2,\n3,w\n')
    (d / "c.json").write_text('["s", {"text": "t"}, {"content": "c"}, {"text": null}]')
    (d / "bad.json").write_text("[{broken")
    (d / "e.exe").write_text("x")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>l</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>r</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (d / "d.docx").write_bytes(buffer.getvalue())
    (d / "g.docx").write_bytes(b"not a zip")
    return d


def test_records(spark, folder):
    found, dead = files.records(files.binary(spark, str(folder)))
    name = lambda p: p.rsplit("/", 1)[1]
    got = sorted((name(r["file"]), r["row"], r["text"]) for r in found.collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 3, " 三 "), ("a.txt", 4, "four"), ("b.csv", 1, 'x "y" z'), ("b.csv", 3, "w"), ("c.json", 1, "s"), ("c.json", 2, "t"), ("c.json", 3, "c"), ("d.docx", 1, "para\nl\tr")]
    assert {name(r["file"]) for r in dead.collect()} == {"bad.json", "e.exe", "g.docx"}
    assert files.extracted(found).where("file like '%a.txt'").first()["text"] == "one\n 三 \nfour"


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", 2, "b"), ("x/a.txt", 1, "a"), ("..\\x\\a.csv", 1, "c")], "file string, row int, final_text string")
    got = {r["export"]: r["content"] for r in sinks.exports(rows).collect()}
    assert set(got) == {"x/a.redacted.txt", "x/a-2.redacted.txt"} and sorted(got.values()) == ["a\nb", "c"]
    dead = spark.createDataFrame([("f", 1, 'q"q')], "file string, row int, error string")
    assert sinks.zip_file(rows, dead, str(tmp_path / "o.zip")) == 2
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert {"manifest.json", "failures.csv"} <= set(z.namelist())
        assert z.read("failures.csv").decode().endswith('"f","1","q""q"')
    sinks.csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == 3


def test_export_parts_are_whole(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text")
    odd = spark.createDataFrame([("one", 2, None), ("one", 1, ""), ("one", 3, "x"), ("none", 1, None)], "source string, doc_id bigint, text string")
    rows = docs.unionByName(odd)
    monkeypatch.setattr(batch, "PART_CHARS", 3000)
    got, count, found = {}, {}, batch.export_parts(rows.repartition(8), "source", "doc_id", "text").orderBy("source", "part").collect()
    for r in found:
        got.setdefault(r["source"], []).extend([] if r["content"] is None else [r["content"]])
        count[r["source"]] = count.get(r["source"], 0) + r["n_rows"]
    want = {}
    for f, _, t in sorted(rows.collect(), key=lambda r: (r[0], r[1])):
        want.setdefault(f, []).append(t)
    assert {f: "\n".join(p) for f, p in got.items()} == {f: "\n".join(t for t in x if t is not None) for f, x in want.items()}
    assert count == {f: len(x) for f, x in want.items()} and len(found) > len(want)
    whole = QUERIES["file_group_export_whole"](spark, "/root/testdata/sf0.001")
    assert sum(len(r["content"]) + 1 - r["n_rows"] for r in whole.collect()) == docs.agg(F.sum(F.length("text"))).first()[0]


def test_dead_letters(spark):
    rows = spark.createDataFrame([("f", 1, "ok"), ("f", 2, " "), ("f", 3, None), ("f", 4, "x" * 100_001)], "file string, row int, text string")
    good, dead = batch.split_faulty(rows)
    assert good.count() == 1 and [r["error"] for r in dead.orderBy("row").collect()] == ["empty text", "missing text", "text too long"]
    assert batch.figures(good, dead).first().asDict() == {"total": 4, "processed": 4, "failed": 3, "status": "completed_with_errors", "progress": 100}


def test_final_text_revision(spark):
    v = spark.createDataFrame([("t", "a", 0)], "task_id string, final_text string, final_revision int")
    v = v.unionByName(store.save_final(v, "t", "b", 0))
    assert store.save_final(v, "t", "b", 1) is None
    with pytest.raises(ValueError):
        store.save_final(v, "t", "c", 0)
    with pytest.raises(LookupError):
        store.save_final(v, "u", "c", 0)


def test_changed(spark):
    pairs = [("abc", "abXc"), ("", ""), ("same", "same"), ("aaa", "aa"), ("😀x", "😀y"), ("", "new")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(store.changed(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"]["changed"] for r in rows] == [1, 0, 0, 1, 1, 3]


def test_review_queue(spark):
    t = spark.createDataFrame([("t1", "2024-01-02", "x" * 50 + "王洋", [("s1", 50, 52, "王洋", "pending", False), ("s2", 0, 1, "x", "accepted", True), ("s3", 1, 2, "x", "accepted", False)])], "task_id string, created_at string, text string, spans array<struct<id:string,start:int,end:int,text:string,status:string,conflict:boolean>>")
    e = spark.createDataFrame([("t1", "accept", '{"span_id":"s1"}')], "task_id string, operation string, payload string")
    got = store.review_queue(t, e).collect()
    assert [(r["span_id"], r["reason"]) for r in got] == [("s2", "识别器冲突")]


def test_policies_and_sanitize(spark):
    row = spark.sql("select map('A','mask','B','mask') as s, map('B','generalize') as g").select(store.policies(F.col("s"), F.col("g"))).first()[0]
    assert row == {"A": "mask", "B": "generalize"}
    old = spark.createDataFrame([("secret", None, None), (None, 3, "h")], "text string, text_length int, text_hash string")
    assert [tuple(r)[0] for r in store.sanitized(old).collect()] == [6, 3] and "text" not in store.sanitized(old).columns


def test_model_adapters(spark):
    docs = spark.createDataFrame([(1, "Bob met Ann")], "doc_id bigint, text string")
    model = lambda: lambda chunks: [[{"label": "PER", "score": 0.75, "start": 0, "end": 3}, {"label": "PER", "score": 0.1, "start": 8, "end": 11}] for _ in chunks]
    row = entities(docs, model).first()
    assert [(s["text"], s["status"]) for s in row["model_spans"]] == [("Bob", "pending")] and row["model_status"] == "ok"

    def broken():
        raise RuntimeError

    assert entities(docs, broken).first()["model_status"] == "degraded"


def test_model_verification(spark):
    reply = '{"decisions":[{"id":"span_0","keep":false,"label":"EMAIL","certainty":"high"},{"id":"span_9","keep":true}],"additions":[{"text":"Bob","label":"PERSON","start":7,"end":10,"certainty":"high"},{"text":"Bob","label":"PERSON","start":1,"end":4,"certainty":"high"}]}'
    docs = detect(spark.createDataFrame([(1, "a@b.cc Bob", reply)], "doc_id bigint, text string, reply string"), ("EMAIL",))
    row = docs.select(verified(F.col("text"), F.col("candidates"), F.col("reply")).alias("s")).first()["s"]
    assert [(s["text"], s["status"], s["sources"]) for s in row] == [("a@b.cc", "rejected", ["LLM", "RULE"]), ("Bob", "accepted", ["LLM"])]
    again = docs.select(merged(F.col("text"), verified(F.col("text"), F.col("candidates"), F.col("reply"))).alias("s")).first()["s"]
    assert len(again) == 2


def test_remote_levels(spark):
    assert collect_strings({"x": ["b", {"label": "a"}], "value": " v "}) == ["v", "b", "a"]
    rows = spark.createDataFrame([("Q", "ORG", '{"label":"L"}'), ("Q", "ORG", "broken")], "term string, entity_type string, body string")
    assert [(r["levels"], r["source"]) for r in remote_levels(rows).collect()] == [(["L", "某同类机构", "某机构"], "remote"), (["某同类机构", "某机构", "组织实体"], "local_fallback")]


def test_progress_half_even(spark):
    rows = spark.createDataFrame([(1, 8), (3, 8), (0, 0)], "p int, t int").select(summary.progress(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in rows] == [12, 38, 100]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cc"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "src"))
    q = stream.start(stream.records(spark, str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["doc_id"]: r["redacted_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "【EMAIL-001】", 2: ""}
