import random
import re
import time

import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from veilspark.functions.spans import SPANS
from veilspark.operators.anonymize import redacted, vector, weights
from veilspark.operators.merge import merged
from veilspark.plans.config import Config
from veilspark.plans.pipeline import redact

TEXT = "abcdefghijklmnopqrst"


def _span(start, end, kind, score, status="accepted", source="RULE", text=TEXT):
    return (start, end, text[start:end], kind, score, [source], status, False, "mask", None, None)


def _merge(spark, text, *groups):
    rows = spark.createDataFrame([(i, text, list(g)) for i, g in enumerate(groups)], f"id int, text string, spans {SPANS}").coalesce(1)
    return [r["m"] for r in rows.select("id", merged(F.col("text"), F.col("spans")).alias("m")).orderBy("id").collect()]


def brute(text, spans):
    """The merge by its definition: every kept span is looked at, in order of start, length, score and input."""
    kept = []
    for s in sorted((dict(zip(("start", "end", "text", "type", "score", "sources", "status", "conflict"), s[:8], strict=True)) for s in spans if text[s[0] : s[1]] == s[2] and s[1] <= len(text)), key=lambda s: (s["start"], s["start"] - s["end"], -s["score"])):
        s = dict(s)
        twins = [k for k in kept if (k["start"], k["end"]) == (s["start"], s["end"])]
        meets = [k for k in kept if k["start"] < s["end"] and s["start"] < k["end"]]
        if twins:
            k = twins[0]
            k["sources"] = sorted({*k["sources"], *s["sources"]})
            if k["type"] != s["type"]:
                k["conflict"], k["status"] = True, "pending"
                k["type"] = s["type"] if s["score"] > k["score"] else k["type"]
            k["score"] = max(k["score"], s["score"])
        elif meets:
            rank = lambda x: (x["status"] != "rejected", x["score"], x["end"] - x["start"])
            best = max([meets[0], s], key=rank) if rank(s) != rank(meets[0]) else meets[0]
            best["conflict"], best["status"] = True, "pending"
            if best is s:
                kept[kept.index(meets[0])] = s
        else:
            kept.append(s)
    return [(k["start"], k["end"], k["type"], round(k["score"], 3), k["sources"], k["status"], k["conflict"]) for k in sorted(kept, key=lambda k: k["start"])]


spans = st.lists(
    st.builds(lambda a, n, t, s, u, r: _span(a, min(len(TEXT), a + n), t, s, u, r), st.integers(0, 15), st.integers(1, 6), st.sampled_from(["ORG", "PHONE", "EMAIL"]), st.sampled_from([0.5, 0.8, 0.9]), st.sampled_from(["accepted", "pending", "rejected"]), st.sampled_from(["RULE", "NER"])),
    max_size=8,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(spans, min_size=20, max_size=40))
def test_merge_equals_definition(spark, groups):
    got = _merge(spark, TEXT, *groups)
    for g, m in zip(groups, got, strict=True):
        assert [(s["start"], s["end"], s["entity_type"], round(s["score"], 3), list(s["sources"]), s["status"], s["conflict"]) for s in m] == brute(TEXT, g)


def test_rejected_cannot_evict(spark):
    text = "北京市海淀区"
    (m,) = _merge(spark, text, [_span(0, 6, "ADDRESS", 0.8, text=text), _span(0, 3, "LOCATION", 0.99, "rejected", text=text)])
    assert [(s["entity_type"], s["status"]) for s in m] == [("ADDRESS", "pending")]


def _redact(spark, text, **config):
    return redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), Config(**config)).first()


def test_mask_numbers_repeat(spark):
    out = _redact(spark, "我叫王洋，13800138000，13900139000，13800138000")
    assert out["redacted_text"] == "我叫【PERSON-001】，【PHONE-001】，【PHONE-002】，【PHONE-001】"


def test_generalize_levels(spark):
    for strength, want in ((1, "北京高校"), (2, "高等院校"), (3, "教育机构")):
        assert _redact(spark, "就读于中国人民大学。", strategy="generalize", privacy_strength=strength)["redacted_text"] == f"就读于{want}。"


def test_policy(spark):
    assert "某联系电话" in _redact(spark, "电话13800138000", policies={"PHONE": "generalize"})["redacted_text"]


def test_instruction(spark):
    out = _redact(spark, "北京和上海", instruction="保留北京地名，隐去上海地名，使用最高强度泛化")
    assert out["redacted_text"].startswith("北京和") and "上海" not in out["redacted_text"]


def test_pseudonyms_are_consistent(spark):
    text = "我叫王洋，我叫王洋，我叫李明"
    out = _redact(spark, text, strategy="pseudonymize", enabled_entity_types=("PERSON",))["redacted_text"]
    a, b, _ = (x.removeprefix("我叫") for x in out.split("，"))
    assert a == b and "王洋" not in out
    assert out == _redact(spark, text, strategy="pseudonymize", enabled_entity_types=("PERSON",))["redacted_text"]


def test_features_and_weights_by_hand(spark):
    rows = {r["t"]: r for r in spark.createDataFrame([("星海大学",), ("Ab1 ",), ("",)], "t string").select("t", vector(F.col("t"), "ORG").alias("v"), weights(F.col("t"), "PERSON", 2).alias("w")).collect()}
    assert rows["星海大学"]["v"] == [1.0, 0.0, 0.0, 0.1, 1.0, 0.0, 1.0]
    assert rows["Ab1 "]["v"] == [0.0, 0.5, 0.25, 0.1, 0.0, 0.0, 1.0] and rows[""]["v"] == [0.0, 0.0, 0.0, 0.025, 0.0, 0.0, 1.0]
    assert all(w >= 1 for r in rows.values() for w in r["w"])


def test_many_spans_in_one_text(spark):
    """32,000 spans in one text: work grows with the text, not with its square."""
    text = " ".join(f"user{i % 20000}@mail{i % 97}.example.com" for i in range(32_000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    config = Config(enabled_entity_types=("EMAIL",))
    redact(df.limit(0), config).collect()
    began = time.perf_counter()
    row = redact(df, config).select("n_spans", "redacted_text").first()
    assert time.perf_counter() - began < 5
    numbers, want = {}, []
    for w in text.split(" "):
        want.append(f"【EMAIL-{numbers.setdefault(w, len(numbers) + 1):03d}】")
    assert row["n_spans"] == 32_000 and row["redacted_text"] == " ".join(want)


def test_long_text_is_read_by_blocks(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab😀é\n王 ") for _ in range(30_000))
    edges = sorted(rng.sample(range(len(text)), 400))
    spans = [_span(a, b, "ORG", 0.9, text=text) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    spans += [(5, 9, "no such text", "ORG", 0.9, ["RULE"], "accepted", False, "mask", None, None), _span(29_990, 30_000, "ORG", 0.9, text=text)]
    (m,) = _merge(spark, text, spans)
    assert [(s["start"], s["end"]) for s in m] == [(s["start"], s["end"]) for s in (dict(zip(("start", "end"), x[:2], strict=True)) for x in sorted(spans) if x[2] != "no such text")]
    row = spark.createDataFrame([(1, text, [tuple(s) for s in m])], f"id int, text string, spans {SPANS}").select(redacted(F.col("text"), F.col("spans"), F.col("id"), "mask")).first()[0]
    out, at = [], 0
    for s in m:
        out += [text[at : s["start"]], "\0"]
        at = s["end"]
    assert re.sub("【ORG-\\d+】", "\0", row) == "".join(out) + text[at:]


def test_custom_replacement_wins_and_takes_no_number(spark):
    text = "a@b.cc x@y.zz"
    rows = spark.createDataFrame([(1, text, [_span(0, 6, "EMAIL", 0.9, text=text), _span(7, 13, "EMAIL", 0.9, text=text)], {"a@b.cc": "hidden"})], f"id int, text string, spans {SPANS}, custom map<string,string>")
    assert rows.select(redacted(F.col("text"), F.col("spans"), F.col("id"), None, custom=F.col("custom"))).first()[0] == "hidden 【EMAIL-001】"
