import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.patterns import ALL
from veilspark.functions.spans import cn_id, luhn, matches, quoted
from veilspark.operators.detect import chunk_bounds, detect, generator, java_pattern, recognizer, routed
from veilspark.plans.config import Config
from veilspark.plans.pipeline import detected, redact


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _spans(spark, text, **config):
    row = detected(_docs(spark, text), Config(**config)).first()
    for s in row["spans"]:
        assert text[s["start"] : s["end"]] == s["text"]
    return [(s["entity_type"], s["text"]) for s in row["spans"]]


def test_basic_chinese(spark):
    found = dict(_spans(spark, "联系人：陈思，手机15912340077，信箱chen.si@post.example.org。"))
    assert found == {"PERSON": "陈思", "PHONE": "15912340077", "EMAIL": "chen.si@post.example.org"}


def test_bilingual_boundaries(spark):
    text = "姓名：李小明，毕业于复旦大学，后来在星海有限公司。Ms Jane Porter of Lakeside University wrote to them."
    found = _spans(spark, text)
    assert ("PERSON", "李小明") in found and ("PERSON", "Jane Porter") in found
    assert ("ORG", "复旦大学") in found and ("ORG", "Lakeside University") in found
    assert not [t for k, t in found if k == "PERSON" and t in ("姓名", "后来")]


@pytest.mark.parametrize(("language", "want"), [("zh", ["赵磊"]), ("en", ["Carl Jensen"])])
def test_language_gate(spark, language, want):
    assert [t for _, t in _spans(spark, "联系人:赵磊! Carl Jensen.", language=language, enabled_entity_types=("PERSON",))] == want


def test_address_and_astral_offsets(spark):
    assert ("ADDRESS", "上海市浦东新区世纪大道8号") in _spans(spark, "😀😀我叫赵磊，寄到上海市浦东新区世纪大道8号。")


def test_validators(spark):
    rows = spark.createDataFrame([("11010519491231002X", "4111 1111 1111 1111 "), ("110105194912310021", "6222021001116247")], "a string, b string")
    assert [tuple(r) for r in rows.select(cn_id(F.col("a")), luhn(F.col("b"))).collect()] == [(True, True), (False, False)]




PYTHON = {
    "email": (r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.I, 0),
    "phone_cn": (r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", 0, 0),
    # A name may follow its title without a blank, and any word border otherwise.
    "person_en": (r"\b(?:Mr\.?|Ms\.?|Dr\.?)?\s*([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b", 0, 1),
    "passport": (r"(?<![A-Z0-9])(?:[EGDSP]\d{8}|[A-Z]{1,2}\d{6,9})(?![A-Z0-9])", re.I, 0),
}
HARD = ["a@b.c_x@d.e😀 y+z@q-r.st.", "٠١٢ 13８00138000 13800138000", "E12345678 x１２３４５６ ſa123456", "a@b@c.d..e@f.g", "", "Dr. Alice Morgan MrBob Stone xAnn Lee Drs Tim Poe,Ms Eve\n Fox Sam Élan Ünn Ray Kim Joe Al", "éMrBob Stone Mr.Ned Lux_ Ned Lux", "😀" * 5 + "86 13912345678,+8613912345678"]


@pytest.mark.parametrize("key", PYTHON)
def test_offsets_equal_python(spark, key):
    pattern, flags, group = PYTHON[key]
    rows = _docs(spark, *HARD).select("text", matches("text", quoted(ALL[key].pattern), group).alias("m")).collect()
    for r in rows:
        assert [(x["start"], x["end"]) for x in r["m"]] == [m.span(group) for m in re.finditer(pattern, r["text"], flags)]


def test_no_passport_inside_an_email(spark):
    text = "护照E00123456，邮箱u123456@example.com，a.b1234567@x.org E12345678.c@y.net q@E87654321.z.com u654321@ id@D12345678"
    config = {"enabled_entity_types": ("PASSPORT",)}
    assert [t for _, t in _spans(spark, text, **config)] == ["E00123456", "u654321", "D12345678"]
    row = detected(_docs(spark, "护照E00123456，邮箱u123456@example.com"), Config(enabled_entity_types=("PASSPORT", "EMAIL"))).first()
    assert [(s["text"], s["status"], s["conflict"]) for s in row["spans"]] == [("E00123456", "accepted", False), ("u123456@example.com", "accepted", False)]


def test_custom_rules(spark):
    rules = (
        {"id": "1", "name": "k", "kind": "keyword", "pattern": "蓝鲸计划Q", "entity_type": "CUSTOM"},
        {"id": "2", "name": "r", "kind": "regex", "pattern": r"REF:\d{4}", "entity_type": "CUSTOM"},
        {"id": "3", "name": "bad", "kind": "regex", "pattern": "[broken", "entity_type": "CUSTOM"},
        {"id": "4", "name": "off", "kind": "keyword", "pattern": "附件", "entity_type": "CUSTOM", "enabled": False},
        {"id": "5", "name": "type", "kind": "keyword", "pattern": "附件", "entity_type": "NOPE"},
        {"id": "6", "name": "empty", "kind": "regex", "pattern": "q*", "entity_type": "CUSTOM"},
    )
    found = _spans(spark, "附件有蓝鲸计划q与REF:2048，qq", enabled_entity_types=("CUSTOM",), custom_rules=rules)
    assert found == [("CUSTOM", "蓝鲸计划q"), ("CUSTOM", "REF:2048"), ("CUSTOM", "qq")]
    assert java_pattern({"kind": "keyword", "pattern": "a.b", "entity_type": "CUSTOM", "case_sensitive": True}) == r"a\.b"


def test_gates_drop_generators(spark):
    plan = detect(_docs(spark, "x"), ("EMAIL",))._jdf.queryExecution().optimizedPlan().toString()
    assert "London" not in plan
    assert recognizer("email").score == 0.99


def test_null_and_empty_texts(spark):
    rows = redact(_docs(spark, None, "", "x"), Config()).orderBy("doc_id").collect()
    assert [(r["redacted_text"], r["n_spans"]) for r in rows] == [("", 0), ("", 0), ("x", 0)]


def test_chunks_and_routing(spark):
    text = "a" * 300 + "。" + "b" * 300
    bounds = chunk_bounds(text, 420, 40)
    assert bounds[0] == (0, 301) and bounds[1][0] == 261 and bounds[-1][1] == len(text)
    assert chunk_bounds("", 420, 40) == [(0, 0)]
    got = _docs(spark, "无关。我叫王洋！ok中", "plain").select(routed("text")).collect()
    assert [r[0] for r in got] == ["[3:8] 我叫王洋！\n[8:11] ok中", "[0:5] plain"]


def test_names_in_all_documents_equal_brute_force(spark):
    import re

    from veilspark.plans.registry import QUERIES

    data = "/root/testdata/sf0.01"
    name = re.compile(r"\b(?:Mr\.?|Ms\.?|Dr\.?)?\s*([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b")
    organisation = re.compile(r"(?i) (?:university|college|hospital|institute|company|corporation)$")
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    found = [(r["doc_id"], v, r["lang"]) for r in docs for v in name.findall(r["text"] or "") if not organisation.search(v)]
    assert sorted((r["doc_id"], r["value"]) for r in QUERIES["detect_person_en"](spark, data).collect()) == sorted(x[:2] for x in found)
    assert {x[2] for x in found} > {"en"}


def test_phone_numbers_one_character_apart(spark):
    """Both are whole: the character between them is the border of either."""
    text = "+1 (555) 123-4567 +1 (555) 765-4321\n020-1234-5678"
    found = _docs(spark, text).select(generator(recognizer("phone_intl")).alias("s")).first()["s"]
    assert [x["text"] for x in found] == ["+1 (555) 123-4567", "+1 (555) 765-4321", "020-1234-5678"]
