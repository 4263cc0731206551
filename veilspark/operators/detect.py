"""Span generators: built-in recognizers, custom rules, chunking and sentence routing.

Generators are array columns over one scan of the documents, so detection has no
shuffle; the type and language gates drop generators before a plan exists.
"""

from __future__ import annotations

import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.patterns import ALL, LITE, RULES, Recognizer
from veilspark.functions.spans import bound, cn_id, empty_spans, has_cjk, has_latin, luhn, matches, quoted, span
from veilspark.functions.tables import ENTITY_TYPES, ORG_VERBS, ORG_WORDS_EN, RISK_WORDS, ROUTED_CHARS, ROUTED_SENTENCES, SENTENCE_END

_CHECKS = {
    "id_card": lambda x: cn_id(x["text"]),
    "bank_card": lambda x: luhn(x["text"]),
    "org_zh": lambda x: ~x["text"].rlike("|".join(ORG_VERBS)),
    "person_en": lambda x: ~x["text"].rlike("(?i)(?: " + "| ".join(ORG_WORDS_EN) + ")$"),
}


def scope_of(language: str) -> str:
    return "all" if language in ("auto", "mixed", "multilingual") else language


def generator(r: Recognizer, text: str = "text", strategy: Column | str = "mask", language: str = "auto") -> Column:
    """Spans of one recognizer in a text column."""
    pattern, group = (f"(?:{r.outside})|({r.pattern})", r.group + 1) if r.outside else (r.pattern, r.group)
    found = matches(text, quoted(pattern), group, quoted(r.needs) if r.needs else None)
    if r.outside:
        found = F.filter(found, lambda x: x["end"] > x["start"])
    if r.key in _CHECKS:
        found = F.filter(found, _CHECKS[r.key])
    scope = scope_of(language)
    if r.source == "NER-LITE" and r.language == "all" and scope != "all":
        found = F.filter(found, lambda x: has_cjk(x["text"]) if scope == "zh" else has_latin(x["text"]))
    return F.transform(found, lambda x: span(x, r.entity_type, r.score, r.source, strategy))


def active(enabled: tuple[str, ...] | None = None, language: str = "auto") -> list[Recognizer]:
    """Recognizers that the type and language gates leave, in the order that ties are resolved in."""
    scope = scope_of(language)
    typed = [r for r in RULES + LITE if enabled is None or r.entity_type in enabled]
    return [r for r in typed if r.source == "RULE" or scope == "all" or r.language in ("all", scope)]


def _compiles(pattern: str) -> bool:
    """Whether the JVM's engine knows the pattern too, where there is a session to ask."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (CapturedException, Py4JJavaError):
        return False
    return True


def java_pattern(rule: dict) -> str | None:
    """A rule's pattern for Spark, or None where the rule is invalid: such rules are skipped one by one."""
    if not rule.get("enabled", True) or rule.get("entity_type") not in ENTITY_TYPES or not rule.get("pattern"):
        return None
    if rule.get("kind") == "keyword":
        body = re.sub(r"([\\.^$|?*+()\[\]{}\-#&~ ])", r"\\\1", rule["pattern"])
    else:
        try:
            re.compile(rule["pattern"])
        except re.error:
            return None
        body = re.sub(r"\(\?P<", "(?<", rule["pattern"])
        body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", body)
        if not _compiles(body):
            return None
    return ("" if rule.get("case_sensitive") else "(?iu)") + body


def custom(rules: list[dict], enabled: tuple[str, ...] | None, strategy: Column | str, text: str = "text") -> list[Column]:
    """One array of spans for each valid custom rule, in rule order; their number is bounded by the configuration."""
    out = []
    for r in rules:
        p = java_pattern(r)
        if p is None or enabled is not None and r["entity_type"] not in enabled:
            continue
        if r.get("kind") != "keyword" and re.compile(r["pattern"]).match(""):
            found = nonempty(text, r["pattern"], bool(r.get("case_sensitive")))
        else:
            found = matches(text, quoted(p))
        found = F.filter(found, lambda x: x["end"] > x["start"])
        rid, name = (F.lit(r.get(k)).cast("string") for k in ("id", "name"))
        out.append(_as_spans(found, r["entity_type"], strategy, rid, name))
    return out


def _as_spans(found: Column, entity_type: str, strategy: Column | str, rid: Column, name: Column) -> Column:
    return F.transform(found, lambda x: span(x, entity_type, 1.0, "CUSTOM_RULE", strategy, rid, name))


def nonempty(text: str, pattern: str, case_sensitive: bool) -> Column:
    """Matches of a pattern that can match empty text, which the gap method cannot place: an Arrow-batched function."""
    flags = 0 if case_sensitive else re.IGNORECASE

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def found(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, flags)
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m[0]} for m in compiled.finditer(t or "") if m[0]])

    return found(F.col(text))


def detect(docs: DataFrame, enabled: tuple[str, ...] | None = None, language: str = "auto", strategy: Column | str = "mask", rules: list[dict] | None = None, text: str = "text") -> DataFrame:
    """Adds ``candidates``: all generators' spans, rules first, then custom rules, then lightweight entities."""
    found = active(enabled, language)
    first = [generator(r, text, strategy, language) for r in found if r.source == "RULE"]
    last = [generator(r, text, strategy, language) for r in found if r.source != "RULE"]
    arrays = [*first, *custom(rules or [], enabled, strategy, text), *last]
    return docs.withColumn("candidates", F.concat(*arrays) if arrays else empty_spans())


#: Rules of a configuration; their table is sent to every task.
MOST_RULES = 10_000


def apply_rules(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Long form for a rules table ``id, name, pattern, entity_type``: one row per document, rule and match.

    ``pattern`` is already in Spark's syntax.  Every rule meets every document;
    the rules side is small by configuration.
    """
    n = rules.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    met = docs.crossJoin(F.broadcast(rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "pattern", "entity_type")))
    met = met.where(F.expr(f"{text} rlike pattern")).withColumn("x", F.explode(matches(text, "pattern")))
    return met.select(*docs.columns, "rule_id", "rule_name", "entity_type", "x.start", "x.end", F.col("x.text").alias("match"))


def recognizer(key: str) -> Recognizer:
    return ALL[key]


def _but(marks: str) -> str:
    """All code points but ``marks`` as ranges: the engine reads a negated class of such marks ten times slower."""
    at = sorted({-1, *map(ord, marks), 0x110000})
    return "[" + "".join(f"\\x{{{a + 1:x}}}-\\x{{{b - 1:x}}}" for a, b in zip(at, at[1:], strict=False) if b - a > 1) + "]"


def sentences(text: str) -> Column:
    """Sentences with their end marks and offsets, in order."""
    return matches(text, quoted(f"{_but(SENTENCE_END)}++[{SENTENCE_END}]?|[{SENTENCE_END}]"))


def routed(text: str, most: int = ROUTED_SENTENCES) -> Column:
    """What a model should look at: the first risky or mixed-script sentences with offsets, else the beginning."""
    risky = F.filter(sentences(text), lambda s: (has_cjk(s["text"]) & has_latin(s["text"])) | s["text"].rlike(RISK_WORDS))
    label = lambda a, b, t: F.concat(F.lit("["), a.cast("string"), F.lit(":"), b.cast("string"), F.lit("] "), t)
    head = F.substring(F.col(text), 1, ROUTED_CHARS)
    lines = lambda r: F.array_join(F.transform(F.slice(r, 1, most), lambda s: label(s["start"], s["end"], s["text"])), "\n")
    return bound(risky, lambda r: F.when(F.size(r) > 0, lines(r)).otherwise(label(F.lit(0), F.length(head), head)))


def chunks(docs: DataFrame, size: int = 420, overlap: int = 40, text: str = "text") -> DataFrame:
    """Overlapping chunks ``base, chunk`` that break after the last sentence mark of their second half, where there is one."""
    @F.pandas_udf("array<struct<base:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"base": a, "chunk": t[a:b]} for a, b in chunk_bounds(t or "", size, overlap)])

    return docs.withColumn("x", F.explode(cut(F.col(text)))).select(*docs.columns, "x.base", "x.chunk")


def _chunk_end(text: str, base: int, size: int) -> int:
    if base + size >= len(text):
        return len(text)
    window = text[base : base + size]
    mark = max(window.rfind(m, size // 2) for m in SENTENCE_END)
    return base + (mark + 1 if mark > 0 else size)


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk; an empty text is one empty chunk."""
    bounds = [(0, _chunk_end(text, 0, size))]
    while bounds[-1][1] < len(text):
        base = max(bounds[-1][0] + 1, bounds[-1][1] - overlap)
        bounds.append((base, _chunk_end(text, base, size)))
    return bounds
