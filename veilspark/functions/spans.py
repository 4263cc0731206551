"""Spans as array columns: finding matches with code-point offsets, and predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.tables import ACCEPT_SCORE, ID_CODES, ID_WEIGHTS

FIELDS = "start:int,end:int,text:string,entity_type:string,score:double,sources:array<string>,status:string,conflict:boolean,strategy:string,rule_id:string,rule_name:string"
SPANS = f"array<struct<{FIELDS}>>"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, plus) -> Column:
    """The running fold of an array under an associative function, by doubling: log n passes, each linear."""

    def fold(v: Column) -> Column:
        def double(acc: Column, k: Column) -> Column:
            far = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i >= far, plus(x, F.get(acc, i - far))).otherwise(x))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(steps, v, double))

    return bound(values, fold)


def matches(text: str, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """Array of ``start, end, text`` of all matches of ``pattern`` (a SQL expression) in column ``text``.

    Offsets count code points.  They are running sums of the lengths of matches and
    of the gaps between them, so both come from the engine's own matcher; gaps are
    cut only where there is a match.  The pattern must not match empty text.
    ``needs`` is a cheap pattern (a SQL expression) that every text with a match has.
    """
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    if needs:
        found = f"if({text} rlike {needs}, {found}, cast(array() as array<string>))"

    def placed(m: Column) -> Column:
        gaps = F.expr(f"split({text}, {pattern}, -1)")
        values = F.expr(f"regexp_extract_all({text}, {pattern}, {group})") if group else m
        ends = bound(gaps, lambda g: running(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)), lambda a, b: a + b))
        return bound(ends, lambda e: F.transform(values, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("text"))))

    return F.flatten(F.transform(F.filter(F.array(F.expr(found)), lambda m: F.size(m) > 0), placed))


def clusters(spans: Column) -> Column:
    """An array of spans in order of start, cut where one begins at or after the end of all before it."""

    def cut(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["end"]), F.greatest)
        heads = bound(far, lambda f: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(F.transform(F.slice(s, i + 1, F.lit(1)), lambda x: x["start"]), F.lit(0)) >= F.get(f, i - 1))))
        return bound(heads, lambda h: F.transform(h, lambda a, j: F.slice(s, a + 1, F.coalesce(F.get(h, j + 1), F.size(s)) - a)))

    return bound(spans, lambda s: F.when(F.size(s) == 0, F.slice(F.array(s), 1, 0)).otherwise(cut(s)))


#: Code points of a block, and the length from which a text is cut into blocks before many places of it are read.
BLOCK, LONG = 1024, 8192


def blocks(text: Column, places: Column) -> Column:
    """Blocks of a long text that many places are read from; none where plain substrings do."""
    return F.when((F.length(text) > LONG) & (places > 8), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def cut(text: Column, parts: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``; where there are blocks, it is read from those it lies in."""
    first = F.greatest(F.floor(start / BLOCK).cast("int"), F.lit(0))
    count = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(1))
    near = F.array_join(F.slice(parts, first + 1, count), "")
    return F.when(F.size(parts) == 0, F.substring(text, start + 1, end - start)).otherwise(F.substring(near, start - first * BLOCK + 1, end - start))


def span(x: Column, entity_type: Column | str, score: Column | float, source: str, strategy: Column | str, rule_id: Column | None = None, rule_name: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    score = lit(score).cast("double")
    none = F.lit(None).cast("string")
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        x["text"].alias("text"),
        lit(entity_type).alias("entity_type"),
        score.alias("score"),
        F.array(F.lit(source)).alias("sources"),
        status_of(score).alias("status"),
        F.lit(False).alias("conflict"),
        lit(strategy).alias("strategy"),
        (none if rule_id is None else rule_id).alias("rule_id"),
        (none if rule_name is None else rule_name).alias("rule_name"),
    )


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def status_of(score: Column) -> Column:
    return F.when(score < ACCEPT_SCORE, "pending").otherwise("accepted")


def luhn(value: Column) -> Column:
    """12 to 19 digits that pass the Luhn check, separators ignored."""
    digits = F.regexp_replace(value, r"\P{Nd}", "")
    return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)


def cn_id(value: Column) -> Column:
    """An 18-character ID number whose last character is its checksum."""
    upper = F.upper(value)
    total = sum(F.substring(upper, i + 1, 1).cast("int") * w for i, w in enumerate(ID_WEIGHTS))
    code = F.substring(F.lit(ID_CODES), total % 11 + 1, F.lit(1))
    return F.when(upper.rlike("^[0-9]{17}[0-9X]$"), code == F.substring(upper, 18, 1)).otherwise(False)


def has_cjk(value: Column) -> Column:
    return value.rlike(r"[\x{4e00}-\x{9fff}]")


def has_latin(value: Column) -> Column:
    return value.rlike("[A-Za-z]")


def intact(text: Column, s: Column, parts: Column | None = None, size: Column | None = None) -> Column:
    """The span's offsets lie in the text (of ``size``, cut into ``parts``, if given) and give its own text."""
    own = F.substring(text, s["start"] + 1, s["end"] - s["start"]) if parts is None else cut(text, parts, s["start"], s["end"])
    return (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= (F.length(text) if size is None else size)) & (own == s["text"])


def all_intact(text: Column, spans: Column) -> Column:
    """The spans that are :func:`intact`; each costs its own length, wherever in the text it stands."""
    held = lambda s: F.struct(blocks(text, F.size(s)).alias("parts"), F.length(text).alias("size"))
    return bound(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(bound(held(s), lambda h: F.filter(s, lambda x: intact(text, x, h["parts"], h["size"])))))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])
