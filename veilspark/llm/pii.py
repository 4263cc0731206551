"""Personal data by weak supervision, in Spark SQL functions only.

Strict patterns give base spans, which always stay; loose patterns propose more.
Labelers (shape, gazetteer, context words, validators, borders) vote on every
candidate.  Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability; a logistic span classifier is then trained on the
resulting soft labels and decides on the proposed spans.  Only the table of
vote-pattern counts, whose size is bounded by the number of patterns, reaches
the driver.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import blocks, bound, clusters, cut, quoted, running
from veilspark.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Each starts only where a run of its first characters starts (or the match before ends) and never gives
#: characters back, which finds the same leftmost matches as the plain forms, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+)++",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
}
#: What every text with a match has; cheaper to look for than the match.
NEEDS = {
    "base": {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"},
    "loose": {"email": r"[\[(]at[\])]", "card": r"(?:[0-9]{4}[ -]?){3}[0-9]{4}", "phone": r"[0-9)][ .-][0-9]{3,4}[ .-][0-9]{4}"},
}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au", "jp", "cn", "in", "br")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98")
FOR_WORDS = r"(?i)(?:e-?mail|contact|write|reach|call|phone|tel|fax|mobile|cell|whatsapp|card|visa|mastercard|amex|account|pay|host|server|address|login|ip)[^0-9]{0,24}$"
AGAINST_WORDS = r"(?i)(?:order|invoice|isbn|issn|version|build|serial|ticket|ref|sku|section|chapter|doi|part|token|sha|hash|id)[ #.:=-]{0,4}$"
#: Characters before a match that context labelers read.
CONTEXT = 40
LABELERS = ("shape", "gazetteer", "for", "against", "valid", "border")


def _found(text: str, pattern: str, needs: str) -> Column:
    """Array of start, end, val, before, after of all matches in a text column, offsets in code points; linear but for the
    doubling of the running sums."""
    p = quoted(pattern)
    found = F.expr(f"if({text} rlike {quoted(needs)}, regexp_extract_all({text}, {p}, 0), cast(array() as array<string>))")

    def placed(m: Column) -> Column:
        def spans(g: Column) -> Column:
            ends = running(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)), lambda a, b: a + b)
            one = lambda e: lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("val"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(g, i + 1), F.lit(1)).alias("after"))
            return bound(ends, lambda e: F.transform(m, one(e)))

        return bound(F.expr(f"split({text}, {p}, -1)"), spans)

    return F.flatten(F.transform(F.filter(F.array(found), lambda m: F.size(m) > 0), placed))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, val: Column) -> Column:
    n = F.length(_digits(val))
    if kind == "ip":
        return ~F.exists(F.split(val, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})"))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), F.call_function("luhn_check", _digits(val))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _votes(kind: str, strict: bool, x: Column) -> list[Column]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    val, digits = x["val"], _digits(x["val"])
    if kind == "email":
        known = F.lower(F.regexp_extract(val, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
        gazetteer, valid = vote(known, ~known), vote(val.rlike(r"[A-Za-z]{2,}$"), ~val.rlike(r"[A-Za-z]{2,}$"))
    elif kind == "ip":
        odd = val.rlike(r"^(?:0|127|255)\.")
        gazetteer, valid = vote(~odd, odd), vote(_valid(kind, val), ~_valid(kind, val))
    elif kind == "card":
        issuer = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)")
        gazetteer, valid = vote(issuer, ~issuer), vote(_valid(kind, val), ~_valid(kind, val))
    else:
        code = F.regexp_extract(val, r"^\+([0-9]{1,2})", 1)
        known = code.isin(*COUNTRY_CODES) | F.substring(code, 1, 1).isin("1", "7")
        size = F.length(digits).between(10, 13)
        gazetteer, valid = vote(known), vote(size, ~size)
    worded = (F.right(x["before"], F.lit(1)).rlike(r"[\pL\pN]")) | x["after"].rlike(r"[\pL\pN]")
    return [F.lit(1 if strict else 0), gazetteer, vote(x["before"].rlike(FOR_WORDS)), F.when(x["before"].rlike(AGAINST_WORDS), -1).otherwise(0), valid, vote(~worded, worded)]


def _candidates(kind: str, base: bool) -> Column:
    """Candidates of one kind and shape, with their votes; failing base matches are dropped, as are loose cards."""
    found = F.col(f"{'base' if base else 'loose'}_{kind}")
    if base or kind == "card":
        found = F.filter(found, lambda x: _valid(kind, x["val"]))
    return F.transform(
        found,
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.array(*_votes(kind, base, x)).alias("votes")),
    )


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: base and proposed candidates, each with start, rank, end, kind, base and votes."""
    out = docs
    for shape, patterns in (("base", BASE), ("loose", LOOSE)):
        for kind, p in patterns.items():
            out = out.withColumn(f"{shape}_{kind}", _found(text, p, NEEDS[shape][kind]))
    made = {shape: F.concat(*[_candidates(kind, shape == "base") for kind in patterns]) for shape, patterns in (("base", BASE), ("loose", LOOSE))}
    out = out.withColumn("strict", made["base"]).withColumn("proposed", made["loose"])
    return out.withColumn("spans", F.concat("strict", _apart(F.col("proposed"), F.col("strict")))).select(*docs.columns, "spans")


def _apart(proposed: Column, strict: Column) -> Column:
    """Proposed spans that no strict one overlaps: among the strict ones that begin before its end, none ends after its start.

    Starts of strict and ends of proposed spans are sorted together, and the furthest end so far runs along.
    """
    none = F.lit(None).cast("struct<start:int,rank:int,end:int,kind:string,base:boolean,votes:array<int>>")
    begins = F.transform(strict, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("strict"), b["end"].alias("end"), none.alias("x")))
    closes = F.transform(proposed, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("strict"), F.lit(-1).alias("end"), x.alias("x")))

    def kept(events: Column) -> Column:
        far = running(F.transform(events, lambda e: e["end"]), F.greatest)
        clear = lambda f: F.filter(F.transform(events, lambda e, i: F.when((e["strict"] == 0) & (F.get(f, i) <= e["x"]["start"]), e["x"])), lambda x: x.isNotNull())
        return bound(far, clear)

    return F.when((F.size(proposed) == 0) | (F.size(strict) == 0), proposed).otherwise(bound(F.array_sort(F.concat(begins, closes)), kept))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Soft label of each (kind, votes, count) by EM: per-kind priors, per-labeler odds of each vote in either class."""
    if not counts:
        return []
    post = [1 / (1 + exp(-(sum(v) - 1.0))) for _, v, _ in counts]  # majority vote to begin with
    for _ in range(rounds):
        rate = {}
        for k in range(len(LABELERS)):
            for value in (-1, 0, 1):
                for c in (0, 1):
                    rate[k, value, c] = 0.5
        total, prior = [1.5, 1.5], {}
        for (kind, votes, n), p in zip(counts, post, strict=True):
            prior.setdefault(kind, [1.0, 1.0])
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                prior[kind][c] += w
                total[c] += w
                for k, v in enumerate(votes):
                    rate[k, v, c] += w
        post = []
        for kind, votes, _ in counts:
            odds = log(prior[kind][1] / prior[kind][0]) + sum(log(rate[k, v, 1] / total[1] / (rate[k, v, 0] / total[0])) for k, v in enumerate(votes))
            post.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
    return post


def _row(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes)]


def train(counts: list[tuple[int, tuple[int, ...], int]], steps: int = 300, ridge: float = 0.01) -> list[float]:
    """Weights of the span classifier: logistic regression on the soft labels, weighted by count."""
    post = reliabilities(counts)
    size = 1 + len(KINDS) + 2 * len(LABELERS)
    w, total = [0.0] * size, float(sum(n for *_, n in counts) or 1)
    rows = [_row(k, v) for k, v, _ in counts]
    for _ in range(steps):
        g = [ridge * x for x in w]
        for r, (_, _, n), y in zip(rows, counts, post, strict=True):
            d = n / total * (1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, r, strict=True)))))) - y)
            for i, x in enumerate(r):
                if x:
                    g[i] += d * x
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(annotated: DataFrame) -> list[float]:
    """The classifier learned from all candidates of all rows."""
    pairs = annotated.select(F.explode("spans").alias("s")).groupBy("s.rank", "s.votes").count()
    counts = sorted((r["rank"], tuple(r["votes"]), r["count"]) for r in pairs.collect())  # at most 4 * 3**6 vote patterns
    return train(counts)


def accepted(weights: list[float]) -> Column:
    """Base spans and the proposed ones that the classifier takes, by start, kind and end."""
    k = 1 + len(KINDS)

    def margin(x: Column) -> Column:
        out = F.lit(weights[0]) + F.element_at(F.array(*[F.lit(w) for w in weights[1:k]]), x["rank"] + 1)
        for i in range(len(LABELERS)):
            v = F.get(x["votes"], F.lit(i))
            out = out + F.when(v == 1, weights[k + i]).when(v == -1, weights[k + len(LABELERS) + i]).otherwise(0.0)
        return out

    return F.array_sort(F.filter("spans", lambda x: x["base"] | (margin(x) >= 0)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row (columns ``doc_id, text``).

    A null text is empty and has no spans.  Repeated rows each get a row, whole
    texts of any length are read, a null doc_id stays null, other columns are not
    read, and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(annotate(rows).select("doc_id", "spans"), "spans")
    base = F.array_sort(F.filter("spans", lambda x: x["base"]))
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(accepted(fit(rows))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; null texts stay null.

    Of overlapping spans the one that begins first stays.  Repeated rows are rewritten one by one, texts of any length
    whole and in linear time, other columns stay as they are, and an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weights = fit(annotate(texts))
    marked = annotate(docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).withColumn("spans", accepted(weights))
    text = F.when(F.col("row.text").isNull() | (F.size("spans") == 0), F.col("row.text")).otherwise(bound(F.col("spans"), lambda s: _rewritten(F.col("text"), s)))
    return marked.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with sorted spans replaced; each piece is read once."""
    slim = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    kept = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    greedy = lambda out, x: F.when((F.size(out) == 0) | (x["start"] >= F.try_element_at(out, F.lit(-1))["end"]), F.concat(out, F.array(x))).otherwise(out)
    apart = F.flatten(F.transform(clusters(slim), lambda group: F.when(F.size(group) < 2, group).otherwise(F.aggregate(group, kept, greedy))))
    by = lambda p: F.transform(p, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("by")))

    def pieces(p: Column, held: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(p, i - 1)["end"])
        made = F.transform(p, lambda x, i: F.concat(cut(text, held, before(i), x["start"]), x["by"]))
        return F.concat(F.array_join(made, ""), cut(text, held, F.get(p, F.size(p) - 1)["end"], F.length(text)))

    return bound(bound(apart, by), lambda p: bound(blocks(text, F.size(p)), lambda held: pieces(p, held)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(table(spark, sf_dir, "documents"))
