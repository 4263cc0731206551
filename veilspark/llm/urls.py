"""URL filters: prefix rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs.  Where none are given, the URLs whose
verdict a rule fixes are the labelled ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import few_by_hash, table
from veilspark.llm.gbt import train

#: (verdict, host, path): fits its host and all its subdomains where the path starts so; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Labelled URLs that the trees learn from, at most.
TRAIN_URLS = 20_000
#: Host suffixes with statistics, at most.
SUFFIXES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "depth", "digit_ratio", "host_digits", "entropy", "parameters", "hyphens", "labels", "longest_label", "vowel_ratio", "secure", "suffix_rate"]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name (host and path together) and verdict, both null where none fits."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def features(rows: DataFrame, rates: dict[str, float], default: float) -> DataFrame:
    """Adds FEATURES to rows of ``url, host, path``."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    size = lambda c: F.length(c).cast("double")
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    letters = F.array_sort(F.split(url, ""))
    runs = F.aggregate(
        letters,
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(x == a["c"], F.struct(x.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("c"), F.lit(1.0).alias("n"), (a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0)).alias("s"))),
        lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0),
    )
    n = F.greatest(size(url), F.lit(1.0))
    known = F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv]) if rates else None
    rate = F.coalesce(F.try_element_at(known, suffix_of(host)), F.lit(default)) if rates else F.lit(default)
    made = {
        "length": size(url),
        "host_length": size(host),
        "depth": count(F.col("path"), "/"),
        "digit_ratio": count(url, "[0-9]") / n,
        "host_digits": count(host, "[0-9]"),
        "entropy": F.log2(n) - runs / n,
        "parameters": count(url, "[?&][^=&#]+="),
        "hyphens": count(host, "-"),
        "labels": count(host, r"\.") + 1,
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        "vowel_ratio": count(host, "[aeiou]") / F.greatest(size(host), F.lit(1.0)),
        "secure": url.startswith("https").cast("double"),
        "suffix_rate": rate,
    }
    return rows.withColumns(made)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row (columns ``page_id, url``).

    ``labelled`` has ``url, blocked`` (0 or 1); the trees learn from at most
    TRAIN_URLS of them, chosen by hash.  Score is the trees' chance of block; it
    decides at 0.5 where no rule fits.  Null or malformed URLs have empty host
    and path and are judged like any other, URLs of any length whole.  Repeated
    rows each get a row, a null page_id stays null, other columns are not read,
    and an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("fixed", verdict)
    if labelled is None:
        known = rows.where("fixed is not null").select("url", "host", "path", (F.col("fixed") == "block").cast("double").alias("y"))
    else:
        known = labelled.select(F.col("url").cast("string"), F.col("blocked").cast("double").alias("y")).where("y is not null")
        known = known.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    sample = few_by_hash(known.select("url", "host", "path", "y"), F.xxhash64("url"), TRAIN_URLS)
    drawn = features(sample, {}, 0.0).withColumn("suffix", suffix_of(F.col("host"))).select("y", "suffix", *FEATURES[:-1]).collect()  # at most TRAIN_URLS rows
    y = np.array([r["y"] for r in drawn])
    prior = float(y.mean()) if len(y) else 0.5
    found: dict[str, list[float]] = {}
    for r in drawn:
        found.setdefault(r["suffix"], []).append(r["y"])
    common = sorted(found, key=lambda s: (-len(found[s]), s))[:SUFFIXES]
    rates = {s: (sum(found[s]) + 10 * prior) / (len(found[s]) + 10) for s in common}
    x = np.array([[*(r[f] for f in FEATURES[:-1]), rates.get(r["suffix"], prior)] for r in drawn]).reshape(len(drawn), len(FEATURES))
    model = train(x, y)
    scored = features(rows, rates, prior).withColumn("score", model.score(FEATURES))
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("fixed", by_trees).alias("verdict"), "score")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return judge(table(spark, sf_dir, "pages"))
