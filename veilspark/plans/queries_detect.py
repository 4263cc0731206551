"""Queries of span generators, merge, preservation, routing and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import intact, luhn
from veilspark.operators import merge, summary
from veilspark.operators.detect import apply_rules, chunks, detect, generator, recognizer, routed
from veilspark.plans import corpus
from veilspark.plans.config import Config
from veilspark.plans.pipeline import detected, exploded
from veilspark.sources.files import page_text

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, array) -> DataFrame:
    return df.select("doc_id", F.explode(array).alias("s")).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.text").alias("value"))


CN = f"WITH cn AS ({corpus.SQL}) "


def _placed(value: str, where: str = "true") -> str:
    return f"{CN} SELECT doc_id, CAST(instr(text, {value}) - 1 AS INTEGER) AS start_at, CAST(instr(text, {value}) - 1 + length({value}) AS INTEGER) AS end_at, {value} AS value FROM cn WHERE {where}"


def _on_bilingual(key: str, value: str, where: str = "true"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(corpus.bilingual(spark, sf_dir), generator(recognizer(key)))

    run.__name__ = f"detect_{key}"
    run.__doc__ = f"Spans of {key} in the bilingual corpus."
    query(_placed(value, where))(run)


_on_bilingual("phone_cn", "phone")
_on_bilingual("id_card", "id_no", "doc_id % 2 = 0")
_on_bilingual("passport", "passport")
_on_bilingual("org_zh_context", "org")
_on_bilingual("org_en", "org_en")
_on_bilingual("person_zh", "person")
_on_bilingual("address", "street")

def _located(source: str, pattern: str, group: int = 1, text: str = "text") -> str:
    """Values of a group of all matches with their places: what stands before a match is cut off at the matches."""
    found = f"SELECT doc_id, {text} AS t, regexp_extract_all({text}, '{pattern}', 0) AS f, regexp_extract_all({text}, '{pattern}', {group}) AS v, string_split_regex({text}, '{pattern}') AS g FROM {source}"
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) + instr(f[i], v[i]) - 1"
    return f"SELECT doc_id, t, CAST({before} AS INTEGER) AS start_at, v[i] AS value FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({found}) WHERE len(f) > 0)"


def _spans(located: str) -> str:
    return f"SELECT doc_id, start_at, CAST(start_at + length(value) AS INTEGER) AS end_at, value FROM ({located})"


#: The look-behind as a consumed character: a match ends with one of its class, so the next begins after another one.
EMAIL = r"(?:^|[^A-Za-z0-9_.+-])([A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_FOUND = f"SELECT doc_id, regexp_extract_all(text, '{EMAIL}', 1) AS m FROM documents"


@query(_spans(_located("documents", EMAIL)))
def detect_email(spark, sf_dir):
    """E-mail spans with offsets."""
    return _rows(table(spark, sf_dir, "documents"), generator(recognizer("email")))


@query(_spans(_located("documents", r"(?:^|[^0-9])((?:\+?(?:1|44|61|81|82|65)[-. ]?)?\(?[0-9]{2,4}\)?[-. ][0-9]{3,4}[-. ][0-9]{4})(?:$|[^0-9])")))
def detect_phone_intl(spark, sf_dir):
    """International phone numbers."""
    return _rows(table(spark, sf_dir, "documents"), generator(recognizer("phone_intl")))


#: Every character but digits stands twice, so that neighbours can both have the one between them.
_DOUBLED = r"regexp_replace(text, '([^0-9])', '\1\1', 'g')"
_DOUBLE_CARDS = _located("documents", r"(?s)(?:^|[^0-9])((?:[0-9](?:  |--)?){12,19})(?:$|[^0-9])", text=_DOUBLED)
_CARDS = f"SELECT doc_id, CAST(start_at - length(regexp_replace(substr(t, 1, start_at), '[0-9]', '', 'g')) / 2 AS INTEGER) AS start_at, replace(replace(value, '  ', ' '), '--', '-') AS value FROM ({_DOUBLE_CARDS})"
def luhn_sql(d: str) -> str:
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({d}, length({d}) - i + 1, 1) AS INT) ELSE CAST(substr({d}, length({d}) - i + 1, 1) AS INT) * 2 - CASE WHEN CAST(substr({d}, length({d}) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


_LUHN = luhn_sql("d")


@query(f"SELECT doc_id, start_at, CAST(start_at + length(value) AS INTEGER) AS end_at, value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_CARDS})) WHERE length(d) BETWEEN 12 AND 19 AND {_LUHN}")
def detect_bank_card(spark, sf_dir):
    """Card numbers that pass the Luhn check."""
    return _rows(table(spark, sf_dir, "documents"), generator(recognizer("bank_card")))


@query(f"SELECT c_custkey AS c_custkey, d AS number, {_LUHN} AS valid FROM (SELECT c_custkey, '4' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '0') AS d FROM customer)")
def luhn_check(spark, sf_dir):
    """The Luhn predicate on derived numbers."""
    number = F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number")).withColumn("valid", luhn(F.col("number")))


@query(f"{CN} {_spans(_located('cn', '(?i)London|Beijing|Shanghai|New York|Tokyo|Singapore|北京市|海淀区|北京', 0))}")
def detect_location(spark, sf_dir):
    """Gazetteer hits."""
    return _rows(corpus.bilingual(spark, sf_dir), generator(recognizer("location")))


@query(_spans(_located("documents", r"\b(?:Mr\.?|Ms\.?|Dr\.?)?\s*([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b", text="regexp_replace(text, '[À-ɏ]', '_', 'g')")) + " WHERE NOT regexp_matches(value, '(?i) (university|college|hospital|institute|company|corporation)$')")
def detect_person_en(spark, sf_dir):
    """Capitalised name pairs in all documents (the SQL has accented letters as word characters by an underscore)."""
    return _rows(table(spark, sf_dir, "documents"), generator(recognizer("person_en")))


@query(f"{CN} SELECT doc_id, 3 AS start_at, CAST(3 + length(org) AS INTEGER) AS end_at, org AS value FROM cn")
def detect_org_zh(spark, sf_dir):
    """Bare organisation names; those inside a context verb's phrase, as in the rest of the text, are dropped."""
    docs = corpus.bilingual(spark, sf_dir).withColumn("text", F.concat(F.lit("单位："), "org", F.lit("。"), "text"))
    return _rows(docs, generator(recognizer("org_zh")))


_RULES = [("r1", "ending", "keyword", "tion", "CUSTOM"), ("r2", "code", "regex", "mail[0-9]+", "CUSTOM"), ("r3", "licence", "keyword", "CC BY-NC 4.0", "CUSTOM")]


@query("SELECT rule_id, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, 'r1' AS rule_id, unnest(regexp_extract_all(text, '(?i)tion')) AS v FROM documents UNION ALL SELECT doc_id, 'r2', unnest(regexp_extract_all(text, '(?i)mail[0-9]+')) FROM documents UNION ALL SELECT doc_id, 'r3', unnest(regexp_extract_all(text, '(?i)CC BY-NC 4\\.0')) FROM documents) GROUP BY rule_id".replace("\\\\", "\\"))
def custom_rules(spark, sf_dir):
    """A rules table met with every document: keywords are escaped, case is ignored."""
    from veilspark.operators.detect import java_pattern

    rows = [(i, n, java_pattern({"kind": k, "pattern": p, "entity_type": t}), t) for i, n, k, p, t in _RULES]
    found = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.createDataFrame(rows, "id string, name string, pattern string, entity_type string"))
    return found.groupBy("rule_id").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT entity_type, ',') AS kinds FROM (SELECT doc_id, 'CUSTOM' AS entity_type, unnest(regexp_extract_all(text, 'licensed|Licensed')) AS v FROM documents) GROUP BY doc_id")
def custom_keyword_pipeline(spark, sf_dir):
    """A keyword rule through the whole detection, other types switched off."""
    config = Config(enabled_entity_types=("CUSTOM",), custom_rules=({"id": "k", "name": "k", "kind": "keyword", "pattern": "licensed", "entity_type": "CUSTOM"},))
    rows = exploded(detected(table(spark, sf_dir, "documents").select("doc_id", "text"), config))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("kinds"))


@query(f"SELECT count(*) AS n_spans, CAST(0 AS BIGINT) AS n_broken FROM (SELECT unnest(m) AS v FROM ({_FOUND}))")
def span_integrity(spark, sf_dir):
    """E-mail spans whose offsets do not give their text: none."""
    docs = table(spark, sf_dir, "documents").withColumn("s", F.explode(generator(recognizer("email"))))
    return docs.agg(F.count("*").alias("n_spans"), F.count_if(~intact(F.col("text"), F.col("s"))).alias("n_broken"))


@query(f"{CN} SELECT doc_id, entity_type, value, status, conflict FROM (SELECT doc_id, 'ADDRESS' AS entity_type, street AS value, 'pending' AS status, true AS conflict FROM cn UNION ALL SELECT doc_id, 'LOCATION', city, 'accepted', false FROM cn)")
def merge_spans_conflicts(spark, sf_dir):
    """Addresses win over the places inside them and wait for review; cities elsewhere stay."""
    config = Config(enabled_entity_types=("ADDRESS", "LOCATION"))
    return exploded(detected(corpus.bilingual(spark, sf_dir), config)).select("doc_id", "entity_type", F.col("text").alias("value"), "status", "conflict")


@query(f"{CN} SELECT doc_id, value FROM (SELECT doc_id, street AS value FROM cn WHERE NOT contains(street, '大街1') UNION ALL SELECT doc_id, city AS value FROM cn WHERE city != 'London')")
def preserve_antijoin(spark, sf_dir):
    """Spans that overlap a preserved term are dropped whole."""
    config = Config(enabled_entity_types=("ADDRESS", "LOCATION"), preserve_terms=("大街1", "london"))
    return exploded(detected(corpus.bilingual(spark, sf_dir), config)).select("doc_id", F.col("text").alias("value"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_linenumber = 2 AND l.l_linenumber * 10 < r.l_linenumber * 10 + CAST(r.l_quantity AS INT) AND l.l_linenumber * 10 + CAST(l.l_quantity AS INT) > r.l_linenumber * 10)")
def interval_antijoin(spark, sf_dir):
    """Long-form interval anti-join: intervals of an order that overlap none of its second line's."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    return merge.anti_overlap(rows, rows.where("l_linenumber = 2"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, start, \"end\" AS end_at FROM (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) AS \"end\", lag(l_linenumber * 10 + CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 10, l_linenumber * 10 + CAST(l_quantity AS INT)) AS before FROM lineitem WHERE l_linestatus = 'O') WHERE before > start")
def overlap_check(spark, sf_dir):
    """Active intervals that begin before the one before them ends."""
    status = F.when(F.col("l_linestatus") == "O", "accepted").otherwise("rejected")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"), status.alias("status"))
    return merge.overlapping(rows).select("doc_id", "start", F.col("end").alias("end_at"))


@query(f"{CN} SELECT doc_id, value FROM (SELECT doc_id, person AS value FROM cn UNION ALL SELECT doc_id, org FROM cn)")
def language_gate(spark, sf_dir):
    """Named entities with the language set to Chinese."""
    config = Config(language="zh", enabled_entity_types=("PERSON", "ORG"))
    return exploded(detected(corpus.bilingual(spark, sf_dir), config)).select("doc_id", F.col("text").alias("value"))


_FIRST = "regexp_extract(text, '^[^。]*。', 0)"


@query(f"{CN} SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda i: '[' || (i * length(s)) || ':' || ((i + 1) * length(s)) || '] ' || s), chr(10)) AS routed FROM (SELECT doc_id, {_FIRST} AS s FROM cn) UNION ALL SELECT doc_id + 1000000000, '[0:' || least(length(t), 1200) || '] ' || substr(t, 1, 1200) FROM (SELECT doc_id, repeat(org_en || ' and so on ', 200) AS t FROM cn)")
def sentence_route(spark, sf_dir):
    """What a model would see: the first eight mixed-script sentences with their places, or the beginning of a plain text."""
    docs = corpus.bilingual(spark, sf_dir)
    mixed = docs.select("doc_id", F.expr("repeat(regexp_extract(text, '^[^。]*。', 0), 10)").alias("text"))
    plain = docs.select((F.col("doc_id") + 1000000000).alias("doc_id"), F.expr("repeat(concat(org_en, ' and so on '), 200)").alias("text"))
    return mixed.unionAll(plain).select("doc_id", routed("text").alias("routed"))


_CUT = "CASE WHEN {b} + 420 >= length(text) THEN length(text) WHEN length(regexp_extract(substr(text, {b} + 1, 420), '(?s)^(.*[。！？!?\n])', 1)) > 210 THEN {b} + length(regexp_extract(substr(text, {b} + 1, 420), '(?s)^(.*[。！？!?\n])', 1)) ELSE {b} + 420 END"


@query(f"WITH RECURSIVE c AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS base, CAST({_CUT.format(b='0')} AS BIGINT) AS till FROM documents UNION ALL SELECT doc_id, text, base, CAST({_CUT.format(b='base')} AS BIGINT) FROM (SELECT doc_id, text, greatest(base + 1, till - 40) AS base FROM c WHERE till < length(text))) SELECT doc_id, CAST(base AS INTEGER) AS base, CAST(till - base AS INTEGER) AS n_chars FROM c")
def text_chunks(spark, sf_dir):
    """Overlapping chunks of every document."""
    return chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", F.length("chunk").alias("n_chars"))


_GOLD = f"{CN}, gold AS (SELECT doc_id, 'PHONE' AS entity_type FROM cn UNION ALL SELECT doc_id, 'EMAIL' FROM cn UNION ALL SELECT doc_id, 'ID_CARD' FROM cn UNION ALL SELECT doc_id, 'PASSPORT' FROM cn), hit AS (SELECT * FROM gold WHERE entity_type != 'ID_CARD' OR doc_id % 2 = 0), c AS (SELECT coalesce(g.entity_type, 'ALL') AS entity_type, count(h.doc_id) AS tp, CAST(0 AS BIGINT) AS fp, count(*) - count(h.doc_id) AS fn FROM gold g LEFT JOIN hit h USING (doc_id, entity_type) GROUP BY ROLLUP (g.entity_type))"


@query(f"{_GOLD} SELECT entity_type, tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS \"precision\", round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def eval_prf(spark, sf_dir):
    """Exact-span precision, recall and F1 by type and in all; gold spans follow from the keys."""
    docs = corpus.bilingual(spark, sf_dir)
    kinds = {"PHONE": "phone", "EMAIL": "email", "ID_CARD": "id_no", "PASSPORT": "passport"}
    gold = _gold(docs, kinds)
    found = exploded(detected(docs, Config(enabled_entity_types=tuple(kinds))))
    rated = summary.evaluate(found, gold)
    return rated.select("entity_type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _gold(docs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Gold spans: a value begins where the text before its first occurrence ends."""
    before = lambda c: F.expr(f"length(substring_index(text, {c}, 1))")
    spans = [F.struct(before(c).alias("start"), (before(c) + F.length(c)).alias("end"), F.lit(t).alias("entity_type")) for t, c in kinds.items()]
    return docs.select("doc_id", F.explode(F.array(*spans)).alias("g")).select("doc_id", "g.*")


@query("SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)".replace("\\\\", "\\"))
def page_selection(spark, sf_dir):
    """Visible text of web pages."""
    return table(spark, sf_dir, "pages").withColumn("t", page_text(F.col("html"))).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(f"SELECT entity_type, count(*) AS n FROM (SELECT 'EMAIL' AS entity_type, unnest(m) AS v FROM ({_FOUND})) GROUP BY entity_type")
def entity_counts(spark, sf_dir):
    """Active e-mail spans by type."""
    rows = exploded(detected(table(spark, sf_dir, "documents").select("doc_id", "text"), Config(enabled_entity_types=("EMAIL",))))
    return summary.by_type(rows).groupBy("entity_type").agg(F.sum("n").alias("n"))


@query(f"{CN} SELECT t AS entity_type, count(*) AS n, CAST(0 AS BIGINT) AS n_pending FROM (SELECT unnest(['PHONE', 'EMAIL', 'PASSPORT']) AS t FROM cn) GROUP BY ROLLUP (t)")
def type_rollup(spark, sf_dir):
    """Span counts by type and in all, in one pass."""
    rows = exploded(detected(corpus.bilingual(spark, sf_dir), Config(enabled_entity_types=("PHONE", "EMAIL", "PASSPORT"))))
    return summary.type_rollup(rows)


@query()
def detect_all(spark, sf_dir):
    """Every generator over every document, merged: counts by type."""
    docs = detect(corpus.spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = docs.select("doc_id", F.explode(merge.merged(F.col("text"), F.col("candidates"))).alias("s"))
    return rows.groupBy("s.entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("s.conflict")).alias("n_conflicts"))
