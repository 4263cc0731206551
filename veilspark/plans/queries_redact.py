"""Queries of replacement, knowledge levels and instruction parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.tables import EMAIL_DOMAINS, EPSILON, EXACT_LEVELS, GENERIC_LEVELS, PSEUDONYMS
from veilspark.operators import anonymize, instruct, knowledge
from veilspark.plans import corpus
from veilspark.plans.config import Config
from veilspark.plans.pipeline import exploded, redact
from veilspark.plans.queries_detect import CN, EMAIL, luhn_sql, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _cn(spark, sf_dir) -> DataFrame:
    return corpus.bilingual(spark, sf_dir)


@query()
def redact_documents(spark, sf_dir):
    """The flagship: every type detected, merged and masked, with the risk of each document."""
    docs = corpus.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return redact(docs).select("doc_id", "n_spans", "n_pending", "risk_score", "risk", "needs_review", "redacted_text")


_NTH = "lpad(CAST(len(list_distinct(m[1:list_position(m, m[i])])) AS VARCHAR), 3, '0')"
_MASKED = f"md5(array_to_string(list_transform(range(1, len(m) + 1), lambda i: g[i] || left(f[i], length(f[i]) - length(m[i])) || '【EMAIL-' || {_NTH} || '】'), '') || g[len(g)])"


_ID = f"SELECT *, doc_id % 2 = 0 AS id_ok, doc_id % 2 = 1 AS card_ok, CASE WHEN right(id_no, 1) = 'X' THEN {luhn_sql('left(id_no, 17)')} ELSE {luhn_sql('id_no')} END AS like_card FROM cn"
_IDS = "CASE WHEN id_ok THEN '【ID_CARD-001】' WHEN like_card THEN '【BANK_CARD-001】' || CASE WHEN right(id_no, 1) = 'X' THEN 'X' ELSE '' END ELSE id_no END"
_CARD = "CASE WHEN NOT card_ok THEN card WHEN like_card AND NOT id_ok THEN '【BANK_CARD-002】' ELSE '【BANK_CARD-001】' END"
_NUMBERS = "CAST(id_ok OR like_card AS INTEGER) + CAST(card_ok AS INTEGER)"


@query(f"{CN}, x AS ({_ID}) SELECT doc_id, '😀姓名：【PERSON-001】，证件' || {_IDS} || '，护照【PASSPORT-001】，就读于【ORG-001】，住在【ADDRESS-001】，电话【PHONE-001】，邮箱【EMAIL-001】，卡号' || {_CARD} || '。His supervisor is Dr. 【PERSON-002】, from 【ORG-002】 in 【LOCATION-001】.' AS redacted_text, CAST(9 + {_NUMBERS} AS INTEGER) AS n_spans, CAST(2 + CAST(id_ok AND like_card AS INTEGER) AS INTEGER) AS n_pending, CAST(least(100, 98 + 18 * ({_NUMBERS})) AS INTEGER) AS risk_score, 'high' AS risk, true AS needs_review FROM x")
def redact_bilingual(spark, sf_dir):
    """The flagship plan on the bilingual corpus: every type, conflicts between an ID and a card number included."""
    rows = redact(_cn(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "redacted_text", "n_spans", "n_pending", "risk_score", "risk", "needs_review")


@query(f"SELECT doc_id, CAST(len(m) AS INTEGER) AS n_spans, CAST(least(100, 10 * len(m)) AS INTEGER) AS risk_score, CASE WHEN len(m) >= 6 THEN 'high' WHEN len(m) >= 3 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN len(m) = 0 THEN md5(text) ELSE {_MASKED} END AS redacted_md5 FROM (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}', 0) AS f, regexp_extract_all(text, '{EMAIL}', 1) AS m, string_split_regex(text, '{EMAIL}') AS g FROM documents)")
def mask_emails(spark, sf_dir):
    """E-mails masked with per-document numbers, and the risk summary."""
    rows = redact(corpus.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), Config(enabled_entity_types=("EMAIL",)))
    return rows.select("doc_id", "n_spans", "risk_score", "risk", F.md5("redacted_text").alias("redacted_md5"))


@query(f"{CN} SELECT doc_id, replace(replace(text, phone, '【PHONE-001】'), email, '【EMAIL-001】') AS redacted_text FROM cn")
def mask_bilingual(spark, sf_dir):
    """Phones and e-mails of the bilingual corpus masked."""
    return redact(_cn(spark, sf_dir).select("doc_id", "text"), Config(enabled_entity_types=("PHONE", "EMAIL"))).select("doc_id", "redacted_text")


@query(f"{CN} SELECT doc_id, text AS standard, replace(text, person_en, '【PERSON-001】') AS strict FROM cn")
def strict_vs_standard(spark, sf_dir):
    """Spans that wait for review are rewritten in strict mode only."""
    docs = _cn(spark, sf_dir).select("doc_id", "text")
    both = [redact(docs, Config(language="en", enabled_entity_types=("PERSON",), risk_level=r)).select("doc_id", F.col("redacted_text").alias(r)) for r in ("standard", "strict")]
    return both[0].join(both[1], "doc_id")


def _case(column: str, levels: dict, i: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in levels.items()) + " END"


_ORG = "CASE WHEN contains(org, '医院') THEN ['某同地区医院', '医疗机构', '公共服务机构'] WHEN contains(org, '公司') OR contains(org, '集团') THEN ['某同业企业', '企业机构', '组织实体'] WHEN contains(org, '研究院') THEN ['某同领域科研机构', '科研机构', '组织实体'] END"


@query(f"{CN} SELECT DISTINCT org AS term, coalesce({_case('org', EXACT_LEVELS, 0)}, ({_ORG})[1]) AS level_1, coalesce({_case('org', EXACT_LEVELS, 1)}, ({_ORG})[2]) AS level_2, coalesce({_case('org', EXACT_LEVELS, 2)}, ({_ORG})[3]) AS level_3, CASE WHEN {_case('org', EXACT_LEVELS, 0)} IS NULL THEN 'local_inferred' ELSE 'local_exact' END AS source FROM cn")
def knowledge_lookup(spark, sf_dir):
    """Levels of each distinct organisation: exact where known, else inferred."""
    terms = _cn(spark, sf_dir).select("org").distinct().withColumn("x", knowledge.lookup(F.col("org"), F.lit("ORG")))
    return terms.select(F.col("org").alias("term"), *[F.col("x.levels")[i].alias(f"level_{i + 1}") for i in range(3)], F.col("x.source").alias("source"))


@query("SELECT n_name AS term, CASE WHEN true THEN '某地区' END AS level_2, 'type_fallback' AS source FROM nation")
def knowledge_fallback(spark, sf_dir):
    """Country names have the generic levels of their type."""
    x = knowledge.lookup(F.col("n_name"), F.lit("LOCATION"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), x["levels"][1].alias("level_2"), x["source"].alias("source"))


@query(f"{CN} SELECT doc_id, replace(replace(text, phone, '某联系电话'), email, '某邮箱') AS redacted_text FROM cn")
def generalize_levels(spark, sf_dir):
    """Spans replaced by their level."""
    config = Config(strategy="generalize", enabled_entity_types=("PHONE", "EMAIL"))
    return redact(_cn(spark, sf_dir).select("doc_id", "text"), config).select("doc_id", "redacted_text")


@query(f"{CN} SELECT entity_type, level_source, count(*) AS n FROM (SELECT 'ORG' AS entity_type, CASE WHEN org IN ('中国人民大学', '复旦大学') THEN 'local_exact' ELSE 'local_inferred' END AS level_source FROM cn UNION ALL SELECT 'EMAIL', NULL FROM cn) GROUP BY ALL")
def knowledge_enrich(spark, sf_dir):
    """Distinct terms looked up once and joined back; types outside the lookup stay bare."""
    rows = redact(_cn(spark, sf_dir).select("doc_id", "text"), Config(language="zh", enabled_entity_types=("ORG", "EMAIL")))
    return knowledge.enrich(exploded(rows)).groupBy("entity_type", "level_source").agg(F.count("*").alias("n"))


@query(f"{CN} SELECT doc_id, replace(replace(text, phone, '某联系电话'), email, '【EMAIL-001】') AS redacted_text FROM cn")
def policy_override(spark, sf_dir):
    """A policy gives one type its own strategy."""
    config = Config(enabled_entity_types=("PHONE", "EMAIL"), policies={"PHONE": "generalize"})
    return redact(_cn(spark, sf_dir).select("doc_id", "text"), config).select("doc_id", "redacted_text")


_ALIAS = "'user' || CAST(('0x' || sha256(email)[1:8])::BIGINT % 900 + 100 AS VARCHAR) || '@"


@query(f"{CN} SELECT doc_id, {', '.join(f'{_ALIAS}{d}' + chr(39) + f' AS s{i + 1}' for i, d in enumerate(EMAIL_DOMAINS))} FROM cn")
def pseudonym_email(spark, sf_dir):
    """E-mail aliases at each strength."""
    return _cn(spark, sf_dir).select("doc_id", *[anonymize.email_alias(F.col("email"), k).alias(f"s{k}") for k in (1, 2, 3)])


@query(f"{CN} SELECT doc_id, left(phone, 3) || '****' || right(phone, 4) AS s1, left(phone, 3) || '******' || right(phone, 2) AS s2, '***********' AS s3 FROM cn")
def pseudonym_phone(spark, sf_dir):
    """Phone aliases at each strength."""
    return _cn(spark, sf_dir).select("doc_id", *[anonymize.phone_alias(F.col("phone"), k).alias(f"s{k}") for k in (1, 2, 3)])


@query(f"{CN} SELECT doc_id, repeat('*', length(card) - 4) || right(card, 4) AS s1, repeat('*', length(card) - 2) || right(card, 2) AS s2, repeat('*', length(card)) AS s3 FROM cn")
def pseudonym_card(spark, sf_dir):
    """Card aliases at each strength."""
    return _cn(spark, sf_dir).select("doc_id", *[anonymize.number_alias(F.col("card"), k).alias(f"s{k}") for k in (1, 2, 3)])


_VEC = "[CAST(length(regexp_replace({v}, '[^一-鿿]', '', 'g')) AS DOUBLE) / length({v}), CAST(length(regexp_replace({v}, '[^A-Za-z]', '', 'g')) AS DOUBLE) / length({v}), CAST(length(regexp_replace({v}, '[^0-9]', '', 'g')) AS DOUBLE) / length({v}), least(length({v}), 40) / 40.0::DOUBLE, CAST(regexp_matches({v}, '大学|学院|公司|集团|医院|机构|(?i)university|college|company|institute|hospital') AS INT)::DOUBLE, CAST(regexp_matches({v}, '省|市|区|县|路|街|号|(?i)street|road|district|city') AS INT)::DOUBLE, 1.0::DOUBLE]"


@query(f"{CN}, t AS (SELECT DISTINCT unnest([org, org_en]) AS term FROM cn) SELECT term, {', '.join(f'round(({_VEC.format(v='term')})[{i + 1}], 6) AS f{i + 1}' for i in range(7))} FROM t")
def semantic_vector(spark, sf_dir):
    """Feature vectors of organisation names."""
    terms = _cn(spark, sf_dir).select(F.explode(F.array("org", "org_en")).alias("term")).distinct()
    v = anonymize.vector(F.col("term"), "ORG")
    return terms.select("term", *[F.round(v[i], 6).alias(f"f{i + 1}") for i in range(7)])


def _weight_sql(pool: tuple[str, ...]) -> str:
    a, out = "v", []
    for i, c in enumerate(pool):
        b = _VEC.format(v=f"'{c}'")
        out.append(f"round(exp({EPSILON[2]} * greatest(0, least(1, list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})))) / 2), 6) AS w{i + 1}")
    return ", ".join(out)


@query(f"{CN}, t AS (SELECT term, {_VEC.format(v='term')} AS v FROM (SELECT DISTINCT unnest([org, org_en]) AS term FROM cn)) SELECT term, {_weight_sql(PSEUDONYMS['ORG'])} FROM t")
def semantic_weights(spark, sf_dir):
    """Weights of the exponential mechanism over the pool of organisations."""
    terms = _cn(spark, sf_dir).select(F.explode(F.array("org", "org_en")).alias("term")).distinct()
    w = anonymize.weights(F.col("term"), "ORG", 2)
    return terms.select("term", *[F.round(w[i], 6).alias(f"w{i + 1}") for i in range(len(PSEUDONYMS["ORG"]))])


@query()
def pseudonym_draw(spark, sf_dir):
    """Whole texts with named entities drawn from their pools, the same for the same document and text."""
    config = Config(strategy="pseudonymize", enabled_entity_types=("PERSON", "ORG", "LOCATION", "ADDRESS"))
    return redact(_cn(spark, sf_dir).select("doc_id", "text"), config).select("doc_id", "redacted_text")


@query(f"SELECT * FROM (VALUES {', '.join(f'({k!r}, {v[0]!r}, {v[1]!r}, {v[2]!r})' for k, v in GENERIC_LEVELS.items())}) AS t(entity_type, level_1, level_2, level_3)")
def generic_levels(spark, sf_dir):
    """The levels that a term without features gets, by type."""
    kinds = spark.createDataFrame([(k,) for k in GENERIC_LEVELS], "entity_type string")
    x = knowledge.lookup(F.lit("Zzz"), F.col("entity_type"))["levels"]
    return kinds.select("entity_type", *[x[i].alias(f"level_{i + 1}") for i in range(3)])


INSTRUCTIONS = (
    (1, "保留北京地名，隐去上海地名，使用最高强度泛化", "", "北京", "上海", "generalize", 3),
    (2, "only mask phone and email, keep London but not Paris", "PHONE,EMAIL", "London", "", "mask", None),
    (3, "仅处理电话", "PHONE", "", "", None, None),
    (4, "请用伪名替换，轻度", "", "", "", "pseudonymize", 1),
    (5, "必须脱敏项目代号Z；其余标准", "", "", "项目代号Z", None, 2),
    (6, "保留所有", "", "", "", None, None),
)


def _value(x) -> str:
    return "NULL" if x is None else repr(x)


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_value(x) for i, x in enumerate(r) if i != 1) + ")" for r in INSTRUCTIONS) + ") AS t(id, types, keep, force, strategy, strength)")
def instruction_parse(spark, sf_dir):
    """Instructions parsed to types, terms, strategy and strength."""
    rows = spark.createDataFrame([r[:2] for r in INSTRUCTIONS], "id int, instruction string")
    p = instruct.parse(rows)
    return p.select("id", F.array_join("enabled_entity_types", ",").alias("types"), F.array_join("preserve_terms", ",").alias("keep"), F.array_join("force_terms", ",").alias("force"), "strategy", F.col("privacy_strength").alias("strength"))


@query(f"{CN} SELECT doc_id, replace(text, email, '【EMAIL-001】') AS redacted_text FROM cn WHERE city != 'London' UNION ALL {CN} SELECT doc_id, replace(text, email, '【EMAIL-001】') FROM cn WHERE city = 'London'".replace(f"UNION ALL {CN}", "UNION ALL"))
def instruction_pipeline(spark, sf_dir):
    """An instruction that narrows the types drives the whole plan."""
    return redact(_cn(spark, sf_dir).select("doc_id", "text"), Config(instruction="only mask email")).select("doc_id", "redacted_text")
