"""A bilingual corpus derived from ``customer``: every value and its place follow from the key.

The same SQL runs in Spark and in the oracle's engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions.tables import ID_CODES, ID_WEIGHTS

_PREFIX = "11010519491231"
_FIXED = sum(int(c) * w for c, w in zip(_PREFIX, ID_WEIGHTS, strict=False))


def _choose(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_K = "c_custkey"
_SERIAL = f"lpad(cast({_K} % 1000 as string), 3, '0')"
_SUM = f"({_FIXED} + {ID_WEIGHTS[14]} * cast(substr({_SERIAL}, 1, 1) as int) + {ID_WEIGHTS[15]} * cast(substr({_SERIAL}, 2, 1) as int) + {ID_WEIGHTS[16]} * cast(substr({_SERIAL}, 3, 1) as int))"
#: Every other number has a wrong check digit.
FIELDS = {
    "person": _choose(_K, ["王洋", "李小明", "陈思", "欧阳雪", "赵磊"]),
    "id_no": f"'{_PREFIX}' || {_SERIAL} || substr('{ID_CODES}', ({_SUM} + {_K} % 2) % 11 + 1, 1)",
    "passport": f"'E' || lpad(cast({_K} % 100000000 as string), 8, '0')",
    "org": _choose(_K, ["中国人民大学", "复旦大学", "华东医院", "星海有限公司", "南山研究院", "东方集团"]),
    "street": f"'北京市海淀区中关村大街' || cast({_K} % 90 + 1 as string) || '号'",
    "phone": f"'1' || cast(30 + c_nationkey as string) || lpad(cast({_K} % 100000000 as string), 8, '0')",
    "email": f"'u' || cast({_K} as string) || '@example.com'",
    "person_en": _choose(_K, ["Alice Morgan", "Robert Hill", "Jane Porter", "Carl Jensen", "Maria Lopez", "Peter Novak", "Laura Stone"]),
    "org_en": _choose(_K, ["Northbridge Institute", "Lakeside University", "Summit Hospital"]),
    "city": _choose(_K, ["London", "Tokyo", "Singapore", "Beijing"]),
    "card": f"'411111111111111' || cast({_K} % 2 as string)",
}
_TEXT = "'😀姓名：' || person || '，证件' || id_no || '，护照' || passport || '，就读于' || org || '，住在' || street || '，电话' || phone || '，邮箱' || email || '，卡号' || card || '。His supervisor is Dr. ' || person_en || ', from ' || org_en || ' in ' || city || '.'"
#: SELECT over a table ``customer``; works in both engines.
SQL = f"SELECT doc_id, {_TEXT} AS text, nation, {', '.join(FIELDS)} FROM (SELECT c_custkey AS doc_id, c_nationkey AS nation, {', '.join(f'{v} AS {k}' for k, v in FIELDS.items())} FROM customer)"


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer partitions than there are cores dealt to all of them, once, before work that is heavy a row.

    A table with more files or splits than cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.sql(SQL.replace("FROM customer)", "FROM {customer})"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet")))
