"""Queries over customers with keys that small tables do not reach, against their SQL."""

import duckdb
import pytest

from tests.test_queries import _plain
from veilspark.plans import corpus
from veilspark.plans.config import Config
from veilspark.plans.pipeline import detected, exploded
from veilspark.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (c_custkey + 99990 AS c_custkey) FROM '/root/testdata/sf0.001/customer.parquet' LIMIT 40) TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["type_rollup", "redact_bilingual"])
def test_oracle_far(spark, far, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{far}/customer.parquet'")
    df = QUERIES[name](spark, far)
    cursor = duck.execute(ORACLES[name])
    assert _plain(df.collect(), df.columns) == _plain(cursor.fetchall(), [d[0] for d in cursor.description])


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    keys = [k for n in range(5, 10) for k in range(10**n - 3, 10**n + 9)] + [12_999_999_999]
    duckdb.connect().execute(f"COPY (SELECT k AS c_custkey, CAST(k % 25 AS INTEGER) AS c_nationkey FROM (SELECT unnest({keys})) t(k)) TO '{folder}/customer.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["type_rollup", "redact_bilingual"])
def test_oracle_long(spark, long, name):
    """Keys of 5 to 11 digits, up to the first that is a mobile number."""
    test_oracle_far(spark, long, name)


def test_spans_are_made_once(spark, far):
    """Exploding spans does not bring a filter that detects again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = detected(corpus.bilingual(spark, far), Config(enabled_entity_types=("PHONE", "EMAIL", "PASSPORT"))).select("spans")
    assert plan(QUERIES["type_rollup"](spark, far)).count("regexp_extract_all") == plan(once).count("regexp_extract_all") > 0


def test_exploded_leaves_out_rows_without_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "none"), (3, None), (4, "")], "doc_id bigint, text string")
    rows = exploded(detected(docs, Config(enabled_entity_types=("EMAIL",))))
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == [(1, "a@b.org"), (1, "c@d.org")]
