import re

import corpus_pipeline
from veilspark.llm.common import materialize

from .test_near_duplicates import plain_simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], DATA), name))
    clean, single, redacted, mixed, packed = kept[1:]
    assert all(d.columns == columns for d in kept[:-1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in clean.collect()}
    right = sum((i in ids) != bool(t) for i, t in labels.items())
    assert right >= 0.9 * len(labels)  # learned from 65 labels here
    fps = [plain_simhash(r["text"]) for r in single.collect()]
    assert not [1 for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3] and 0 < len(fps) < clean.count()
    texts = [r["text"] for r in redacted.collect()]
    assert len(texts) == len(fps) and not [t for t in texts if re.search(r"[\w.+-]+@[\w-]+\.\w+", t)] and any("[EMAIL]" in t for t in texts)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in redacted.collect()}
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed.collect()}


def test_stages_over_odd_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, DATA), name)
        assert docs.count() >= (start is odd_docs)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
