"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (the path may be on any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one where none is set and there is one machine only (tests)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if "own" not in _FOLDER:
        _FOLDER["own"] = tempfile.mkdtemp(prefix="veilspark-")
    return _FOLDER["own"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back.

    A written table survives lost executors and, unlike an eager
    ``checkpoint()``, computes its input once only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """``run`` over a task's batches; what it freed goes back to the machine, since its worker stays for later tasks."""

    def out(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def unit_hash(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def row_key(doc_id: str, text: str) -> Column:
    """The doc_id; for a row without one, a number above all others (2^62 and more) made from its text."""
    made = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col(doc_id).cast("bigint"), made)


def quantile_splits(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending split points of a bigint column (a bounded list)."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(col, at, max(10_000, 20 * parts)).alias("s")).first()["s"]
    return sorted(set(found or []))


def range_bucket(col: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` lie below the value, by two-level search.

    The literal arrays hold about twice the square root of the splits each, so
    thousands of ranges cost a few dozen comparisons a row.
    """
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    heads = F.array(*[F.lit(int(g[-1])) for g in groups])
    full = F.size(F.filter(heads, lambda s: s < col))
    inner = F.array(*[F.array(*[F.lit(int(s)) for s in g]) for g in groups] + [F.array().cast("array<bigint>")])
    return full * F.lit(step) + F.size(F.filter(F.get(inner.cast("array<array<bigint>>"), full), lambda s: s < col))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer, vectorised (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def few_by_hash(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """Rows in the order of a hash, ``most`` at most: those under a threshold that leaves about ``most`` are ordered only.

    So what reaches the driver's merge is about ``most`` rows, however many partitions there are.
    """
    n = rows.count()
    share = min(1.0, (most + 8 * most**0.5 + 64) / max(1, n))
    near = rows.withColumn("at", key)
    if share < 1:
        near = near.where(F.pmod(F.col("at"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return near.orderBy(F.pmod(F.col("at"), F.lit(1 << 40)), *[c for c in rows.columns]).limit(most)


def fitted(docs: DataFrame, labels: DataFrame, label: str, most: int, fit, seed: int = 5):
    """What ``fit`` (from an Arrow array of texts and an array of 0 and 1) learns from at most ``most`` labelled texts.

    The ids are drawn first and sent to the documents' scan, so other texts are not shuffled.  Learning runs in one
    task, which is done again where its executor is lost; the driver gets the model only.  Held-out rows and null
    labels are never drawn; repeated labels of a document count as their largest.  Texts come in seeded order.
    """
    import pickle

    import pyarrow as pa

    known = labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    drawn = few_by_hash(known.groupBy("doc_id").agg(F.max("y").alias("y")), F.xxhash64(F.lit(seed), "doc_id"), most)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        rows = pa.Table.from_batches(held).slice(0, most) if held else None
        found = rows.column("text").combine_chunks() if rows else pa.array([], pa.string())
        y = np.array(rows.column("y").to_pylist() if rows else [], float)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found, y))], pa.binary())], ["model"])

    met = texts.join(F.broadcast(drawn), "doc_id").select("at", "y", "text")  # ``most`` rows, but for repeated documents
    got = met.repartition(1).sortWithinPartitions("at", "text").select("y", "text").mapInArrow(trimmed(run), "model binary").collect()  # one row
    return pickle.loads(got[0]["model"]) if got else fit(pa.array([], pa.string()), np.zeros(0))


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``score`` maps an Arrow array of texts to numbers in [0, 1]."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(part.column("text")), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(trimmed(run), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
