"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made from repeated word shingles; equal fingerprints collapse
to one node first (a hot group of copies becomes one row before any join).
Two fingerprints at ``radius`` or fewer differing bits agree on at least
``blocks - radius`` of ``blocks`` bit blocks, so each node is keyed by every
choice of that many blocks, nodes that share a key are compared, and the
Hamming distance is verified exactly.  No pair within the radius can be missed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import minhash
from veilspark.llm.common import materialize, row_key, table, trimmed
from veilspark.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
BLOCKS = 6

#: On UTF-8 bytes: A-Z to lower case; split() then cuts at exactly the six ASCII blanks.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text: bit i is set in over half the shingles' XXH64."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    n = len(words) - shingle + 1
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 8192):
        to = min(at + 8192, n)
        grams = map(b" ".join, zip(*(words[at + k : to + k] for k in range(shingle)), strict=True))
        h = np.array([digest(g, 42) for g in grams], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row; a null or word-less text has fingerprint zero."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks, as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def close_pairs(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in ``nodes.fp`` that differ in 1 to ``radius`` bits.

    Both sides of the join are ordinary shuffles, so adaptive execution splits a
    hot block; a pair leaves the join only after its distance has been verified.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, radius)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("choice", "mask")).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp")
    left, right = (keyed.withColumnRenamed("fp", k) for k in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return left.join(right, ["choice", "block"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (columns ``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included.  Repeated rows each get a row; a
    null doc_id stays null and names no component that has another; texts of any
    length count whole, other columns are not read, and an empty table gives none.
    """
    rows = materialize(fingerprint(docs), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    labels = connected_components(close_pairs(nodes, radius, blocks))
    linked = nodes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = materialize(linked.join(least, "component").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _prints(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                fps, sets = np.array([simhash(t) for t in texts], np.uint64), [minhash.grams(t, shingle) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps.view(np.int64)), pa.array(map(len, sets), pa.int64()), pa.array(map(minhash.buckets, sets), pa.list_(pa.int64()))],
                    ["key", "node", "fp", "n", "buckets"],
                )

    return run


def deduplicate(docs: DataFrame, shingle: int = minhash.SHINGLE, similarity: float = minhash.SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id.

    Texts are linked where their sets of ``shingle`` words have the Jaccard
    ``similarity``, and where their fingerprints differ in at most ``radius`` bits.
    Rows that repeat that doc_id are one document; one of them stays.  A row
    without doc_id is a document known by its text; it stays where its group has
    no row with a doc_id, once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select("*", row_key("doc_id", "text").alias("key_of_row"), F.xxhash64(text).alias("node_of_row"))
    texts = known.select(F.col("node_of_row").alias("node"), text.alias("text"))
    prints = known.select("key_of_row", "node_of_row", text).mapInArrow(trimmed(_prints(shingle)), "key bigint, node bigint, fp bigint, n bigint, buckets array<bigint>")
    rows = materialize(prints, "prints")
    nodes = rows.groupBy("node").agg(F.min("key").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    links = nodes.join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = close_pairs(heads, radius, blocks)
    for k in "ab":
        near = near.join(heads.select(F.col("fp").alias(k), F.col("head").alias(f"head_{k}")), k)
    links = links.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    labels = minhash.components(nodes, texts, links, shingle, similarity)
    linked = nodes.join(labels.withColumnRenamed("v", "node"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    classes = linked.join(least, "component").where("rep = least").select("node", "rep")  # the texts of the rows that may stay
    members = rows.select("key", "node").join(classes, "node").where("key = rep")
    kept = materialize(members.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("count")), "kept")
    one, many = (kept.where(w).select(F.col("key").alias("key_of_row"), F.col("node").alias("node_of_row")) for w in ("count = 1", "count > 1"))
    # By shuffle at every size: the kept ids grow with the documents, and the small side is the one that is hashed.
    out = known.join(one.hint("shuffle_hash"), ["key_of_row", "node_of_row"], "left_semi")
    if kept.where("count > 1").limit(1).count():
        again = known.join(many, ["key_of_row", "node_of_row"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["key_of_row"]))
    return out.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
