"""Texts whose sets of word shingles are alike, by MinHash bands and an exact check.

A band of hashes that two texts share puts them into one bucket; a pair at
Jaccard 0.8 shares none of the 30 bands once in about 9,000 times.  All members of
a small bucket meet; those of a large one meet a leader that a hash of bucket and
member chooses, so that a group of copies that shares many buckets meets many
leaders.  Links that hold in the sets themselves are joined to components.  What
then stands outside a large bucket's main component is compared with the whole
bucket, in tiles that give one link for each component found alike.  So a large
bucket makes rows in proportion to its members, and no link is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, trimmed
from veilspark.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
#: Members of a small bucket.
FEW = 16
#: Members, and hashes of their sets, on one side of a tile.
TILE_ROWS, TILE_GRAMS = 1024, 1 << 20

#: On UTF-8 bytes, as the fingerprints have it: A-Z to lower case; split() then cuts at the six ASCII blanks.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TIMES = np.random.default_rng(7).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_PLUS = np.random.default_rng(8).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))


def buckets(found: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; none for an empty set."""
    if not len(found):
        return []
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[None, at : at + 4096] * _TIMES + _PLUS).min(1), out=least)
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return keys.view(np.int64).tolist()


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [grams(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have the Jaccard similarity."""
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(k), F.col("grams").alias(f"grams_{k}")), k)
    shared, both = F.size(F.array_intersect("grams_a", "grams_b")), F.size("grams_a") + F.size("grams_b")
    return pairs.where(shared >= (both - shared) * similarity - 1e-9).select("a", "b")


def components(nodes: DataFrame, texts: DataFrame, links: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``v, component`` of every node with a link: one of ``links`` (pairs ``a, b``), or sets that are alike.

    ``nodes`` has one row ``node, n, buckets`` for each distinct text, ``n`` being
    the size of its set; ``texts`` has rows ``node, text``, each node at least once.
    """
    spread = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min_by("node", F.xxhash64("bucket", "node")).alias("first"), F.count("*").alias("members")).where("members > 1")
    members = materialize(spread.join(shared, "bucket"), "members")
    # A text with many copies is one row of each task before the shuffle, and one row after it.
    single = texts.groupBy("node").agg(F.first("text").alias("text")).join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(single.mapInArrow(trimmed(_sets(shingle)), "node bigint, grams array<bigint>"), "sets")
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9  # else no sets of these sizes are alike
    side = lambda df, k: df.select("bucket", F.col("node").alias(f"node_{k}"), F.col("n").alias(f"n_{k}"), *([(F.col("members") > FEW).alias("leads")] if k == "a" else []))
    heads = members.where((F.col("members") <= FEW) | (F.col("node") == F.col("first")))
    met = side(heads, "a").join(side(members, "b"), "bucket").where(near & ((F.col("node_a") < F.col("node_b")) | (F.col("leads") & (F.col("node_a") > F.col("node_b")))))
    tried = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    found = connected_components(links.unionByName(_alike(tried, sets, similarity)))
    large = members.where(F.col("members") > FEW)
    if not large.limit(1).count():
        return found
    # Components are joined by what is found between them; a node without a link so far is its own component.
    joined = connected_components(_outside(large, found, sets, similarity)).select(F.col("v").alias("component"), F.col("component").alias("to"))
    moved = found.join(joined, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
    alone = joined.join(found.select(F.col("v").alias("component")), "component", "left_anti")
    return moved.unionByName(alone.select(F.col("component").alias("v"), F.col("to").alias("component")))


def _outside(large: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of components ``a, b`` with members alike, from buckets that hold more than one component.

    The queries are a bucket's members outside its main component (the one with the most members); they are compared
    with all members.  Queries and members are dealt to tiles of bounded rows and set sizes by a hash.
    """
    placed = large.join(found.withColumnRenamed("v", "node"), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    tiles = lambda rows, grams: F.greatest(F.ceil(rows / TILE_ROWS), F.ceil(grams / TILE_GRAMS), F.lit(1)).cast("int")
    most = F.struct("rows", "component")
    mixed = counted.groupBy("bucket").agg(F.max_by("component", most).alias("main"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.max(F.struct("rows", "component", "grams")).alias("top"))
    mixed = mixed.where("parts > 1").select("bucket", "main", tiles(F.col("rows"), F.col("grams")).alias("kd"), tiles(F.col("rows") - F.col("top.rows"), F.col("grams") - F.col("top.grams")).alias("kq"))
    apart = placed.join(mixed, "bucket")
    own = lambda k, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(k)).cast("int")
    dealt = lambda query, q, d: apart.where("component != main" if query else "true").select("bucket", q.alias("q"), d.alias("d"), F.lit(query).alias("query"), "component", "node")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    met = dealt(True, own("kq", "q"), F.lit(0)).drop("d").join(mixed.select("bucket", "kd"), "bucket").withColumn("d", every("kd")).drop("kd")
    all_ = dealt(False, F.lit(0), own("kd", "d")).drop("q").join(mixed.select("bucket", "kq"), "bucket").withColumn("q", every("kq")).drop("kq")
    both = met.unionByName(all_).join(sets, "node").select("bucket", "q", "d", "query", "component", "grams")
    return both.groupBy("bucket", "q", "d").applyInArrow(_tile(similarity), "a bigint, b bigint").distinct()


def _tile(similarity: float):
    """Within one tile: each query's count of shared hashes with every member, by posting lists."""

    def run(tile: pa.Table) -> pa.Table:
        query = np.array(tile.column("query").to_pylist(), bool)
        component = np.array(tile.column("component").to_pylist(), np.int64)
        lists = tile.column("grams").combine_chunks()
        lists = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        sizes = np.diff(lists[1])
        rows = np.flatnonzero(~query)
        of = np.repeat(np.arange(len(query)), sizes)
        held = ~query[of]
        tokens, owner = lists[0][lists[1][0] : lists[1][-1]][held], of[held]
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        out = set()
        for k in np.flatnonzero(query) if len(rows) else ():
            own = lists[0][lists[1][k] : lists[1][k + 1]]
            first, last = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            counts = last - first
            at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            shared = np.bincount(owner[at], minlength=len(query))
            alike = (shared >= (sizes + sizes[k] - shared) * similarity - 1e-9) & (shared > 0) & (component != component[k])
            for c in np.unique(component[alike]).tolist():
                out.add((min(c, int(component[k])), max(c, int(component[k]))))
        pairs = sorted(out)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run
