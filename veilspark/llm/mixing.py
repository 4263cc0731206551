"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get target sizes by weight; the words of a source, laid out shard by
shard in seeded document order, are cut into equal blocks; blocks are
apportioned to sources, and each source's blocks to its shards, by highest
quotients.  A shard takes whole passes over its blocks and, for the rest of its
quota, a seeded systematic selection of blocks.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import WORD, materialize, row_key, table

MOST_REPEATS = 3
#: Words of a block, where the smallest source has 512 blocks of that size; else fewer, down to one.
BLOCK_WORDS = 1024
#: Documents of one shard; a hot source is many shards.  The driver holds one small row for each shard, so shards grow
#: beyond that where there would be more than MOST_SHARDS.
SHARD_DOCS, MOST_SHARDS = 2000, 65_536
#: More sources than this are refused: the driver holds one small row for each.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], most: int = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, excess reshared by weight."""
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}, float(sum(sizes))
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        free -= set(over)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 seats + 1)``, none above its cap; ties go to the first.

    Most seats are given at once by a divisor that is safely too large; the
    last few by a heap of quotients, which is the same as giving all by it.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    given = lambda d: [min(c, int(v / d + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    low, high = 0.0, 2.0 * max([1.0, *votes]) + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(given(middle)) > seats else (low, middle)
        if high - low <= 1e-12 * high:
            break
    out = given(high * (1 + 1e-9))
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _sized(docs: DataFrame) -> DataFrame:
    """Adds ``mix_key, mix_source, mix_size``."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.withColumns({"mix_key": row_key("doc_id", "text"), "mix_source": F.col("source").cast("string"), "mix_size": size})


def _laid_out(sized: DataFrame, rows: DataFrame, weights, seed: int, block_words: int) -> tuple[DataFrame, int]:
    """All rows of ``sized`` with their place ``mix_end`` in their shard and the shard's selection, and the words of a block.

    ``rows`` are the same rows' ``mix_key, mix_source, mix_size``, as a table.
    """
    spark = sized.sparkSession
    found = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [r["size"] for r in found]
    target = targets(sizes, [weights(i) for i in range(len(found))])
    small = min((s for s in sizes if s), default=1)
    block = max(1, min(block_words, small // 512))
    per_shard = max(SHARD_DOCS, sum(r["docs"] for r in found) // MOST_SHARDS)
    plan = [(r["source"], i, -(-r["docs"] // per_shard), sizes[i], target[i]) for i, r in enumerate(found)]
    sources = _few(spark, plan, "s string, sid int, shards bigint, mix_source_size bigint, mix_target double")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key"), F.col("shards"))
    dealt = lambda df: df.join(sources, F.col("mix_source").eqNullSafe(F.col("s"))).withColumn("mix_shard", shard).drop("s", "shards")
    parts = sorted((r["sid"], r["mix_shard"], r["size"]) for r in dealt(rows).groupBy("sid", "mix_shard").agg(F.sum("mix_size").alias("size")).collect())
    blocks = _grouped(parts, len(found), block)
    quotas = sainte_lague(target, round(sum(target) / block), [MOST_REPEATS * sum(b) for b in blocks])
    shares = [q for i, b in enumerate(blocks) for q in sainte_lague([float(x) for x in b], quotas[i], [MOST_REPEATS * x for x in b])]
    seeded = lambda s, k, n: zlib.crc32(f"{seed}:{s}:{k}".encode()) % max(1, n)
    quota = [(s, k, max(1, n), q // max(1, n), q % max(1, n), seeded(s, k, n)) for (s, k, _), n, q in zip(parts, (n for b in blocks for n in b), shares, strict=True)]
    quota = _few(spark, quota, "sid int, mix_shard bigint, mix_n bigint, mix_full bigint, mix_rest bigint, mix_start bigint")
    order = F.xxhash64(F.lit(seed), "mix_key", "mix_size")
    within = Window.partitionBy("sid", "mix_shard").orderBy(order, "mix_key").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt(sized).withColumn("mix_end", F.sum("mix_size").over(within))
    return laid.join(quota, ["sid", "mix_shard"]), block


def mix(docs: DataFrame, weights=lambda i: float(i % 3 + 1), seed: int = 11, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row (columns ``doc_id, text, source``).

    ``weights`` maps a source's rank (code-point order, null last) to its
    weight.  A null text has size 0 and takes 0, as does a source without
    words.  ``taken`` counts repeats and is at most three times ``size``.
    A row without doc_id is placed by its text and keeps its null.  Repeated
    rows are dealt with one by one; other columns are not read; texts of any
    length count whole; an empty table gives no rows.
    """
    rows = materialize(_sized(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "mix_key", "mix_source", "mix_size"), "sizes")
    laid, block = _laid_out(rows, rows, weights, seed, block_words)
    chosen = _chosen("mix_end", block) - _chosen("(mix_end - mix_size)", block)
    taken = F.col("mix_full") * F.col("mix_size") + chosen
    return laid.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table, broadcast only while it is small; beyond that it is joined by a shuffle.

    It goes over as an Arrow table: plain rows would start Python workers on the executors, which then stay.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    columns = zip(*rows, strict=True) if rows else [()] * len(schema.split(","))
    fields = [f.split() for f in schema.split(",")]
    df = spark.createDataFrame(pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)}), schema)
    return F.broadcast(df) if len(rows) <= 100_000 else df


def _grouped(parts: list[tuple[int, int, int]], n: int, block: int) -> list[list[int]]:
    """Blocks of each shard, by source."""
    out = [[] for _ in range(n)]
    for s, _, z in parts:
        out[s].append(-(-z // block))
    return out


def _chosen(at: str, block: int):
    """Words of the chosen blocks before a place: block b is chosen where floor((b rest + start) / n) steps up."""
    b = f"({at} div {block})"
    return F.expr(f"{block} * ({_before(b)}) + ({at} - {b} * {block}) * (({_before(b + ' + 1')}) - ({_before(b)}))")


def _before(b: str) -> str:
    """Chosen blocks before block ``b``."""
    return f"(({b}) * mix_rest + mix_start) div mix_n"


def resample(docs: DataFrame, weights=lambda i: float(i % 3 + 1), seed: int = 11, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix takes them, whole: a row comes once for each whole pass of its shard, and once more where the
    block that holds its middle word is chosen.

    The rows themselves are laid out in their shards, so repeated rows are decided one by one and a row without doc_id
    needs no key to be met again.  Rows without words are in no block and go.
    """
    sized = _sized(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")).drop("doc_id", "text", "source")
    rows = materialize(sized.select("mix_key", "mix_source", "mix_size"), "sizes")
    laid, block = _laid_out(sized, rows, weights, seed, block_words)
    b = f"((mix_end - (mix_size + 1) div 2) div {block})"
    times = F.col("mix_full") + F.expr(f"({_before(b + ' + 1')}) - ({_before(b)})")
    out = laid.where("mix_size > 0").withColumn("mix_times", times.cast("int")).where("mix_times > 0")
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_times"))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with source weights 1, 2, 3 in turn."""
    return mix(table(spark, sf_dir, "documents"))
